"""Late session merging: every version that sessions pass through as batches arrive, by reverse deletion.

Events of a user that are at most GAP seconds apart share a session. Seen from the end, batches are removed in descending
order from a doubly linked list of all events: an event that goes leaves a wider gap, and where the gap exceeds GAP the session
splits (the smaller side gets the new name, so that a list of n entries takes n log n steps). Read the other way round, what
is left of a session is what the batch found standing: nothing is a creation, one session an extension, more a merge.

How it is spread: events are added up to (user, second, batch) before anything else, so that repeated events and hot seconds
shrink where they are read. A list is a user's block of BLOCK seconds, never a whole user: it has at most an entry per second
and batch. Blocks whose neighbours are more than GAP away are done at once. In the others ("open" to a side) the runs that touch an open
border may go on in the next block. The list writes down, for each batch it holds, what these runs are then; runs
inside are done. A second step puts border runs together: per chain of neighbouring blocks and slice of batches (SLICES at most, for long
chains), all blocks of the chain are arrays, and each batch relinks them in one vector step. So neither a user nor a session goes
through one task; a task of the second step holds at most two runs a block of its chain, and the changes of its slice.

Defined results: events without user, second or batch take no part (in conversations: null conv_id or turn). Repeated rows are events
of their own. Events of one second belong together whatever their order. An empty table gives no row. Texts and extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ready
from .repair import CRC_TABLE, crc_sql

GAP = 600
#: Seconds of a block; it must exceed GAP.
BLOCK = 21_600
#: A chain gets a slice of batches for every 16 of its blocks, and so many at most.
SLICES = 256
#: kind 0: version, 1: only who retracts a version, 2: border runs of a block at a batch, 3: the start of a border run's session.
FOUND = "user long, chain long, block long, kind int, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, by_batch long, by_start long, by_side int"
RUNS = [f"{side}_{x}" for side in "lr" for x in ("start", "end", "n", "h", "batch", "new", "inner")]
LISTED = FOUND + ", until long, " + ", ".join(f"{x} long" for x in RUNS)


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in (x.split() for x in ddl.split(", "))])


def reverse(s: list, b: list, n: list, h: list, left: bool, right: bool, gap: int) -> Iterator[tuple]:
    """The entries of a block, sorted by second: versions, retractions and border runs as tuples of LISTED without user, chain and block."""
    m = len(s)
    before, after, run = list(range(-1, m - 1)), list(range(1, m + 1)), [0] * m
    start, end, events, hashes, by = [], [], [], [], []
    for i in range(m):
        if not i or s[i] - s[i - 1] > gap:
            for x, v in ((start, i), (end, i), (events, 0), (hashes, 0), (by, None)):
                x.append(v)
        r = run[i] = len(start) - 1
        end[r] = i
        events[r] += n[i]
        hashes[r] += h[i]
    first, last, done, until = 0, m - 1, 0, None
    order = sorted(range(m), key=b.__getitem__, reverse=True)
    records: list[list] = []
    waits: dict[int, list[tuple[list, int]]] = {}  # records that are to learn a run's latest batch
    while done < m:
        level, upto = b[order[done]], done
        new: Counter = Counter()
        while upto < m and b[order[upto]] == level:
            new[run[order[upto]]] += n[order[upto]]
            upto += 1
        border = _border(run, first, last, m, left, right)
        record = [level, until, *[None] * 14] if border else None
        for r, side in border.items():
            record[2 + 7 * side : 9 + 7 * side] = [s[start[r]], s[end[r]], events[r], hashes[r], None, new.get(r, 0), 0]
            waits.setdefault(r, []).append((record, 6 + 7 * side))
        if border:
            records.append(record)
        made = {}
        for r in new:
            for seen, at in waits.pop(r, ()):
                seen[at] = level
            made[r] = (s[start[r]], s[end[r]], events[r], hashes[r], by[r])
        kids = {r: [r] for r in new}
        origin = {}
        for k in order[done:upto]:
            r, p, q = run[k], before[k], after[k]
            events[r] -= n[k]
            hashes[r] -= h[k]
            if p >= 0:
                after[p] = q
            else:
                first = q
            if q < m:
                before[q] = p
            else:
                last = p
            inside_p, inside_q = p >= 0 and run[p] == r, q < m and run[q] == r
            if not inside_p:
                start[r] = q if inside_q else -1
            elif not inside_q:
                end[r] = p
            elif s[q] - s[p] > gap:
                small, is_left = _smaller(run, before, after, p, q, r, m)
                name = len(start)
                for x in small:
                    run[x] = name
                some_n, some_h = sum(n[x] for x in small), sum(h[x] for x in small)
                events[r] -= some_n
                hashes[r] -= some_h
                events.append(some_n)
                hashes.append(some_h)
                by.append(None)
                start.append(start[r] if is_left else q)
                end.append(p if is_left else end[r])
                if is_left:
                    start[r] = q
                else:
                    end[r] = p
                origin[name] = origin.get(r, r)
                kids[origin[name]].append(name)
        border_then = _border(run, first, last, m, left, right)
        for r, (from_s, to_s, count, total, who) in made.items():
            left_of = [c for c in kids[r] if start[c] >= 0]
            for c in left_of:
                by[c] = (level, from_s, None) if r not in border else None if c in border_then else (level, None, border[r])
            if r not in border:
                yield (0, level, from_s, to_s, count, new[r], len(left_of), total, *(who or (None, None, None)), None, *[None] * 14)
                continue
            record[8 + 7 * border[r]] = sum(c not in border_then for c in left_of)
            if who:
                yield (1, level, from_s, *[None] * 5, *who, None, *[None] * 14)
        done, until = upto, level
    for record in records:
        yield (2, record[0], *[None] * 9, *record[1:])


def _border(run: list, first: int, last: int, m: int, left: bool, right: bool) -> dict[int, int]:
    """Runs that touch an open side, with the side under which they are written down (one that touches both: 0)."""
    out = {}
    if first < m and last >= 0:
        if right:
            out[run[last]] = 1
        if left:
            out[run[first]] = 0
    return out


def _smaller(run: list, before: list, after: list, p: int, q: int, r: int, m: int) -> tuple[list, bool]:
    """The smaller of the two sides of a split, found by walking both in step."""
    low, high = [p], [q]
    while True:
        p = before[p]
        if p < 0 or run[p] != r:
            return low, True
        q = after[q]
        if q >= m or run[q] != r:
            return high, False
        low.append(p)
        high.append(q)


def _lists(gap: int):
    schema = _arrow(LISTED)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("entries")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = lists.flatten()
            s, b, n, h = (flat.field(i).to_pylist() for i in range(4))
            keys = zip(*(batch.column(c).to_pylist() for c in ("user", "chain", "block", "left", "right")), strict=True)
            out: list[tuple] = []
            for i, (user, chain, block, left, right) in enumerate(keys):
                at = slice(ends[i], ends[i + 1])
                out += [(user, chain, block, *x) for x in reverse(s[at], b[at], n[at], h[at], left, right, gap)]
                if len(out) >= 20_000:
                    yield _rows(out, schema)
                    out = []
            if out:
                yield _rows(out, schema)

    return task


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _sessions(x: dict[str, np.ndarray], gap: int) -> dict[str, np.ndarray]:
    """Border runs, two columns a block, put together where they are at most gap apart."""
    at = np.flatnonzero(x["there"])
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in ("start", "end", "n", "h", "batch", "new", "inner", "of", "at")}
    one = {k: x[k][at] for k in RUN}
    begins = np.append(True, one["start"][1:] - one["end"][:-1] > gap)
    cuts = np.flatnonzero(begins)
    out = {k: np.add.reduceat(one[k], cuts) for k in ("n", "h", "new", "inner")}
    return out | {"start": one["start"][cuts], "end": one["end"][np.append(cuts[1:], len(at)) - 1], "batch": np.maximum.reduceat(one["batch"], cuts), "of": np.cumsum(begins) - 1, "at": at}


RUN = ("start", "end", "n", "h", "batch", "new", "inner")


def _stitch(gap: int):
    names = [x.split()[0] for x in FOUND.split(", ")]

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """All border runs of a chain in one slice of batches; what stood before the slice is there to start from."""
        user, chain, _ = (int(x) for x in key)
        blocks, place = np.unique(rows["block"].to_numpy(), return_inverse=True)
        level, lowest = rows["batch"].to_numpy(), int(rows["lowest"].iloc[0])
        there = rows[["l_start", "r_start"]].notna().to_numpy()
        runs = {k: rows[[f"l_{k}", f"r_{k}"]].fillna(0).to_numpy(np.int64) for k in RUN}
        now = {k: np.zeros((len(blocks), 2), np.int64) for k in RUN} | {"there": np.zeros((len(blocks), 2), bool)}
        order, out = np.lexsort((place, level)), []
        cuts = np.flatnonzero(np.append(True, np.diff(level[order]) > 0))
        flat = lambda: {k: v.reshape(-1) for k, v in now.items()}
        was = None
        for i, j in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            at, b = order[i:j], int(level[order[i]])
            if b >= lowest and was is None:
                was = _sessions(flat(), gap)
            now["there"][place[at]] = there[at]
            for k in RUN:
                now[k][place[at]] = runs[k][at]
            if b >= lowest:
                got = _sessions(flat(), gap)
                for k in np.flatnonzero(got["new"]):
                    from_s = int(got["start"][k])
                    low, high = np.searchsorted(was["start"], from_s, "left"), np.searchsorted(was["start"], got["end"][k], "right")
                    out.append((user, chain, None, 0, b, from_s, *(int(got[x][k]) for x in ("end", "n", "new")), int(got["inner"][k]) + int(high - low), int(got["h"][k]), None, None, None))
                    out += [(user, chain, None, 1, int(was["batch"][x]), int(was["start"][x]), *[None] * 5, b, from_s, None) for x in range(low, high)]
                for x in np.flatnonzero(now["inner"].reshape(-1)[got["at"]]):
                    block, side = divmod(int(got["at"][x]), 2)
                    out.append((user, chain, int(blocks[block]), 3, b, int(got["start"][got["of"][x]]), *[None] * 7, side))
                was = got
            for k in ("new", "inner"):
                now[k][place[at]] = 0
        return pd.DataFrame({c: pd.array(v, "Int64") for c, v in zip(names, zip(*out, strict=True), strict=True)} if out else {c: pd.array([], "Int64") for c in names})

    return task


def versions(events: DataFrame, gap: int = GAP, block: int = BLOCK) -> DataFrame:
    """events (user, second, batch, weight: long) to one row per version of a session: user, batch, start_s, end_s, n_events, n_new,
    n_retracted, h_sum (of the weights), retracted_batch and retracted_start_s (null if final)."""
    if block <= gap:
        raise ValueError("a block has to be longer than the gap")
    ready(events.sparkSession)
    e = events.filter("user is not null and second is not null and batch is not null")
    e = e.groupBy("user", "second", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("h"))
    e = cut(e.withColumn("block", F.expr(f"(second - pmod(second, {block})) div {block}")))
    # where blocks lie, and whether their neighbours are near: a row a block (merge: none of these tables is broadcast)
    lies = e.groupBy("user", "block").agg(F.min("second").alias("low"), F.max("second").alias("high"), F.min("batch").alias("batch_low"), F.max("batch").alias("batch_high"))
    by_block = W.partitionBy("user").orderBy("block")
    lies = lies.withColumns({"left": F.coalesce(F.col("low") - F.lag("high").over(by_block) <= gap, F.lit(False)), "right": F.coalesce(F.lead("low").over(by_block) - F.col("high") <= gap, F.lit(False))})
    lies = lies.withColumn("chain", F.last(F.when(~F.col("left"), F.col("block")), True).over(by_block))
    entries = e.groupBy("user", "block").agg(F.sort_array(F.collect_list(F.struct("second", "batch", "n", "h"))).alias("entries"))
    entries = entries.join(lies.select("user", "block", "chain", "left", "right").hint("merge"), ["user", "block"]).select("user", "chain", "block", "left", "right", "entries")
    found = cut(entries.mapInArrow(_lists(gap), LISTED))
    # chains of several blocks; those of one are done, their versions know who retracts them
    chains = lies.filter(F.col("left") | F.col("right")).groupBy("user", "chain").agg(F.count(F.lit(1)).alias("blocks"), F.min("batch_low").alias("low"), F.max("batch_high").alias("high"))
    runs = found.filter("kind = 2").join(chains.hint("merge"), ["user", "chain"])
    slices = F.least(F.lit(SLICES), F.greatest(F.lit(1), F.floor(F.col("blocks") / 16)))
    runs = runs.withColumn("wide", F.floor((F.col("high") - F.col("low")) / slices) + 1)
    # a record is needed up to the slice of the next one, which sees what stood before
    place = lambda c: F.expr(f"({c} - low) div wide")
    runs = runs.withColumn("upto", F.coalesce("until", "high")).withColumn("slice", F.explode(F.sequence(place("batch"), place("upto"))))
    runs = runs.withColumn("lowest", F.col("low") + F.col("slice") * F.col("wide")).select("user", "chain", "slice", "lowest", "block", "batch", *RUNS)
    stitched = cut(runs.groupBy("user", "chain", "slice").applyInPandas(_stitch(gap), FOUND), share=4)
    open_rows = found.filter("kind < 2").join(chains.select("user", "chain", F.lit(True).alias("open")).hint("merge"), ["user", "chain"], "left")
    columns = [x.split()[0] for x in FOUND.split(", ")]
    closed = open_rows.filter("open is null").select(columns)
    starts = stitched.filter("kind = 3").select("user", "block", F.col("batch").alias("by_batch"), "by_side", F.col("start_s").alias("by_run"))
    inner = open_rows.filter("open").join(starts.hint("merge"), ["user", "block", "by_batch", "by_side"], "left").withColumn("by_start", F.coalesce("by_start", "by_run")).select(columns)
    both = inner.unionByName(stitched.filter("kind < 2"))
    rest = ("end_s", "n_events", "n_new", "n_retracted", "h_sum", "by_batch", "by_start")
    both = both.groupBy("user", "batch", "start_s").agg(*[F.max(c).alias(c) for c in rest])
    out = closed.select("user", "batch", "start_s", *rest).unionByName(both)
    return out.select("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", F.col("by_batch").alias("retracted_batch"), F.col("by_start").alias("retracted_start_s"))


def crc(text: Column) -> Column:
    return F.crc32(F.encode(text, "utf-8"))


def events(turns: DataFrame) -> DataFrame:
    """Rows of conversations with a turn as events: user, second, batch of arrival and weight, all drawn from crc32."""
    t = turns.filter("turn is not null and conv_id is not null").select(F.col("conv_id").cast("long").alias("i"), F.col("turn").cast("long").alias("turn"))
    t = t.withColumns({"c": crc(F.col("i").cast("string")), "h": crc(F.concat_ws(":", F.col("i").cast("string"), F.col("turn").cast("string")))})
    t = t.withColumn("second", F.expr("c div 2 % 7200 + 300 * turn + h % 600")).withColumn("g", F.expr("h div 600"))
    batch = F.expr("(second - pmod(second, 900)) div 900 + if(g % 5 = 0, g % 4, 0)")
    return t.select(F.expr("2 * ((i - pmod(i, 8)) div 8) + c % 2").alias("user"), "second", batch.alias("batch"), F.col("h").alias("weight"))


def session_versions(turns: DataFrame) -> DataFrame:
    """op12: every version of every session of the conversations' events."""
    return versions(events(turns))


#: SQL for the rows of session_versions(): the sessions after every batch anew.
SQL = rf"""
WITH crc AS ({CRC_TABLE}),
k AS (SELECT conv_id, turn, conv_id::VARCHAR AS k, conv_id::VARCHAR || ':' || turn::VARCHAR AS l FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
x AS (SELECT conv_id, turn, {crc_sql("k")} AS c, {crc_sql("l")} AS h FROM k, crc),
y AS (SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM x),
e AS (SELECT u, s, h, floor(s / 900)::BIGINT + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS b FROM y),
a AS (SELECT l.u, l.b AS level, e.s, e.b, e.h FROM (SELECT DISTINCT u, b FROM e) l JOIN e ON e.u = l.u AND e.b <= l.b),
f AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY u, level ORDER BY s) <= 600 THEN 0 ELSE 1 END AS fresh FROM a),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY u, level ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM f),
v AS (SELECT u, level AS batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (WHERE b = level) AS n_new, sum(h)::BIGINT AS h_sum
      FROM n GROUP BY u, level, k HAVING count(*) FILTER (WHERE b = level) > 0),
r AS (SELECT v.u, v.batch, v.start_s, min(w.batch) AS retracted_batch, min_by(w.start_s, w.batch) AS retracted_start_s
      FROM v LEFT JOIN v w ON w.u = v.u AND w.batch > v.batch AND v.start_s BETWEEN w.start_s AND w.end_s GROUP BY ALL)
SELECT v.u AS "user", v.batch, v.start_s, v.end_s, v.n_events, v.n_new, coalesce(q.n, 0) AS n_retracted, v.h_sum, r.retracted_batch, r.retracted_start_s
FROM v JOIN r ON r.u = v.u AND r.batch = v.batch AND r.start_s = v.start_s
LEFT JOIN (SELECT u, retracted_batch AS batch, retracted_start_s AS start_s, count(*) AS n FROM r GROUP BY ALL) q ON q.u = v.u AND q.batch = v.batch AND q.start_s = v.start_s
"""
