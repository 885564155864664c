"""Conversation structure repair: the cheapest edits that make a conversation alternate.

The rows of a conversation, in the order of turn, role, text (nulls first), are edited so that the initials of the roles
read (s?(ua)+)?: an optional system turn, then user and assistant in turns. Keep costs 0, Rerole to the role that fits 1,
Delete 2, Insert of an empty turn 5; a truncated row that is not deleted costs 5 more; blank rows and duplicates must
be deleted. Among edits of equal cost the string of their initials that is least in ASCII order wins.

Every position of a conversation has four states: nothing yet, after system, after user, after assistant. Each state has one
role that fits next (system only by Keep at the start), so an edit's initial says where it leads, and the least string
is found by taking the least initial that is still cheapest, from the front. Conversations come sorted out of a shuffle, are put in buckets by
length (powers of two), and a bucket is a tensor with time first: costs run backwards for all its conversations at once and are kept;
the trace runs forwards over all of them at once.

Defined results: a null role or text is one space, so such a text is blank; a null turn comes first, and a null conv_id is
a conversation of its own. A role fits by its first letter as it stands (an empty or upper-case one never does, and
is reroled or deleted). Rows with the same turn go by role, then text; repeated rows are duplicates. An empty table gives no row.
Extra columns are not read. Texts are whole. The digest that the query returns runs over a conversation in its order, so a
conversation is one row and has to fit in a task; the memory of the repair is linear in its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

#: What each edit costs, and what a truncated row that stays costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Initials s, u, a, others; states: nothing yet, after s, after u, after a. NEXT: the state after the role that fits.
S, U, A, OTHER = range(4)
NEXT = np.array([2, 2, 3, 2])
KEEP = np.full((4, 4), -1)  # state by initial
KEEP[0, S], KEEP[0, U], KEEP[1, U], KEEP[3, U], KEEP[2, A] = 1, 2, 2, 2, 3
END = np.array([0, 2 * INSERT, INSERT, 0])
NEVER = 1 << 40
#: Turns of a bucket's tensor at most (a longer conversation stands alone).
TENSOR = 1 << 17
TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SCHEMA = [*[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]


def last_character(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)


def costs(initial: np.ndarray, must: np.ndarray, cut: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Backward costs (time + 1, conversations, states) of tensors with time first; n: turns of each conversation."""
    most, count = initial.shape
    out = np.empty((most + 1, count, 4), np.int64)
    out[most] = END
    states = np.arange(4)
    for t in range(most - 1, -1, -1):
        after = out[t + 1]
        stay = np.where(must[t], NEVER, np.where(cut[t], TRUNCATED, 0))[:, None]
        to = KEEP[states[None, :], initial[t][:, None]]
        keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), NEVER)
        best = np.minimum(after + DELETE, stay + np.minimum(keep, REROLE + after[:, NEXT]))
        u, a = best[:, 2], best[:, 3]
        best[:, 2], best[:, 3] = np.minimum(u, INSERT + a), np.minimum(a, INSERT + u)
        best[:, :2] = np.minimum(best[:, :2], INSERT + best[:, 2:3])
        out[t] = np.where((t < n)[:, None], best, END)
    return out


def trace(cost: np.ndarray, initial: np.ndarray, must: np.ndarray, cut: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits as (conversations, slots): initials, 0 where there is none; and the fitting role of each (2 user, 3 assistant)."""
    most, count = initial.shape
    edits, roles = np.zeros((3 * most + 2, count), np.uint8), np.zeros((3 * most + 2, count), np.int64)
    state, each = np.zeros(count, np.int64), np.arange(count)
    for t in range(most):
        here, after, live = cost[t], cost[t + 1], t < n
        for k in range(2):
            least = here[each, state]
            add = live & (least != DELETE + after[each, state]) & (least == INSERT + here[each, NEXT[state]])
            edits[3 * t + k, add] = ord("I")
            state = np.where(add, NEXT[state], state)
            roles[3 * t + k] = state
        least, stay = here[each, state], np.where(cut[t], TRUNCATED, 0)
        drop = live & (least == DELETE + after[each, state])
        to = KEEP[state, initial[t]]
        keep = live & ~drop & ~must[t] & (to >= 0) & (least == stay + after[each, np.maximum(to, 0)])
        change = live & ~drop & ~keep
        edits[3 * t + 2] = np.select([drop, keep, change], [ord("D"), ord("K"), ord("R")], 0)
        state = np.where(keep, to, np.where(change, NEXT[state], state))
        roles[3 * t + 2] = state
    for k in range(2):
        add = END[state] > 0
        edits[3 * most + k, add] = ord("I")
        state = np.where(add, NEXT[state], state)
        roles[3 * most + k] = state
    return edits.T, roles.T


def _repaired(rows: pa.Table, start: np.ndarray, n: np.ndarray, initial: np.ndarray, fault: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Cost, audit and repaired turns of the conversations at `at`, which are of one bucket."""
    most = max(1, int(n[at].max()))
    row = start[at][None, :] + np.arange(most)[:, None]
    row = np.where(np.arange(most)[:, None] < n[at][None, :], row, 0)
    tensors = initial[row] if len(initial) else np.full(row.shape, OTHER), np.isin(fault[row], (1, 2)) if len(fault) else row > 0, fault[row] == 3 if len(fault) else row > 0
    cost = costs(*tensors, n[at])
    edits, roles = trace(cost, *tensors, n[at])
    conv, slot = np.nonzero(edits)
    made = edits[conv, slot]
    ends = np.concatenate([[0], np.cumsum(np.bincount(conv, minlength=len(at)))]).astype(np.int32)
    audit = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(made))])
    total = len(rows)
    stays = made != ord("D")
    conv, slot, made = conv[stays], slot[stays], made[stays]
    own = start[at][conv] + slot // 3
    new = total + roles[conv, slot] - 2
    role = pa.concat_arrays([_one(rows["role"]), pa.array(["user", "assistant"], pa.string())]).take(pa.array(np.where(made == ord("K"), own, new)))
    text = pa.concat_arrays([_one(rows["text"]), pa.array([""], pa.string())]).take(pa.array(np.where(made == ord("I"), total, own)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(conv, minlength=len(at)))]).astype(np.int32)
    turns = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([role, text], ["role", "text"]))
    return cost[0, :, 0], audit, turns


def _one(col: pa.ChunkedArray) -> pa.Array:
    out = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return out.cast(pa.string())


def _conversations(rows: pa.Table, border: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole conversations, sorted; border: where each begins."""
    ids = _one_any(rows["conv_id"]).take(pa.array(border))
    present = rows["present"].to_numpy()
    conv = np.repeat(np.arange(len(border)), np.diff(np.append(border, len(rows))))[present]
    rows = rows.filter(pa.array(present))
    n = np.bincount(conv, minlength=len(border))
    start = np.cumsum(n) - n
    first = rows["role"].to_pandas().str.slice(0, 1)
    initial = np.select([first == "s", first == "u", first == "a"], [S, U, A], OTHER).astype(np.int64)
    last = rows["last"].to_pandas().to_numpy()
    codes = [_one(rows[c]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("role", "text")]
    same = np.unique(np.stack([conv, *codes]), axis=1, return_index=True)[1]
    again = np.ones(len(rows), bool)
    again[same] = False
    fault = np.select([last == "", again, ~np.isin(last.astype(str), [".", "!", "?"])], [1, 2, 3], 0) if len(rows) else np.zeros(0, np.int64)
    turn = rows["turn"].combine_chunks()
    known, value = turn.is_valid().to_numpy(zero_copy_only=False), turn.fill_null(0).to_numpy()
    inside = np.append(conv[1:] == conv[:-1], False)[: len(rows)]
    legal = np.zeros(len(rows), bool)
    for a, b in ((S, U), (U, A), (A, U)):
        legal[:-1] |= (initial[:-1] == a) & (initial[1:] == b)
    many = lambda x: np.bincount(conv[x], minlength=len(border))
    low, high = np.full(len(border), np.iinfo(np.int64).max), np.full(len(border), np.iinfo(np.int64).min)
    np.minimum.at(low, conv[known], value[known])
    np.maximum.at(high, conv[known], value[known])
    distinct = np.bincount(np.unique(np.stack([conv[known], value[known]]), axis=1)[0].astype(np.int64), minlength=len(border))
    any_turn = many(known) > 0
    counts = [np.where(any_turn, np.where(any_turn, high, 0) - np.where(any_turn, low, 0) + 1 - distinct, 0), *[many(fault == k) for k in (1, 2, 3)], many(inside & ~legal)]
    size = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    for bucket in np.unique(size):
        all_at = np.flatnonzero(size == bucket)
        step = max(1, TENSOR >> bucket)
        for i in range(0, len(all_at), step):
            at = all_at[i : i + step]
            cost, audit, turns = _repaired(rows, start, n, initial, fault, at)
            cols = [ids.take(pa.array(at)), *[pa.array(c[at].astype(np.int64)) for c in counts], pa.array(cost), audit, turns]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", *[k for k, _ in SCHEMA]])


def _one_any(col: pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition: a conversation may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("conv_id")
        new = bool(held) and held[-1].column("conv_id")[-1] != ids[0]
        if not new and held and ids[-1] == ids[0]:  # one long conversation goes on
            held.append(batch)
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        border = _borders(rows["conv_id"])
        if len(border) > 1:
            yield from _conversations(rows[: border[-1]], border[:-1])
        held = rows[border[-1] :].to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from _conversations(rows, _borders(rows["conv_id"]))


def _borders(ids: pa.ChunkedArray) -> np.ndarray:
    code = _one_any(ids).dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conv_id of turns (conv_id, turn, role, text): counts of gaps, faults and illegal neighbours, cost and
    audit of the cheapest edits, and repaired, an array of (role, text). Rows for which `present` is false
    only say that their conversation exists."""
    ready(turns.sparkSession)
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    rows = rows.withColumn("last", last_character(F.col("text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(n, T.LongType()) for n, k in SCHEMA if k == pa.int64()], T.StructField("audit", T.StringType()), T.StructField("repaired", T.ArrayType(TURN))])
    return rows.mapInArrow(_task, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults planted by the crc32 of `conv_id:turn` mod 20 (nulls: one space): 0 drops the row (it stays with
    present = false), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 sets the role to user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")) % 20
    out = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), d.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return out.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") != 0).alias("present"), copies.alias("copy")).drop("copy")


def audits(turns: DataFrame) -> DataFrame:
    """op13: what is found and done in the damaged conversations, with a digest of the repaired ones."""
    out = repair(damaged(turns), F.col("present"))
    lines = F.transform("repaired", lambda x: F.concat(x.role, F.lit(":"), x.text))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


#: crc32 by its rule, as DuckDB has none: a table of 256 entries, and the checksum of text column k (ASCII).
CRC_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))"


def crc_sql(k: str) -> str:
    one = "(4294967295::BIGINT)"
    return f"xor(list_reduce(list_transform(string_split({k}, ''), lambda x: ord(x)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), {one}), {one})"


#: SQL for the rows of audits(): costs backwards and edits forwards by recursion.
SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("k")} % 20 AS d FROM k, crc),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
             CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS g FROM conversations GROUP BY conv_id),
o AS (SELECT g, turn, role, text, role[1] AS x, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
             row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i
      FROM m JOIN c ON m.conv_id IS NOT DISTINCT FROM c.conv_id),
f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2
                     WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             lag(x) OVER (PARTITION BY g ORDER BY i) || x NOT IN ('su', 'ua', 'au') AS odd FROM o),
h AS (SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (WHERE fault = 1) AS blank,
             count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE odd) AS illegal
      FROM f GROUP BY g),
b AS (SELECT g, i, role, text, x, CASE fault WHEN 3 THEN 5 WHEN 0 THEN 0 ELSE 1000000 END AS stay FROM f),
e AS (
  SELECT g, n + 1 AS i, 0::BIGINT AS c0, 10::BIGINT AS c1, 5::BIGINT AS c2, 0::BIGINT AS c3 FROM h
  UNION ALL
  SELECT g, i, least(r0, 5 + least(r2, 5 + r3)), least(r1, 5 + least(r2, 5 + r3)), least(r2, 5 + r3), least(r3, 5 + r2) FROM (
    SELECT e.g, b.i, least(c0 + 2, c2 + 1 + stay, CASE x WHEN 's' THEN c1 + stay WHEN 'u' THEN c2 + stay ELSE 1000000 END) AS r0,
           least(c1 + 2, c2 + 1 + stay, CASE x WHEN 'u' THEN c2 + stay ELSE 1000000 END) AS r1,
           least(c2 + 2, c3 + 1 + stay, CASE x WHEN 'a' THEN c3 + stay ELSE 1000000 END) AS r2,
           least(c3 + 2, c2 + 1 + stay, CASE x WHEN 'u' THEN c2 + stay ELSE 1000000 END) AS r3
    FROM e JOIN b ON b.g = e.g AND b.i = e.i - 1)),
w AS (SELECT e.g, e.i, [c0, c1, c2, c3] AS c, role, text, x, coalesce(stay, 0) AS stay, role IS NULL AS past, lead([c0, c1, c2, c3]) OVER (PARTITION BY e.g ORDER BY e.i) AS a
      FROM e LEFT JOIN b ON b.g = e.g AND b.i = e.i),
p AS (
  SELECT g, 1::BIGINT AS i, 1::BIGINT AS q, '' AS audit, []::VARCHAR[] AS said, false AS over FROM h
  UNION ALL
  SELECT g, CASE WHEN act IN ('I', '') THEN i ELSE i + 1 END, CASE act WHEN 'D' THEN q WHEN '' THEN q WHEN 'K' THEN keep ELSE nq END, audit || act,
         CASE act WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, fit || ':' || text) WHEN 'I' THEN list_append(said, fit || ':') ELSE said END, act = ''
  FROM (
    SELECT *, CASE WHEN NOT past AND c[q] = 2 + a[q] THEN 'D' WHEN c[q] = 5 + c[nq] THEN 'I' WHEN past THEN ''
                   WHEN keep > 0 AND c[q] = stay + a[keep] THEN 'K' ELSE 'R' END AS act
    FROM (SELECT p.*, w.c, w.a, w.role, w.text, w.stay, w.past, CASE q WHEN 3 THEN 4 ELSE 3 END AS nq, CASE q WHEN 3 THEN 'assistant' ELSE 'user' END AS fit,
                 CASE WHEN x = 's' AND q = 1 THEN 2 WHEN x = 'u' AND q <> 3 THEN 3 WHEN x = 'a' AND q = 3 THEN 4 ELSE 0 END AS keep
          FROM p JOIN w ON w.g = p.g AND w.i = p.i WHERE NOT over)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(w.c[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN h USING (g) LEFT JOIN p ON p.g = c.g AND over LEFT JOIN w ON w.g = c.g AND w.i = 1
"""
