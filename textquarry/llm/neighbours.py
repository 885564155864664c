"""Approximate nearest neighbours by cosine: inverted lists and an adaptive scan of dimensions.

Index: k-means on a sample of at most SAMPLE vectors (bounded, the only thing fitted on a sample) gives about sqrt(n)
lists, LISTS at most; every vector goes to its nearest list. How many lists a query probes is measured, not set: the exact neighbours of at most CALIBRATE
queries, found by brute force over all rows, say how far down the order of lists neighbours lie, and the least number
that reaches RECALL of them is taken (all lists, if it must be).

Scan: lists are put in blocks of a bounded size (small ones together, a hot one in parts by a hash of the id), and queries in
blocks as well, so that no task gets more than one block of each. There vectors of length 1 are rotated by a random orthogonal matrix and
read in column blocks. After d of D columns the partial squared distance times D / d estimates the whole; a pair is abandoned when
the estimate exceeds (1 + EPSILON / sqrt(d)) squared times the distance of the query's k-th neighbour so far. The list nearest to the query is
scanned first, so that the others begin with a bound. What survives all columns is scored on the original vectors in double precision.

Defined results: rows without an id, and vectors that are null, empty, zero, or hold null or non-finite components, take no part.
Vectors meet only vectors of their own length. An id that repeats stands once in a result, with its best score, and never meets itself. Ties go to the smaller id; an id has
all other ids as neighbours if there are no more than k. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, free, partitions, ready

SAMPLE, LISTS, CALIBRATE, RECALL = 16_384, 1_024, 256, 0.98
#: Numbers of a block of candidates, and of queries, at most (64 MB as doubles).
BLOCK = 1 << 23
#: Columns read at a time; how many standard deviations a hypothesis is given; pairs held at once.
COLUMNS, EPSILON, PAIRS = 16, 2.1, 1 << 18
SLACK = 1e-9


def vectors(col: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Usable vectors by length: their rows, the vectors (times a power of two, so that no square overflows) and the same at length 1."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start, out = np.cumsum(size) - size, []
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        usable = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        rows, x = rows[usable], x[usable]
        if len(rows):
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
            out.append((rows, x, x / _norm(x)[:, None]))
    return out


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


@functools.lru_cache(4)
def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most k centres of unit vectors."""
    centres = x[np.random.default_rng(len(x)).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _order(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def _order(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The nearest centres of each vector, nearest first, ties to the smaller number."""
    out = np.empty((len(x), min(most, len(centres))), np.int32)
    for i in range(0, len(x), 4096):
        far = 0.5 * (centres * centres).sum(axis=1) - x[i : i + 4096] @ centres.T
        out[i : i + 4096] = far.argmin(axis=1)[:, None] if most == 1 else np.argsort(far, axis=1, kind="stable")[:, :most]
    return out


class Lists:
    """Centres by length of vector. A length that the sample does not have is one list, numbered -length."""

    def __init__(self, sample: pa.Table, total: int) -> None:
        self.centres: dict[int, tuple[int, np.ndarray]] = {}
        base = 0
        for _, _, unit in vectors(sample["vector"]):
            share = len(unit) / max(1, len(sample))
            centres = kmeans(unit, int(min(LISTS, max(1, round((share * total) ** 0.5)), len(unit))))
            self.centres[unit.shape[1]] = base, centres
            base += len(centres)

    def order(self, unit: np.ndarray, most: int) -> np.ndarray:
        base, centres = self.centres.get(unit.shape[1], (0, None))
        return np.full((len(unit), 1), -unit.shape[1], np.int32) if centres is None else base + _order(unit, centres, most)


def build(table: DataFrame) -> tuple[DataFrame, Lists]:
    """Every usable row with its list, as a written table (vec_id, vector, list), and the lists."""
    spark = table.sparkSession
    total = table.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = table.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE).toArrow()
    lists = Lists(sample, total)
    sent = spark.sparkContext.broadcast(lists)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, unit in vectors(batch.column("vector")):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("vector").take(at), pa.array(sent.value.order(unit, 1)[:, 0])], names=["vec_id", "vector", "list"])

    kind = table.schema["vector"].dataType.simpleString()
    return cut(table.mapInArrow(task, f"vec_id long, vector {kind}, list int")), lists


def probes(index: DataFrame, lists: Lists, queries: DataFrame, k: int) -> int:
    """How many lists a query has to probe for RECALL of its k neighbours: measured on a bounded number of queries against all rows."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATE).toArrow()
    asked = {unit.shape[1]: (np.asarray(some["vec_id"])[rows], unit, lists.order(unit, LISTS)) for rows, _, unit in vectors(some["vector"])} if len(some) else {}
    sent = index.sparkSession.sparkContext.broadcast({d: x[:2] for d, x in asked.items()})

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, name = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy()
            for rows, _, unit in vectors(batch.column("vector")):
                if unit.shape[1] in sent.value:
                    own, q = sent.value[unit.shape[1]]
                    score = q @ unit.T
                    score[own[:, None] == ids[rows][None, :]] = -2
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    at = np.repeat(np.arange(len(q)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), unit.shape[1])), pa.array(at), pa.array(np.take_along_axis(score, best, 1).ravel()), pa.array(name[rows][best].ravel())], names=["d", "q", "score", "list"])

    ranked = index.mapInArrow(task, "d long, q long, score double, list int").filter("score > -2")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("d", "q").orderBy(F.desc("score"), "list"))).filter(F.col("rank") <= k)
    places = [int(np.flatnonzero(asked[r.d][2][r.q] == r.list)[0]) for r in ranked.collect()]
    return int(np.quantile(places, RECALL, method="higher")) + 1 if places else 1


def adaptive(q: np.ndarray, c: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rotated unit vectors (rows of q, rows of c) that no hypothesis test abandons. bound: squared distance of each query's k-th neighbour so far."""
    d = q.shape[1]
    alive = np.ones((len(q), len(c)), bool)
    partial = np.zeros((len(q), len(c)))
    at = None
    for i in range(0, d, COLUMNS):
        a, b = q[:, i : i + COLUMNS], c[:, i : i + COLUMNS]
        seen = min(d, i + COLUMNS)
        limit = bound * (seen / d) * ((1 + EPSILON / seen**0.5) ** 2 if seen < d else 1) + SLACK
        if at is None:
            partial += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            alive &= partial <= limit[:, None]
            if alive.mean() < 0.2:
                at = np.nonzero(alive)
                far = partial[at]
        else:
            far = far + ((a[at[0]] - b[at[1]]) ** 2).sum(axis=1)
            keep = far <= limit[at[0]]
            at, far = (at[0][keep], at[1][keep]), far[keep]
    return at if at is not None else np.nonzero(alive)


class _Best:
    """The k best candidates of each query so far."""

    def __init__(self, ids: np.ndarray, bound: np.ndarray, k: int) -> None:
        self.ids, self.k, self.start = ids, k, bound
        self.q, self.c, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bound = bound.copy()

    def add(self, q: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
        other = self.ids[q] != c
        q, c, score = (np.concatenate([x, y[other]]) for x, y in ((self.q, q), (self.c, c), (self.score, score)))
        order = np.lexsort((-score, c, q))
        q, c, score = q[order], c[order], score[order]
        first = np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1]))[: len(q)]
        q, c, score = q[first], c[first], score[first]
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = rank < self.k
        self.q, self.c, self.score = q[keep], c[keep], score[keep]
        last = rank[keep] == self.k - 1
        self.bound[self.q[last]] = np.minimum(self.start[self.q[last]], 2 - 2 * self.score[last])


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _scan(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def task(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(candidates) and len(queries):
            of = {x[1].shape[1]: x for x in vectors(candidates["vector"])}
            for rows, raw, unit in vectors(queries["vector"]):
                if unit.shape[1] in of:
                    out.append(_block(k, queries, rows, raw, unit, candidates, *of[unit.shape[1]]))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return task


def _block(k: int, queries: pa.Table, q_rows: np.ndarray, q_raw: np.ndarray, q: np.ndarray, candidates: pa.Table, c_rows: np.ndarray, c_raw: np.ndarray, c: np.ndarray) -> pa.Table:
    turn = rotation(q.shape[1])
    q, c = q @ turn, c @ turn
    c_ids, c_list = candidates["vec_id"].to_numpy()[c_rows], candidates["list"].to_numpy()[c_rows]
    bound = queries["bound"].to_numpy()[q_rows]
    best = _Best(queries["query_id"].to_numpy()[q_rows], np.where(np.isnan(bound), np.inf, 2 - 2 * bound), k)
    q_norm, c_norm = _norm(q_raw), _norm(c_raw)
    asked = queries["lists"].combine_chunks().take(pa.array(q_rows))
    who, name = np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
    step = 512
    for one in np.unique(c_list):
        mine, here = who[name == one], np.flatnonzero(c_list == one)
        for i in range(0, len(mine), PAIRS // step):
            some = mine[i : i + PAIRS // step]
            for j in range(0, len(here), step):
                near = here[j : j + step]
                a, b = adaptive(q[some], c[near], best.bound[some])
                a, b = some[a], near[b]
                for x in range(0, len(a), 1 << 15):
                    at, to = a[x : x + (1 << 15)], b[x : x + (1 << 15)]
                    best.add(at, c_ids[to], (q_raw[at] * c_raw[to]).sum(axis=1) / (q_norm[at] * c_norm[to]))
    return pa.table([pa.array(best.ids[best.q]), pa.array(best.c), pa.array(best.score)], schema=FOUND)


def _placed(index: DataFrame, width: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Candidates with their block, and for each list the first of its blocks and how many they are."""
    spark = index.sparkSession
    counts = sorted((r["list"], r["count"]) for r in index.groupBy("list").count().collect())  # a row a list
    most = max(1, min(BLOCK // max(1, width), max(1024, sum(c for _, c in counts) // (4 * partitions(spark)))))
    place: dict[int, tuple[int, int]] = {}
    at, filled = 0, 0
    for name, n in counts:
        if n > most:
            place[name] = (at + bool(filled), -(-n // most))
            at, filled = sum(place[name]), 0
            continue
        if filled + n > most:
            at, filled = at + 1, 0
        place[name] = (at, 1)
        filled += n
    rows = spark.createDataFrame([(k, *v) for k, v in place.items()], "list int, first int, parts int")
    out = index.join(F.broadcast(rows), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    return out.select("block", "list", "vec_id", "vector"), place


def scan(candidates: DataFrame, place: dict[int, tuple[int, int]], queries: DataFrame, parts: int, k: int) -> DataFrame:
    """The k best candidates of each query (query_id, vector, lists, bound) and block that holds some of its lists."""
    kind = queries.schema["vector"].dataType.simpleString()

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, to, names = [], [], []
            for i, lists in enumerate(batch.column("lists").to_pylist()):
                by: dict[int, list[int]] = {}
                for name in lists:
                    first, n = place.get(name, (0, 0))
                    for b in range(first, first + n):
                        by.setdefault(b, []).append(name)
                row += [i] * len(by)
                to += by.keys()
                names += by.values()
            for i in range(0, len(row), 10_000):
                at = pa.array(row[i : i + 10_000], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 10_000], pa.int32()), *[batch.column(c).take(at) for c in ("query_id", "vector", "bound")], pa.array(names[i : i + 10_000], pa.list_(pa.int32()))], names=["block", "query_id", "vector", "bound", "lists"])

    asked = queries.select("query_id", "vector", "bound", "lists").mapInArrow(sent, f"block int, query_id long, vector {kind}, bound double, lists array<int>")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    copies = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return copies.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_scan(k), "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(table: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k nearest other rows of each row of table (vec_id, vector) that is_query chooses: query_id, rank, vec_id, score."""
    spark = ready(table.sparkSession)
    table = table.filter("vec_id is not null and vector is not null")
    index, lists = build(table)
    asked = index.filter(is_query)
    n = probes(index, lists, asked, k)
    sent, kind = spark.sparkContext.broadcast(lists), index.schema["vector"].dataType.simpleString()

    def ordered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, unit in vectors(batch.column("vector")):
                at, order = pa.array(rows), sent.value.order(unit, LISTS)
                flat = pa.array(order.ravel())
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * order.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("vector").take(at), pa.ListArray.from_arrays(ends, flat)], names=["query_id", "vector", "lists"])

    queries = cut(asked.select("vec_id", "vector").mapInArrow(ordered, f"query_id long, vector {kind}, lists array<int>"))
    total = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    parts = max(1, -(-total[0] * (total[1] or 1) // BLOCK))
    candidates, place = _placed(index, total[1] or 1)
    first = cut(_top(scan(candidates, place, queries.withColumns({"lists": F.slice("lists", 1, 1), "bound": F.lit(None).cast("double")}), parts, k), k))
    bounds = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(bounds, "query_id", "left")
    rest = scan(candidates, place, bounded.withColumn("lists", F.slice("lists", 2, max(0, n - 1))).filter(F.size("lists") > 0), parts, k)
    out = cut(_top(first.select("query_id", "vec_id", "score").unionByName(rest), k))
    # lists that held too few: these queries probe all
    full = out.filter(F.col("rank") == k).select("query_id")
    short = queries.join(full, "query_id", "left_anti").withColumn("bound", F.lit(None).cast("double"))
    if not short.isEmpty():
        out = _top(out.select("query_id", "vec_id", "score").unionByName(scan(candidates, place, short, parts, k)), k)
    else:
        free(index, queries)
    free(first)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """op11: the five nearest of each embedding whose vec_id is divisible by 50."""
    return search(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")), F.col("vec_id") % 50 == 0)
