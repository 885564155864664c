"""Tables against tables without a nested loop: many words in many texts (JOIN-07), many query vectors against many vectors
(JOIN-04, VEC-01, JOIN-12).

One side is small in most uses. It is measured first: up to a bound in bytes it is broadcast and the other side is read where
it lies; beyond the bound both sides are cut into blocks of bounded size, and each block of the one meets each block of the other in a
task of its own. Results are the same either way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of words that one automaton is built of (it takes about fifty times as much), and of texts that meet it in one task.
WORDS, TEXTS = 4 << 20, 64 << 20
#: Numbers of the query vectors that are broadcast, and of a block of vectors (8 bytes each).
QUERIES, VECTORS = 1 << 20, 1 << 23
_built: dict[str, tuple] = {}


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class _Words:
    """An Aho-Corasick automaton of words in lower case; several words may be alike in lower case. The empty word is everywhere."""

    def __init__(self, lower: list[str]) -> None:
        import ahocorasick

        self.automaton, places = ahocorasick.Automaton(), {}
        for i, w in enumerate(lower):
            places.setdefault(w, []).append(i)
        self.everywhere = places.pop("", [])
        for w, at in places.items():
            self.automaton.add_word(w, at)
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def found(self, texts: list[str]) -> list[int]:
        """The words that occur in any of the texts."""
        out = set(self.everywhere)
        if self.any:
            for t in texts:
                for _, at in self.automaton.iter(t):
                    out.update(at)
        return sorted(out)


def _match(rows: pa.RecordBatch | pa.Table, words: _Words, names: pa.Array, low: list[str], out: str) -> pa.Table:
    at: list[int] = []
    hits: list[int] = []
    for i, texts in enumerate(zip(*(rows.column(c).to_pylist() for c in low), strict=True)):
        some = words.found([t for t in texts if t])
        at += [i] * len(some)
        hits += some
    kept = rows.select([c for c in rows.schema.names if c not in low]).take(pa.array(at, pa.int64()))
    table = pa.Table.from_batches([kept]) if isinstance(kept, pa.RecordBatch) else kept
    return table.append_column(out, names.take(pa.array(hits, pa.int64())))


def find_words(texts: DataFrame, words: DataFrame, word: str, *columns: str, out: str = "task", most: int = WORDS, slice_bytes: int = TEXTS) -> DataFrame:
    """JOIN-07: each row of texts with each distinct word that one of its columns contains, upper and lower case alike, as column `out`
    (which takes the place of one of that name). Null words and texts hold nothing; an empty word is in every row. One pass of
    an automaton over a text finds all words of a part; words of more than `most` bytes make several parts."""
    spark = texts.sparkSession
    texts = texts.drop(out)
    names = words.select(F.col(word).cast("string").alias("w")).filter("w is not null").distinct().withColumn("l", F.lower("w"))
    size = names.agg(F.coalesce(F.sum(F.octet_length("l") + 8), F.lit(0)), F.count("*")).first()
    low = [_fresh(texts, f"_low{i}") for i in range(len(columns))]
    rows = texts.withColumns({n: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for n, c in zip(low, columns, strict=True)})
    schema = T.StructType([*texts.schema.fields, T.StructField(out, T.StringType())])
    if size[0] <= most:
        got = names.collect()  # at most `most` bytes
        sent, token = spark.sparkContext.broadcast([(r.w, r.l) for r in got]), uuid.uuid4().hex

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if token not in _built:
                _built.clear()
                _built[token] = _Words([x for _, x in sent.value]), pa.array([w for w, _ in sent.value], pa.string())
            for batch in batches:
                yield from _match(batch, *_built[token], low, out).to_batches()

        return rows.mapInArrow(scan, schema)
    parts = -(-size[0] // most)
    total = rows.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in low), F.lit(8))), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_bytes))
    part, piece = _fresh(rows, "_part"), _fresh(rows, "_slice")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = names.withColumn(part, F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int")).withColumn(piece, every(slices))
    rows = rows.withColumn(piece, F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int")).withColumn(part, every(parts))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.drop_columns([part, piece])
        return _match(a, _Words(b["l"].to_pylist()), b["w"].combine_chunks().cast(pa.string()), low, out)

    return rows.groupBy(part, piece).cogroup(names.groupBy(part, piece)).applyInArrow(meet, schema)


def _matrix(col: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors without null components by length: their rows and values."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    bad = np.append(0, np.cumsum(flat.is_null(nan_is_null=True).to_numpy(zero_copy_only=False)))
    value = flat.cast(pa.float64()).fill_null(0.0).to_numpy()
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    usable = (size > 0) & (bad[start + np.maximum(size, 0)] == bad[start])
    out = {}
    for d in np.unique(size[usable]):
        rows = np.flatnonzero(usable & (size == d))
        out[int(d)] = rows, value[start[rows][:, None] + np.arange(d)]
    return out


class _Heaps:
    """The k best rows of each query: larger score first, then smaller key."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray]], key: str, vector: str, k: int, least: float) -> None:
        self.queries, self.key, self.vector, self.k, self.least = queries, key, vector, k, least
        self.q, self.score, self.rows = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, rows: pa.Table) -> None:
        for d, (at, x) in _matrix(rows[self.vector]).items():
            if d not in self.queries:
                continue
            who, q = self.queries[d]
            norm, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for j in range(0, len(x), 8192):
                y, part = x[j : j + 8192], norm[j : j + 8192]
                pairs = []
                for i in range(0, len(q), 512):
                    near = q[i : i + 512] @ y.T / (own[i : i + 512, None] * part + 1e-8)
                    floor = np.full(len(near), self.least)
                    if self.k < len(y):
                        floor = np.maximum(floor, np.partition(near, len(y) - self.k, axis=1)[:, len(y) - self.k])
                    a, b = np.nonzero(near >= floor[:, None] - 2e-6)
                    pairs.append((a + i, b))
                a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
                score = np.round((q[a] * y[b]).sum(axis=1) / (own[a] * part[b] + 1e-8), 6)
                good = score >= self.least
                self._merge(who[a[good]], score[good], rows.take(pa.array(at[j + b[good]])))

    def _merge(self, q: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
        rows = rows.drop_columns([self.vector])
        if self.rows is not None:
            q, score, rows = np.concatenate([self.q, q]), np.concatenate([self.score, score]), pa.concat_tables([self.rows, rows])
        place = np.empty(len(q), np.int64)
        place[pc.sort_indices(rows[self.key], null_placement="at_start").to_numpy()] = np.arange(len(q))
        order = np.lexsort((place, -score, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order], "left")
        keep = order[rank < self.k]
        self.q, self.score, self.rows = q[keep], score[keep], rows.take(pa.array(keep)).combine_chunks()

    def result(self, names: pa.Array, name: str, out: str) -> pa.Table | None:
        if self.rows is None:
            return None
        return self.rows.add_column(0, name, names.take(pa.array(self.q))).append_column(out, pa.array(self.score))


def top_k_many(queries: DataFrame, vectors: DataFrame, query: str, key: str, k: int, least: float = -1.0, query_vector: str = "vector", vector: str = "embedding", carry: tuple[str, ...] = (), most: int = QUERIES, block: int = VECTORS) -> DataFrame:
    """JOIN-04, TOP-02, VEC-01 for a table of queries: (query, key, *carry, score, rank), the k rows of vectors with the largest
    cosine to each query, rounded to 6 places, of at least `least`; ties go to the smaller key. Exact: blocks are multiplied as
    matrices, each task keeps the k best of each of its queries, and these are merged. Vectors that are null, empty or hold nulls or NaN, or that
    have another length than the query, match nothing; a query without a match has no row."""
    spark = vectors.sparkSession
    asked = queries.select(F.col(query).alias("_name"), F.col(query_vector).cast("array<double>").alias("_q")).filter("_q is not null")
    found = vectors.select(key, *carry, F.col(vector).alias("_v")).filter("_v is not null")
    kinds = dict(zip(vectors.columns, vectors.schema.fields, strict=True))
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), *[T.StructField(c, kinds[c].dataType) for c in (key, *carry)], T.StructField("score", T.DoubleType())])
    empty = lambda: iter(())
    size = asked.agg(F.coalesce(F.sum(F.size("_q")), F.lit(0))).first()[0]
    if size <= most:
        got = asked.toArrow()  # at most `most` numbers
        sent = spark.sparkContext.broadcast((got["_name"].combine_chunks(), _matrix(got["_q"])))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            heaps = _Heaps(q, key, "_v", k, least)
            for batch in batches:
                heaps.add(pa.Table.from_batches([batch]))
            out = heaps.result(names, query, "score")
            yield from out.to_batches() if out is not None else empty()

        best = found.mapInArrow(scan, schema)
    else:
        numbers = found.agg(F.coalesce(F.sum(F.size("_v")), F.lit(0))).first()[0]
        q_parts, v_parts = -(-size // most), max(1, -(-numbers // block))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        part = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
        asked = asked.withColumn("_i", part(q_parts)).withColumn("_j", every(v_parts))
        found = found.withColumn("_j", part(v_parts)).withColumn("_i", every(q_parts))
        names_of = [key, *carry, "_v"]

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            heaps = _Heaps(_matrix(b["_q"]) if len(b) else {}, key, "_v", k, least)
            if len(a) and len(b):
                heaps.add(a.select(names_of))
            out = heaps.result(b["_name"].combine_chunks(), query, "score") if len(b) else None
            return out if out is not None else a.select([key, *carry])[:0].add_column(0, query, b["_name"][:0] if len(b) else pa.nulls(0)).append_column("score", pa.array([], pa.float64()))

        best = found.groupBy("_i", "_j").cogroup(asked.groupBy("_i", "_j")).applyInArrow(meet, schema)
    by = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
