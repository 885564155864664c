"""Document fingerprints by consistent weighted sampling.

A text is a bag of shingles of five words (all words, if it has fewer), weighted by how often they occur.
For each of SAMPLES positions every shingle s of weight w gets, from random numbers that depend on s alone,
r ~ Gamma(2,1), c ~ Gamma(2,1) and b ~ U(0,1):

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r

The shingle with the smallest ln a is the sample. Two texts share a sample with the probability of their
generalised Jaccard similarity, sum of min weights over sum of max weights. The smallest ln a stands for
(s, t), as equal pairs give equal numbers; 16 hashed bits of it are kept. The random numbers come from tables
of POOL rows drawn once from a fixed seed; two separate hashes of s choose the rows of (r, b) and of c.

A text without a word has fingerprint "" and likeness 1 to another such text, 0 to any other text.
Null text counts as empty. Equal texts have equal fingerprints. Very long texts are read whole, some shingles at a
time. An empty table gives no row. Extra columns stay in fingerprints(), which replaces one named fingerprint; edited() reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import fresh, partitions, ready

SAMPLES, POOL, WORDS = 128, 1 << 14, 5
_tables: list[tuple[np.ndarray, ...]] = []


def _random() -> tuple[np.ndarray, ...]:
    """r, b, ln c, and r (1 - b), which is all that weight one needs."""
    if not _tables:
        rng = np.random.Generator(np.random.Philox(20240607))
        r = rng.gamma(2, 1, (POOL, SAMPLES)).astype(np.float32)
        b = rng.random((POOL, SAMPLES), np.float32)
        c = np.log(rng.gamma(2, 1, (POOL, SAMPLES))).astype(np.float32)
        _tables.append((r, b, c, r * (1 - b)))
    return _tables[0]


def signature(raw: bytes) -> np.ndarray:
    """SAMPLES 16-bit samples; none for a text without a word."""
    s = hashing.text_shingles(raw, WORDS)
    if not len(s):
        return np.zeros(0, np.uint16)
    s, weight = np.unique(s, return_counts=True)
    r, b, c, first = _random()
    i, j = (s % np.uint64(POOL)).astype(np.int64), (s >> np.uint64(40)).astype(np.int64) % POOL
    low = np.full(SAMPLES, np.inf, np.float32)
    once = np.flatnonzero(weight == 1)
    for lo in range(0, len(once), 2048):
        k = once[lo : lo + 2048]
        low = np.minimum(low, (c[j[k]] - first[i[k]]).min(0))
    more = np.flatnonzero(weight > 1)
    for lo in range(0, len(more), 2048):
        k = more[lo : lo + 2048]
        rk, bk = r[i[k]], b[i[k]]
        t = np.floor(np.log(weight[k]).astype(np.float32)[:, None] / rk + bk)
        low = np.minimum(low, (c[j[k]] - rk * (t - bk) - rk).min(0))
    return (hashing.mix(low.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b)) if len(a) and len(b) else float(len(a) == len(b))


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every row's text, in hex."""
    ready(docs.sparkSession)
    (tmp,) = fresh(docs, name)

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(text)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([hexed(signature((t or "").encode("utf-8", "replace"))) for t in col], pa.string())], [*b.schema.names, tmp])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(tmp, T.StringType())])).drop(name).withColumnRenamed(tmp, name)


def _listed(numbers: list[int | None]) -> Column:
    """An array that the optimizer folds into one literal, however long."""
    return F.from_json(F.lit(json.dumps(numbers)), "array<bigint>")


def with_next(docs: DataFrame, per_partition: int = 16) -> DataFrame:
    """Rows (bucket, tail, doc_id, text) so dealt and sorted that, in a partition, each document is followed by
    the one that comes next in descending doc_id; a bucket ends with a copy of the next bucket's first document,
    marked tail, and the last bucket with a copy of the very first one. Nulls come last, rows of one doc_id in the
    order of their text's hash and text. The buckets' borders are quantiles of doc_id, a number of them that
    follows the number of partitions; a doc_id that is several quantiles at once, and null, get as many buckets by ranges of the
    text's hash (only rows alike in both stay together). Texts are shuffled once."""
    spark = docs.sparkSession
    parts = partitions(spark)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = parts * per_partition
    total, known = d.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    found = Counter(int(x) for x in d.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n))
    borders, nulls = sorted(found), max(1, -(-n * (total - known) // max(1, total)))
    # numbers of buckets, in ascending order of the documents: nulls, below the first border, and for each border its own ones, if it is hot, and those above it
    hot = [0, *[found[x] if found[x] > 1 else 0 for x in borders]]
    start = (nulls + np.arange(len(hot)) + np.cumsum(hot) - hot).tolist()
    key, at = F.col("doc_id"), F.lit(0)
    if borders:
        listed = _listed(borders)
        steps = F.sequence(F.lit(0), F.lit(len(borders).bit_length()))
        low = lambda s, _: F.when(s.lo >= s.hi, s).otherwise(F.when(F.get(listed, F.floor((s.lo + s.hi) / 2).cast("int")) <= key, F.struct(F.floor((s.lo + s.hi) / 2 + 1).cast("int").alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), F.floor((s.lo + s.hi) / 2).cast("int").alias("hi"))))
        at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi")), low).lo
    d = d.withColumn("at", at.cast("int"))
    # rows of one doc_id come by ascending hash, and buckets are read from the last to the first
    piece = lambda m: m - 1 - F.shiftright((F.shiftright("h", 33) + (1 << 30)) * m, 31)
    own, first = F.get(_listed(hot), F.col("at")), F.get(_listed(start), F.col("at"))
    is_hot = (own > 0) & (key == F.get(_listed([None, *borders]), F.col("at")))
    bucket = F.when(key.isNull(), piece(F.lit(nulls).cast("long"))).when(is_hot, first + piece(own)).otherwise(first + own)
    d = d.select("doc_id", "text", "h", bucket.cast("int").alias("bucket"))
    heads = sorted((r.bucket, r.x.doc, r.x.h) for r in d.groupBy("bucket").agg(F.min(F.struct(key.isNull().alias("none"), (-key).alias("down"), "h", key.alias("doc"))).alias("x")).collect())  # a row a bucket
    if not heads:
        return d.select("bucket", F.lit(False).alias("tail"), "doc_id", "text")
    size = start[-1] + hot[-1] + 1
    head, hashes, above = [None] * size, [None] * size, [None] * size
    for i, (b, top, h) in enumerate(heads):
        head[b], hashes[b], above[b] = top, h, heads[(i + 1) % len(heads)][0]
    of = lambda xs: F.get(_listed(xs), F.col("bucket"))
    is_head = key.eqNullSafe(of(head)) & (F.col("h") == of(hashes))
    d = d.select("doc_id", "text", "h", F.posexplode(F.array_compact(F.array(F.col("bucket"), F.when(is_head, of(above).cast("int"))))).alias("p", "bucket"))
    d = d.select("bucket", (F.col("p") == 1).alias("tail"), "doc_id", "text", "h").repartition(parts, "bucket")
    return d.sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")


def edited(docs: DataFrame) -> DataFrame:
    """op1: fingerprints of every text and of its edited text, whose last half is replaced by the next document's beginning."""
    ready(docs.sparkSession)
    kinds = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), *(T.StructField(k, T.StringType()) for k in kinds[2:5]), *(T.StructField(k, T.DoubleType()) for k in kinds[5:])])
    types = [pa.from_numpy_dtype(np.int64)] * 2 + [pa.string()] * 3 + [pa.float64()] * 2

    def run(batches):
        held = None  # bucket, doc_id, text and its signature
        for b in batches:
            types[0] = b.schema.field("doc_id").type
            rows = []
            for bucket, tail, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                sig = signature(text.encode("utf-8", "replace"))
                if held and held[0] == bucket:
                    _, before, old, own = held
                    n = len(old)
                    new = (old[: n - n // 2] + text[: n // 2]).encode("utf-8", "replace")
                    changed = signature(new)
                    rows.append((before, n, hashlib.sha256(new).hexdigest(), hexed(own), hexed(changed), likeness(own, changed), likeness(own, sig)))
                if tail:
                    held = (-1,)
                else:
                    held = (bucket, doc, text, sig)
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], kinds)

    return with_next(docs).mapInArrow(run, schema)
