"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of bytes of one class (letters, digits, the same other sign), hashed into BUCKETS. Every bucket has a
sparse random index vector of +1 and -1. A token's word vector is the sum of the index vectors of the tokens within
REACH of it in all documents, scaled to length one, plus its own index vector. A document pools its tokens'
vectors into their mean and standard deviation. A network with one hidden layer, written in numpy, gives a logit;
its temperature is fitted on a fifth of the sample that the weights never saw.

The fit of the network uses at most SAMPLE labelled documents (those with the smallest hash of doc_id), none of which is
held out. Everything else covers all rows: the word vectors, which see no labels, and the scores of every whole text.

Null text is empty; a very long one is read whole, some tokens at a time; an empty text gets the score of the mean features. Labels without a quality are ignored, and a
document with conflicting labels counts as 0. Without labels of both kinds all scores are the share of label 1
(0.5 without any). Repeated rows score alike; of a labelled doc_id with several texts, the one with the smallest hash is
fitted on. Sums of contexts are whole numbers, so that no order of rows or partitions changes them. An empty table gives
no row. Extra columns stay as they are in score(), and one named score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import chunks, crc_mod, cut, fresh, partitions, ready, summed, utf8

SAMPLE, BUCKETS, DIM, SIGNS, REACH, HIDDEN, CUTOFF = 16_000, 1 << 14, 64, 4, 2, 32, 0.7
TABLE_PARTS = 16
_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 letter, 2 digit, else the sign itself
_KIND[33:] = np.arange(33, 256)
for _lo, _hi in ((65, 91), (97, 123), (128, 256)):
    _KIND[_lo:_hi] = 1
_KIND[48:58] = 2


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every token, and how many tokens each text has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    kind = _KIND[data]
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    begins[0] = True
    begins[1:n] |= kind[1:] != kind[:-1]
    begins[n] = True
    at = np.flatnonzero(begins)
    start, end = at[:-1], at[1:]
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    h = hashing.spans(hashing.prefix(data), start, end)
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.diff(np.searchsorted(start, off))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places (BUCKETS, SIGNS) and signs of the index vectors' entries."""
    h = hashing.mix(np.arange(1, BUCKETS * SIGNS + 1, dtype=np.uint64)).reshape(BUCKETS, SIGNS)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32)


def contexts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of each bucket's neighbours."""
    b, count = buckets(data, off)
    doc = np.repeat(np.arange(len(count)), count)
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for d in range(1, REACH + 1):
        same = doc[d:] == doc[:-d]
        for x, y in ((b[d:][same], b[:-d][same]), (b[:-d][same], b[d:][same])):
            for s in range(SIGNS):
                total += np.bincount(x * DIM + place[y, s], weights=sign[y, s], minlength=BUCKETS * DIM)
    return total.reshape(BUCKETS, DIM)


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """The table of word vectors: each partition adds up its texts, and the parts of the tables are summed by part."""
    most = partitions(docs.sparkSession)  # so many tables at most

    def partial(batches):
        total = np.zeros((BUCKETS, DIM))
        for b in batches:
            data, off = utf8(b.column(0))
            for i, j in chunks(off, 1 << 21):
                total += contexts(data[off[i] : off[j]], off[i : j + 1] - off[i])
        parts = np.split(total, TABLE_PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(TABLE_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "total"])

    rows = docs.select(text).coalesce(most).mapInArrow(partial, "part int, total binary")
    rows = summed(rows, "part", max(1, round(most**0.5))).collect()  # the table: a bounded size
    table = np.zeros((TABLE_PARTS, BUCKETS // TABLE_PARTS, DIM))
    for r in rows:
        table[r["part"]] = np.frombuffer(bytes(r["total"]), np.float64).reshape(-1, DIM)
    table = table.reshape(BUCKETS, DIM)
    table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    place, sign = index_vectors()
    for s in range(SIGNS):
        table[np.arange(BUCKETS), place[:, s]] += sign[:, s] / SIGNS**0.5
    return table


def pooled(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of every text; zeros for a text without tokens."""
    b, count = buckets(data, off)
    out = np.zeros((len(count), 2 * DIM), np.float32)
    ends = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero(count):
        total, square = np.zeros(DIM), np.zeros(DIM)
        for lo in range(ends[i], ends[i + 1], 4096):
            v = table[b[lo : min(lo + 4096, ends[i + 1])]]
            total += v.sum(0)
            square += np.einsum("ij,ij->j", v, v)
        mean = total / count[i]
        out[i, :DIM], out[i, DIM:] = mean, np.sqrt(np.maximum(square / count[i] - mean**2, 0))
    return out


def _pooled_batch(col: pa.Array, table: np.ndarray) -> np.ndarray:
    data, off = utf8(col)
    parts = [pooled(data[off[i] : off[j]], off[i : j + 1] - off[i], table) for i, j in chunks(off, 1 << 21)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 * DIM), np.float32)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40) -> dict:
    """Weights of the two layers (Adam on the cross entropy) and the temperature."""
    rng = np.random.default_rng(11)
    base = float(y.mean()) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return {"constant": base}
    order = rng.permutation(len(y))
    x, y = x[order], y[order]
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / std
    n = max(1, len(y) // 5)
    zt, yt, zv, yv = z[n:], y[n:], z[:n], y[:n]
    w = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for idx in np.array_split(rng.permutation(len(yt)), max(1, len(yt) // 128)):
            a, t = zt[idx], yt[idx]
            h = np.maximum(a @ w[0] + w[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t) / len(idx)
            back = np.outer(d, w[2]) * (h > 0)
            grads = [a.T @ back + 1e-3 * w[0], back.sum(0), h.T @ d + 1e-3 * w[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "std": std, "w": w, "temperature": 1.0}
    logit = _logit(model, zv)
    loss = lambda t: float(np.mean(np.logaddexp(0, np.where(yv > 0, -1, 1) * logit / t)))
    model["temperature"] = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return model


def _logit(model: dict, z: np.ndarray) -> np.ndarray:
    w = model["w"]
    return np.maximum(z @ w[0] + w[1], 0) @ w[2] + w[3]


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = (x - model["mean"]) / model["std"]
    z[~x.any(1)] = 0
    return 1 / (1 + np.exp(-np.clip(_logit(model, z) / model["temperature"], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` labelled documents that are not held out."""
    ready(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the limit bounds this side, so it may be broadcast
    found = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(cut(known)), "doc_id")
    found = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("first"))
    fitting = cut(found.select("doc_id", "first.text", "y"))
    table = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def features(batches):
        for b in batches:
            x = _pooled_batch(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = fitting.mapInArrow(features, f"doc_id {kind}, y double, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows], np.float64).reshape(len(rows), 2 * DIM)
    return {"table": table, "net": fit(x, np.array([r["y"] for r in rows]))}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add score, the calibrated probability of label 1, to every row."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    (tmp,) = fresh(docs, "score")

    def run(batches):
        for b in batches:
            x = _pooled_batch(b.column(b.schema.get_field_index(text)), shared.value["table"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probability(shared.value["net"], x.astype(np.float64)), pa.float64())], [*b.schema.names, tmp])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(tmp, T.DoubleType())]))
    return out.drop("score").withColumnRenamed(tmp, "score")


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7."""
    out = score(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
