"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from a hash of its code point. A trigram binds the
vectors of its letters, permuted by their place; a document bundles (adds) its trigrams, scaled to length
one; a language's prototype bundles its documents. A document gets the language whose prototype has the
largest cosine. Runs of anything but letters count as one blank, which is a symbol like the letters.

Null text, and text without a letter, gives `und` with score 0. Without any row to learn from, every
document is `und`. Repeated rows, ties (the smaller language name wins) and extra columns need no care;
very long texts are read whole, some at a time. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import crc_mod, fresh, ready, summed

DIM, UNKNOWN = 1024, "und"
#: Groups of partitions whose sums are added first.
SLOTS = 512
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code point; the same on every machine."""
    seed = hashing.mix(points.astype(np.uint64) + np.uint64(0x51ED270B))
    bits = hashing.mix(seed[:, None] ^ hashing.mix(np.arange(1, DIM // 64 + 1, dtype=np.uint64))[None, :])
    return (np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) << 1) - 1


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A vector of length one for each text (zeros without a letter), and whether it has a letter."""
    m = len(texts)
    lower = [f" {t.lower()} " for t in texts]
    cp = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(m), [len(t) for t in lower])
    letter = _is_letter()[cp]
    has = np.bincount(doc[letter], minlength=m) > 0
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    sym, doc = np.where(letter, cp, 0x20)[keep], doc[keep]
    out = np.zeros((m, DIM), np.float32)
    present, sym = np.unique(sym, return_inverse=True) if len(sym) < 4096 else _compact(sym)
    k = len(present)
    same = doc[2:] == doc[:-2]
    gram = ((sym[:-2].astype(np.int64) * k + sym[1:-1]) * k + sym[2:])[same]
    doc = doc[2:][same]
    grams, gram = np.unique(gram, return_inverse=True) if k**3 > 1 << 22 else _compact(gram, k**3)
    vec = letter_vectors(present)
    second, first = np.roll(vec, 1, axis=1), np.roll(vec, 2, axis=1)
    for lo in range(0, len(grams), 4096):  # columns of the count matrix at a time
        g = grams[lo : lo + 4096]
        here = (gram >= lo) & (gram < lo + len(g))
        bound = (first[g // (k * k)] * second[g // k % k] * vec[g % k]).astype(np.float32)
        counts = np.bincount(doc[here] * len(g) + gram[here] - lo, minlength=m * len(g)).reshape(m, len(g))
        out += counts.astype(np.float32) @ bound
    out[~has] = 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), has


def _compact(values: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Like unique with the inverse, by counting."""
    seen = np.bincount(values, minlength=most or 0) > 0
    found = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[found] = np.arange(len(found))
    return found, place[values]


def _parts(col: pa.Array, most: int = 1 << 20):
    """Texts in lists of bounded size."""
    part, total = [], 0
    for t in col.to_pylist():
        part.append(t or "")
        total += len(part[-1])
        if total >= most or len(part) >= 512:
            yield part
            part, total = [], 0
    if part:
        yield part


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Names of the languages and a prototype for each, from all rows that have both. Each partition adds up
    its documents, so that one vector per language and partition is shuffled."""
    ready(docs.sparkSession)

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names, row = np.array(b.column(1).to_pylist(), object), 0
            for part in _parts(b.column(0)):
                vec, _ = bundles(part)
                own = names[row : row + len(part)]
                for name in set(own):
                    sums[name] = sums.get(name, 0) + vec[own == name].sum(0, dtype=np.float64)
                row += len(part)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "total"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna().mapInArrow(partial, "lang string, total binary")
    rows = summed(rows, "lang", SLOTS).collect()  # one vector a language
    rows = sorted((r["lang"], np.frombuffer(bytes(r["total"]), np.float64)) for r in rows)
    rows = [(n, v / np.linalg.norm(v)) for n, v in rows if v.any()]
    return [n for n, _ in rows], np.array([v for _, v in rows], np.float32).reshape(len(rows), DIM)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Add lang_pred and score (the cosine, not below 0) to every row."""
    spark = ready(docs.sparkSession)
    names, protos = model
    shared = spark.sparkContext.broadcast((np.array([*names, UNKNOWN], object), protos))
    a, b = fresh(docs, "lang_pred", "score")

    def run(batches):
        names, protos = shared.value
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text)
            pred, score = [], []
            for part in _parts(batch.column(at)):
                vec, has = bundles(part)
                cos = vec @ protos.T if len(protos) else np.zeros((len(part), 1), np.float32)
                best = cos.argmax(1)
                pred += names[np.where(has & bool(len(protos)), best, len(names) - 1)].tolist()
                score += np.clip(np.where(has, cos[np.arange(len(part)), best], 0), 0, 1).astype(np.float64).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, a, b])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(a, T.StringType()), T.StructField(b, T.DoubleType())]))
    return out.drop("lang_pred", "score").withColumnsRenamed({a: "lang_pred", b: "score"})


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return crc_mod(doc_id, 5) == 0


def identify(docs: DataFrame) -> DataFrame:
    """op10: learn from the rows that are not held out, predict every row."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
