"""op1 recomputed from the tables: every fingerprint, edited text and likeness, repeated and null ids included."""
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq

from textquarry.llm import fingerprints, hashing

SCHEMA = "doc_id long, text string, bucket string, tail int, h int"


def plain(text):
    """The samples of a text, shingle by shingle."""
    weight = {}
    for s in hashing.text_shingles(text.encode(), fingerprints.WORDS).tolist():
        weight[s] = weight.get(s, 0) + 1
    if not weight:
        return np.zeros(0, np.uint16)
    r, b, c, _ = fingerprints._random()
    low = np.full(fingerprints.SAMPLES, np.inf, np.float32)
    for s, w in weight.items():
        i, j = s % fingerprints.POOL, (s >> 40) % fingerprints.POOL
        if w == 1:
            a = c[j] - r[i] * (1 - b[i])
        else:
            t = np.floor(np.float32(np.log(w)) / r[i] + b[i])
            a = c[j] - r[i] * (t - b[i]) - r[i]
        low = np.minimum(low, a)
    return (hashing.mix(low.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    hashed = [(r.doc_id, r.text, r.h) for r in df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()]
    order = sorted(hashed, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1].encode()))
    like = lambda a, b: float(np.mean(a == b)) if len(a) and len(b) else float(len(a) == len(b))
    want, known = [], {}
    sig = lambda t: known.setdefault(t, plain(t)) if t not in known else known[t]
    for (i, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1], strict=True):
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = sig(t), sig(new), sig(nxt)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), like(a, b), like(a, c)))
    got = [tuple(r) for r in fingerprints.edited(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_smallest_table(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    check(spark, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))


def test_hot_ids_are_split(spark):
    """A third of the rows have one id, a third none: both are dealt to several buckets, and every row keeps its successor."""
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 12)))
    rows = [(rng.choice([7, None, rng.randrange(-50, 900)]), rng.choice([text(), text(), None, "same words again and again and again and again"])) for _ in range(600)]
    check(spark, rows)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    dealt = [(r.bucket, r.doc_id) for r in fingerprints.with_next(df).filter("not tail").collect()]
    assert len({b for b, i in dealt if i == 7}) > 5 and len({b for b, i in dealt if i is None}) > 5


def test_few_rows(spark):
    check(spark, [(1, "one two three four five six")])
    check(spark, [(None, None), (None, None)])
    check(spark, [(3, "a b"), (3, "a b"), (3, "b a")])
