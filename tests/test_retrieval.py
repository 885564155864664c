"""Retrieval for many queries: pruning by the terms' largest weights changes no result and meets few texts."""
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.functions import skew
from textquarry.operators import retrieval, texts


def vector(text):
    n = Counter(w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 2 and w not in texts.STOP_WORDS)
    size = math.sqrt(sum(x * x for x in n.values())) or 1
    return {w: x / size for w, x in n.items()}


def plain(queries, docs, k):
    out = []
    for q, t in queries:
        v = vector(t)
        found = []
        for i, d in docs:
            w = vector(d)
            if v.keys() & w.keys():
                found.append((-round(sum(x * w.get(c, 0) for c, x in v.items()), 6), i))
        out += [(q, i, -s) for s, i in sorted(found)[:k]]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """A few words are in nearly every text, many in few; a third of all texts are one text."""
    rng = random.Random(3)
    word = lambda: f"common{rng.randrange(4)}" if rng.random() < 0.6 else f"rare{int(rng.paretovariate(0.6)) % 3000}"
    docs = [(i, "common0 common1 common1 rare1" if i % 3 == 0 else " ".join(word() for _ in range(rng.choice([1, 8, 30])))) for i in range(900)]
    docs += [(900, None), (901, ""), (902, "the of")]
    queries = [(f"q{i}", " ".join(word() for _ in range(rng.choice([1, 3, 6])))) for i in range(60)] + [("none", None), ("odd", "unheard words"), ("stop", "the of")]
    return queries, docs


@pytest.mark.parametrize("k", [1, 4])
def test_equal_to_all_pairs(spark, rows, k, monkeypatch):
    queries, docs = rows
    monkeypatch.setattr(skew.join_dealt, "__defaults__", (40,))  # frequent terms are dealt
    q, d = spark.createDataFrame(queries, "q string, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, retrieval.retrieve_many(q, d, "q", k).collect())) == plain(queries, docs, k)


def test_large_side_of_terms(spark, rows, monkeypatch):
    queries, docs = rows
    monkeypatch.setattr(retrieval, "ASKED_TERMS", 3)
    q, d = spark.createDataFrame(queries[:9], "q string, text string"), spark.createDataFrame(docs[:200], "doc_id long, text string")
    assert sorted(map(tuple, retrieval.retrieve_many(q, d, "q", 2).collect())) == plain(queries[:9], docs[:200], 2)


def test_few_rows_travel(spark, rows):
    """Of the rows (query, text, term) that a join by term makes, an eighth is left where queries ask for a rare word that short texts have."""
    _, docs = rows
    seen = Counter(w for _, d in docs for w in set((d or "").split()) if w.startswith("rare"))
    short = {w for _, d in docs if d and len(d.split()) <= 8 for w in d.split()}
    some = [w for w, n in sorted(seen.items()) if n <= 9 and w in short][:40]
    queries = [(f"q{i}", f"common0 common1 common2 {w} {w} {w} {w}") for i, w in enumerate(some)]
    q, d = spark.createDataFrame(queries, "q string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    index, counts, _, terms = retrieval.asked_terms(q, d, "q", 1)
    every = terms.join(counts, "term").agg(F.sum("n")).first()[0]
    kept = terms.filter("essential").join(counts, "term").agg(F.sum("n")).first()[0]
    assert kept * 8 <= every
    assert sorted(map(tuple, retrieval.retrieve_many(q, d, "q", 1).collect())) == plain(queries, docs, 1)
    assert retrieval.retrieve_many(q.limit(0), d, "q", 1).collect() == [] and retrieval.retrieve_many(q, d.limit(0), "q", 1).collect() == []
