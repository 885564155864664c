"""Queries that SQL cannot express, against plain Python on the smallest tables; and small rules against goldens."""
import ast
import datetime
import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textquarry.operators import arrow, learning, nlp, schedule, stores, texts
from textquarry.plans import catalog

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def documents():
    t = pq.read_table(f"{DATA}/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def got(spark, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, DATA).collect())


def spans(text):
    found = [(m.end() - m.start(), m.start(), m.end(), k, m.group()) for k, p in nlp.ENTITIES.items() for m in re.finditer(p, text or "")]
    kept = []
    for f in sorted(found, key=lambda x: (-x[0], x[1], x[3])):
        if not any(f[1] < o[2] and o[1] < f[2] for o in kept):
            kept.append(f)
    return [(k, e, s, z) for _, s, z, k, e in kept]


@needs_tables
def test_entities(spark):
    want = [(i, *x) for i, t in documents() for x in spans(t)]
    assert got(spark, "entity_spans") == sorted(want) and want
    assert got(spark, "entity_summary") == sorted(Counter(x[1] for x in want).items())


@needs_tables
def test_packs(spark):
    used, pack, want = None, -1, []
    for i, t in sorted(documents()):
        n = min(len(re.split(r"\s+", t)), 2048)
        if used is None or used + 1 + n > 2048:
            pack, used = pack + 1, n
        else:
            used += 1 + n
        want.append((i, pack))
    assert got(spark, "pack_sequences") == want


@pytest.mark.parametrize(("parts", "most"), [(1, 11), (3, 11), (40, 11), (60, 300), (7, 2)])
def test_packs_over_any_partitions(spark, parts, most):
    """One pass over the whole table, whatever the partitions; lengths of 0, null, too long, and keys that repeat."""
    rng = random.Random(parts)
    rows = [(rng.choice([i, 5, None]), rng.choice([None, 0, 1, 3, 9, most, most + 50, rng.randrange(most + 1)])) for i in range(700)]
    want, used, no = [], None, -1
    for k, n in sorted(((k, min(n or 0, most)) for k, n in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        fits = used is not None and used + 1 + n <= most
        used, no = (used + 1 + n, no) if fits else (n, no + 1)
        want.append((k, no))
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = arrow.pack(spark.createDataFrame(rows, "doc_id long, n int"), most)
        assert out.rdd.getNumPartitions() == parts
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        assert arrow.pack(spark.createDataFrame([], "doc_id long, n int"), most).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def chunks(text):
    out, held, first = [], [], 1
    border = re.compile(r"^\s*(?:def|class|function|export|async|public|private|interface|fn|func)\b")
    lines = (text or "").split("\n")
    for no, line in enumerate(lines, 1):
        if held and (sum(len(x) + 1 for x in held) + len(line) > 2000 or (border.match(line) and len(held) > 5)):
            out.append((first, no - 1, "\n".join(held)))
            held, first = [], no
        held.append(line)
    out.append((first, len(lines), "\n".join(held)))
    return [x for x in out if x[1] - x[0] >= 3]


def embedding(text):
    digest = hashlib.sha256(text.encode()).digest()
    return np.array([digest[i % 32] / 255 for i in range(256)])


@needs_tables
def test_code(spark):
    want = [(i, *x) for i, t in documents() for x in chunks(t)]
    assert got(spark, "code_chunks") == sorted(want)
    q = embedding(catalog.ASK)
    cos = lambda v: float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q) + 1e-8))
    best = sorted((-round(cos(embedding(x[3])), 6), *x[:3]) for x in want)[:10]
    assert got(spark, "code_search") == sorted((*x[1:], -x[0]) for x in best)
    parsed = []
    for i, t in documents():
        try:
            nodes = list(ast.walk(ast.parse(t or "")))
            parsed.append((i, True, sum(isinstance(x, ast.ExceptHandler) and x.type is None for x in nodes), sum(isinstance(d, (ast.List, ast.Dict, ast.Set)) for x in nodes if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) for d in x.args.defaults)))
        except (SyntaxError, ValueError):
            parsed.append((i, False, 0, 0))
    assert got(spark, "code_syntax") == parsed


@needs_tables
def test_markdown(spark):
    want = []
    for i, t in documents():
        for place, m in enumerate(re.finditer(r"### (.+?)\n.*?\n(.*?)(?=### |\n?\Z)", t or "", re.S)):
            want.append((i, place, m[1].strip(), m[2].strip()[:200]))
    assert got(spark, "markdown_sections") == want
    d = spark.createDataFrame([(1, "### One\nx\nbody a\nmore\n### Two\n\nbody b\n")], "doc_id long, text string")
    assert [tuple(r) for r in learning.markdown_sections(d, "doc_id").collect()] == [(1, 0, "One", "body a\nmore"), (1, 1, "Two", "body b")]


def test_every_query_is_held_against_something():
    """SQL, or a named test in plain Python."""
    assert set(catalog.QUERIES) == set(catalog.ORACLES) | set(catalog.DONE_BY_TESTS)


def test_cron(spark):
    words = {"* * * * *": "every minute", "*/5 * * * *": "every 5 minutes", "0 * * * *": "every hour", "0 */2 * * *": "every 2 hours", "5 14 * * *": "daily at 2:05 pm", "0 0 * * *": "daily at 12:00 am", "30 6 1 7 *": "on day 1 of month 7 at 6:30", "0 9 * * 1": "weekly on Mon at 9:0", "0 9-17 * 3 2-4": "at 9-17:0"}
    words |= {"every day": None, "": None, "0 0 * * 9": "weekly on 9 at 0:0", " 7  0 * * *": "daily at 12:07 am"}
    rules = spark.createDataFrame([(k,) for k in words] + [(None,)], "rule string").select("rule", schedule.described(F.col("rule")).alias("said"))
    assert {r.rule: r.said for r in rules.collect()} == words | {None: None}
    at = datetime.datetime(2024, 2, 28, 23, 58, 30)
    d = spark.createDataFrame([(at,)], "ts timestamp_ntz")
    for rule, want in {"* * * * *": (2024, 2, 28, 23, 59), "58 23 * * *": (2024, 2, 29, 23, 58), "*/5 * * * *": (2024, 2, 29, 0, 0), "0 0 29 2 *": (2024, 2, 29, 0, 0), "15 10 * * 0": (2024, 3, 3, 10, 15), "0 12 1,15 1-6 *": (2024, 3, 1, 12, 0), "0 0 31 2 *": None}.items():
        assert d.select(schedule.next_fire(F.col("ts"), rule)).first()[0] == (want and datetime.datetime(*want))


def test_damped_weights(spark):
    models = [("a", 0.5, 2000, 1.0), ("b", 0.9, 1000, 2.0), ("c", 0.1, 4000, 1.0)]
    d = spark.createDataFrame(models, "name string, score double, examples long, overlap double")
    near = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.99), ("a", "c", 0.5)], "a string, b string, similarity double")
    w = {"a": 1.0, "b": 1.8, "c": 0.4}
    for x, y in (("a", "b"), ("b", "c")):
        mean = (w[x] + w[y]) / 2
        w[x], w[y] = w[x] * 0.7 + mean * 0.3, w[y] * 0.7 + mean * 0.3
    got = {r.name: r.weight for r in stores.damped_weights(d, near).collect()}
    assert all(abs(got[k] - v / sum(w.values())) < 1e-9 for k, v in w.items())
    # names that no model has, null names and nulls in a weight
    odd = near.union(spark.createDataFrame([("a", "zz", 0.99), (None, "b", 0.99), ("a", None, 0.99)], near.schema))
    more = d.union(spark.createDataFrame([("e", None, 1000, 1.0), (None, 0.5, 1000, 1.0)], d.schema))
    assert {r.name: r.weight for r in stores.damped_weights(more, odd).collect()} == pytest.approx({**{k: v / sum(w.values()) for k, v in w.items()}, "e": 0.0})


def test_damped_weights_of_many_models(spark):
    """More models than any cap, in components of every size: one long chain, a hub, many small ones."""
    rng = random.Random(12)
    names = [f"m{i:04}" for i in range(2500)]
    models = [(n, rng.random(), rng.randrange(5000), rng.random()) for n in names]
    pairs = {(names[i], names[i + 1]) for i in range(300)} | {(names[400], n) for n in names[401:600]} | {tuple(sorted(rng.sample(names[700:], 2))) for _ in range(700)}
    w = {n: s * e / 1000 * o for n, s, e, o in models}
    for a, b in sorted(pairs):
        mean = (w[a] + w[b]) / 2
        w[a], w[b] = w[a] + 0.3 * (mean - w[a]), w[b] + 0.3 * (mean - w[b])
    total = sum(w.values())
    d = spark.createDataFrame(models, "name string, score double, examples long, overlap double")
    near = spark.createDataFrame([(a, b, 0.95) for a, b in pairs], "a string, b string, similarity double")
    got = {r.name: r.weight for r in stores.damped_weights(d, near).collect()}
    assert got == pytest.approx({n: x / total for n, x in w.items()})
    assert stores.damped_weights(d.limit(0), near).collect() == []


def test_graph_keeps_the_ends_of_its_edges(spark):
    entities = spark.createDataFrame([(str(i), "t", i) for i in range(6)] + [("y", "late", 50), (None, "t", 0)], "id string, type string, at long")
    relations = spark.createDataFrame([("4", "x", "r", 10), ("x", "y", "r", 11), ("x", "y", "s", 12), ("q", "z", "r", 13), (None, "z", "r", 1)], "src string, dst string, type string, at long")
    nodes, edges = stores.graph_of(entities, relations, 3, 2)
    assert sorted(map(tuple, edges.collect())) == [("4", "x", "r"), ("x", "y", "s")]
    assert sorted(map(tuple, nodes.collect())) == [("0", "t"), ("1", "t"), ("2", "t"), ("4", "t"), ("x", "unknown"), ("y", "late")]


def test_entity_scores(spark):
    """With scores by kind a shorter span of a larger score wins, and what it touches goes."""
    d = spark.createDataFrame([(1, "see 'a@b.co is here' now")], "doc_id long, text string")
    kinds = lambda **how: [(r.kind, r.entity) for r in nlp.entity_spans(d, "doc_id", **how).collect()]
    assert kinds() == [("QUOTED_STRING", "'a@b.co is here'")]
    assert kinds(scores={"EMAIL": 2.0}) == [("EMAIL", "a@b.co")]
    assert kinds(scores={"QUOTED_STRING": 0.5}) == [("EMAIL", "a@b.co")]


def test_seeded_embedding(spark):
    d = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    for r in learning.seeded_embedding(d, "id").collect():
        seed = int(hashlib.sha256(("abc" if r.id == 1 else "").encode()).hexdigest(), 16) % 2**32
        assert np.allclose(r.embedding, np.random.RandomState(seed).randn(128).astype(np.float32))


def test_masks(spark):
    d = spark.createDataFrame([(["u", "assistant", "x", "tool", "y", "<pad>"],), ([f"t{i}" for i in range(10)],), ([],)], "tokens array<string>")
    assert [r.labels for r in arrow.mask_labels(d).collect()] == [[None, None, "x", None, "y", None], [None] * 7 + ["t7", "t8", "t9"], []]
    assert [r.labels for r in arrow.mask_labels(d, share=0.5).collect()][1] == [None] * 5 + [f"t{i}" for i in range(5, 10)]


def test_recursion_pattern(spark):
    d = spark.createDataFrame([("def f(n): return n * f(n - 1)",), ("def f(n): return g(n)",), (None,)], "text string")
    assert [r[0] for r in d.select(nlp.recursive(F.col("text"))).collect()] == [True, False, False]
    assert {r.pattern_type: r.n for r in nlp.mine_patterns(d).collect()}["recursion"] == 1


def test_intents(spark):
    d = spark.createDataFrame([("  Hello there!  ",), ("Write a function to calculate fibonacci",), ("zzz",)], "text string")
    rows = nlp.intents(d).collect()
    assert [r.intent for r in rows] == ["greeting", "code_request", "general"] and [r.confidence for r in rows] == [1.0] * 3
    assert all(x.confidence >= 0.3 for r in rows for x in r.alternatives) and rows[2].alternatives == []
    assert {r.intent for r in nlp.intents(d, least=1.1).collect()} == {"general"}


def test_terms(spark):
    d = spark.createDataFrame([(1, "river stone river"), (2, ""), (3, None), (1, "stone")], "doc_id long, text string")
    assert sorted((r.doc_id, r.term, r.tf) for r in texts.term_vectors(d).collect()) == [(1, "river", 2), (1, "stone", 1), (1, "stone", 1)]
