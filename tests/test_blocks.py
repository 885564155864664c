"""Many words in many texts, and many vectors against many, held against SQL and plain Python; small and large side alike."""
import io
import random
from contextlib import redirect_stdout

import duckdb
import numpy as np
import pytest

from textquarry.operators import blocks, learning


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("most", [blocks.WORDS, 100_000])
def test_many_words(spark, most):
    """100,000 tasks: no refusal, no nested loop, equal to SQL; with a low bound in several parts and slices."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdeÉé") for _ in range(n))
    words = [word(rng.choice([4, 5, 6, 9])) for _ in range(100_000)]
    texts = [(i, " ".join(word(rng.choice([2, 5, 7])) for _ in range(rng.choice([0, 3, 40])))) for i in range(150)] + [(900, None), (901, "zz")]
    tasks = spark.createDataFrame([(w,) for w in words], "task string").repartition(4)
    lessons = spark.createDataFrame(texts, "id long, text string")
    got = blocks.find_words(lessons, tasks, "task", "text", most=most, slice_bytes=4_000)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    con = duckdb.connect()
    con.execute("create table t(task varchar); create table d(id bigint, text varchar)")
    con.executemany("insert into d values (?, ?)", texts)
    import pandas as pd

    con.register("w", pd.DataFrame({"task": words}))
    want = con.execute("select d.id, t.task from (select distinct task from w) t join d on contains(lower(coalesce(d.text, '')), lower(t.task)) order by all").fetchall()
    assert sorted((r.id, r.task) for r in got.select("id", "task").collect()) == sorted(want) and len(want) > 1000


@pytest.mark.parametrize("most", [blocks.WORDS, 5])
def test_hard_words(spark, most):
    tasks = spark.createDataFrame([("",), (None,), ("Ab",), ("aB",), ("b",), ("b",)], "name string")
    lessons = spark.createDataFrame([(1, "xAb", None, "old"), (2, None, "B", "old"), (3, "", "", None), (None, "ab", "ab", "old"), (None, "ab", "ab", "old")], "id long, text string, more string, task string")
    got = sorted((str(r.id), r.task) for r in blocks.find_words(lessons, tasks, "name", "text", "more", most=most).collect())
    assert got == sorted([("1", w) for w in ("", "Ab", "aB", "b")] + [("2", ""), ("2", "b"), ("3", "")] + [("None", w) for w in ("", "Ab", "aB", "b")] * 2)
    none = blocks.find_words(lessons, tasks.limit(0), "name", "text", most=most)
    assert none.collect() == [] and blocks.find_words(lessons.limit(0), tasks, "name", "text", most=most).collect() == []


def plain_top(queries, rows, k, least):
    out = []
    for q, x in queries:
        found = []
        for i, y in rows:
            if x and y and len(x) == len(y) and not any(v is None or v != v for v in [*x, *y]):
                a, b = np.array(x, float), np.array(y, float)
                s = round(float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()) + 1e-8)), 6)
                if s >= least:
                    found.append((-s, i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"most": 64, "block": 900}])
def test_top_k_for_many_queries(spark, bounds):
    """A third of the vectors are one vector, so that ties are cut by key; blocks of any size give the same."""
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(8)
    rows = [(i, (hot if i % 3 == 0 else rng.standard_normal(8)).tolist()) for i in range(900)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, 2.0]), (904, [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), (905, [2.0, 1.0]), (906, [float("nan"), 1.0])]
    queries = [(f"q{i}", v) for i, v in rows[::31]] + [("short", [1.0, 1.0]), ("none", None), ("zero", [0.0] * 8)]
    q = spark.createDataFrame(queries, "name string, vector array<double>")
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    for k, least in ((4, -1.0), (7, 0.5)):
        got = blocks.top_k_many(q, v, "name", "id", k, least, **bounds)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
        assert sorted(tuple(r) for r in got.select("name", "id", "score", "rank").collect()) == plain_top(queries, rows, k, least)
    assert blocks.top_k_many(q.limit(0), v, "name", "id", 3, **bounds).collect() == []
    assert blocks.top_k_many(q, v.limit(0), "name", "id", 3, **bounds).collect() == []


def test_more_than_a_thousand_options(spark):
    rng = np.random.default_rng(9)
    options = [(i, rng.standard_normal(3).tolist()) for i in range(1500)]
    memories = [(i, rng.standard_normal(3).tolist(), i % 5 / 5, i % 7) for i in range(40)]
    m = spark.createDataFrame(memories, "id long, embedding array<double>, success_rate double, use_count long")
    got = {r.option: r for r in learning.recommend(spark.createDataFrame(options, "option long, q array<double>"), m, "id", most=900, block=60).collect()}
    assert len(got) == 1500
    best = plain_top(options, [x[:2] for x in memories], 3, 0.3)
    for o, _ in options[::50]:
        mine = [memories[i] for q, i, _, _ in best if q == o]
        assert got[o].based_on == len(mine)
        assert got[o].score == pytest.approx(sum(x[2] for x in mine) / len(mine) if mine else 0.5, abs=1e-6)
        assert got[o].confidence == pytest.approx(min(1, sum(x[3] for x in mine) / 10), abs=1e-6)
