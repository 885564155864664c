"""op11 against brute force: recall, exact scores, order, hard rows."""
import math

import numpy as np
import pytest

from textquarry.llm import neighbours

DATA = "/root/testdata/sf0.01/embeddings.parquet"


def brute(rows, k=5):
    """{query: [(vec_id, score)]} of (vec_id, vector) rows."""
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, a in use:
        if i % 50 == 0:
            best = {}
            for j, b in use:
                if j != i and len(a) == len(b):
                    s = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
                    best[j] = max(s, best.get(j, -2))
            for j, s in out.get(i, []):
                best[j] = max(s, best.get(j, -2))
            out[i] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def compare(got, rows, least):
    want = brute(rows)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r)
    vector = {}
    for i, v in rows:
        vector.setdefault(i, []).append(v)
    hits = total = 0
    assert set(found) == {q for q, x in want.items() if x}
    for q, rs in found.items():
        assert [r["rank"] for r in rs] == [*range(1, len(want[q]) + 1)]
        assert all(a.score > b.score - 1e-12 and (a.score - b.score > 1e-12 or a.vec_id < b.vec_id) for a, b in zip(rs, rs[1:]))
        hits += len({r.vec_id for r in rs} & {j for j, _ in want[q]})
        total += len(rs)
        known = dict(want[q])
        assert all(abs(r.score - known[r.vec_id]) < 1e-12 for r in rs if r.vec_id in known)
    assert hits >= least * total
    return hits / max(1, total)


def test_recall(spark):
    df = spark.read.parquet(DATA)
    compare(neighbours.nearest(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()], 0.9)


def test_hot_list_copies_and_ties(spark, monkeypatch):
    """A third of all rows are one vector, another third copies in small groups; small blocks split the hot list and the queries."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((200, 24)).astype(np.float32)
    rows = [(i, (base[0] if i % 3 == 0 else base[i % 200] if i % 3 == 1 else rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(3000)]
    monkeypatch.setattr(neighbours, "BLOCK", 24 * 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    compare(neighbours.nearest(df).collect(), rows, 0.97)


def test_hard_rows(spark):
    schema = "vec_id long, embedding array<double>, label int, vector string, list int, query_id long, rank int"
    vecs = {0: [1.0, 0.0], 1: [2.0, 0.0], 2: [1.0, 1.0], 3: None, 4: [], 5: [0.0, 0.0], 6: [1.0, None], 7: [math.nan, 1.0], 8: [math.inf, 1.0], 9: [1e200, 1e200], 10: [1e-300, 0.0], 50: [1.0, 2.0, 3.0], 51: [3.0, 2.0, 1.0], 100: [5.0], 150: None, 200: [-1.0, 0.5]}
    rows = [*vecs.items(), (None, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [0.0, 1.0]), (0, [1.0, 0.0]), (11, [0.9, 0.1]), (12, [0.5, 0.1])]
    got = neighbours.nearest(spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], schema)).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100, 150, 200)}
    assert by[0] == [1, 10, 11, 12, 2] and by[50] == [51] and by[100] == [] and by[150] == [] and len(by[200]) == 5
    assert all(r.score == pytest.approx(1) for r in got if r.query_id == 0 and r.vec_id in (1, 10))
    assert neighbours.nearest(spark.createDataFrame([], schema)).collect() == []


def test_adaptive_scan_abandons_early_and_loses_little():
    rng = np.random.default_rng(3)
    unit = lambda n: (x := rng.standard_normal((n, 64))) / np.linalg.norm(x, axis=1)[:, None]
    turn = neighbours.rotation(64)
    c = unit(4000)
    q = c[:50] + 0.05 * unit(50)
    q /= np.linalg.norm(q, axis=1)[:, None]
    far = 2 - 2 * q @ c.T
    bound = np.sort(far, axis=1)[:, 4]
    a, b = neighbours.adaptive(q @ turn, c @ turn, bound)
    kept = np.zeros(far.shape, bool)
    kept[a, b] = True
    near = far <= bound[:, None] + 1e-12
    assert kept[near].mean() > 0.97 and not kept[far > bound[:, None] + 1e-6].any()
