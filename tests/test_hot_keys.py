"""Operators over time for one key that has nearly all rows: equal to plain Python, and spread over many tasks."""
import datetime
import io
import random
from collections import defaultdict
from contextlib import redirect_stdout

import pytest

from textquarry.operators import arrow, learning, metrics, retrieval

START = datetime.datetime(2024, 1, 1, 22, 0)


@pytest.fixture(scope="module")
def events(spark):
    """A third key, null keys and times, repeated rows; pauses of every kind over several days."""
    rng, rows, t = random.Random(6), [], START
    for i in range(1500):
        t += datetime.timedelta(seconds=rng.choice([0, 1, 5, 20, 59, 60, 61, 300, 3599, 3600, 3601, 9000]) * rng.choice([0, 1, 1]))
        rows.append((i, rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 2, None]), t, float(i % 13)))
    rows += [(1500 + i, k, None, None) for i, k in enumerate([1, 1, None])]
    rng.shuffle(rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").repartition(3)
    for k, v in old.items():
        spark.conf.set(k, v)


def by_user(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1]].append(r)
    return out


def text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("minutes", [1, 60, 200])
def test_sessions(spark, events, minutes):
    rows, df = events
    want = []
    for u, es in by_user(rows).items():
        found = [x for x in [[t for _, _, t, _ in es if t is None]] if x]
        for t in sorted(t for _, _, t, _ in es if t is not None):
            if found and found[-1][-1] is not None and t - found[-1][-1] <= datetime.timedelta(minutes=minutes):
                found[-1].append(t)
            else:
                found.append([t])
        want += [(u, i, len(s), s[0], s[-1]) for i, s in enumerate(found, 1)]
    got = metrics.sessions(df, minutes=minutes)
    assert text(tuple(r[c] for c in ("user_id", "session", "n", "started", "ended")) for r in got.collect()) == text(want)


@pytest.mark.parametrize("seconds", [0, 60, 7200])
def test_demand(spark, events, seconds):
    rows, df = events
    want = []
    for u, es in by_user(rows).items():
        for _, _, t, _ in es:
            n = sum((x is None) if t is None else x is not None and datetime.timedelta(0) <= t - x <= datetime.timedelta(seconds=seconds) for _, _, x, _ in es)
            want.append((u, t, n))
    assert text(map(tuple, metrics.demand(df, "user_id", "ts", seconds).collect())) == text(want)


def test_running_mean(spark, events):
    rows, df = events
    want = []
    for u, es in by_user(rows).items():
        n = total = 0
        for i, _, _, v in sorted(es):
            n, total = n + (v is not None), total + (v or 0)
            want.append((u, i, total / n if n else None))
    got = {(r.user_id, r.event_id): r.running_mean for r in metrics.running_mean(df, "user_id", "event_id", "value").collect()}
    assert got == pytest.approx({(u, i): m for u, i, m in want}, nan_ok=True)


@pytest.mark.parametrize("seconds", [1, 60, 3600, 50_000, 10**7])
def test_cache(spark, events, seconds):
    rows, df = events
    want = []
    for u, es in by_user(rows).items():
        at = None
        for t in sorted(t for _, _, t, _ in es if t is not None):
            hit = at is not None and t - at < datetime.timedelta(seconds=seconds)
            at = at if hit else t
            want.append((u, t, hit))
        want += [(u, None, False) for _, _, t, _ in es if t is None]
    out = learning.ttl_cache(df, "user_id", "ts", seconds)
    assert text((r.user_id, r.ts, r.hit) for r in out.collect()) == text(want)


def test_many_tasks_are_busy(spark, events):
    _, df = events
    one = df.filter("user_id = 1 and ts is not null")
    sizes = learning.ttl_cache(one, "user_id", "ts").rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(s > 0 for s in sizes) >= 10 and max(sizes) < 400
    assert learning.ttl_cache(df.limit(0), "user_id", "ts").collect() == [] == metrics.running_mean(df.limit(0), "user_id", "event_id", "value").collect()


def test_subgraph(spark):
    rng = random.Random(1)
    edges = [(0 if rng.random() < 0.3 else rng.randrange(300), rng.randrange(300)) for _ in range(900)] + [(5, None), (None, 7)]
    e = spark.createDataFrame(edges, "src long, dst long")
    size = {}
    for depth in (0, 1, 2, 6):
        seen = {17}
        for _ in range(depth):
            seen |= {b for a, b in edges if a in seen and b is not None}
        got = retrieval.subgraph(e, 17, depth)
        assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a, b in edges if a in seen and b in seen})
        with redirect_stdout(io.StringIO()) as out:
            got.explain("formatted")
        size[depth] = out.getvalue().count("\n")
    assert size[6] <= size[2] + 2  # the plan does not grow with the depth


def test_find_code(spark, tmp_path):
    """One query over a folder, against the same steps in plain Python."""
    import hashlib

    import numpy as np

    for name, lines in {"a.py": 30, "pkg/b.ts": 12, "pkg/node_modules/c.py": 30, "d.txt": 3, "e.bin": 30, "venv/f.py": 9}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\n".join(f"def f{i}(): return {i}" if i % 8 == 0 else f"  x{i} = {name!r}" for i in range(lines)))
    embed = lambda t: np.array([hashlib.sha256(t.encode()).digest()[i % 32] / 255 for i in range(256)])
    q, want = embed("what is x"), []
    for name, lang in (("a.py", "python"), ("pkg/b.ts", "typescript")):
        for first, last, content in arrow.chunks_of((tmp_path / name).read_text()):
            v = embed(content)
            want.append((-round(float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q) + 1e-8)), 6), name, lang, first, last, content))
    got = arrow.find_code(spark, str(tmp_path), "what is x", 3)
    assert [(-r.score, r.path.split(str(tmp_path) + "/")[1], r.language, r.start_line, r.end_line, r.content) for r in got.collect()] == sorted(want)[:3] and len(want) > 3
