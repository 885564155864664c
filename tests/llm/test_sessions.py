"""op12 against sessions found anew after every batch, in plain Python and in SQL."""
import random
from collections import defaultdict

import pytest

from textquarry.llm import sessions


def plain(events, gap=600):
    """Versions of (user, second, batch, weight) rows."""
    by_user = defaultdict(list)
    for u, s, b, h in events:
        by_user[u].append((s, b, h))
    out = []
    for u, rows in by_user.items():
        rows.sort()
        standing, made = {}, []  # (start, end) -> version
        for level in sorted({b for _, b, _ in rows}):
            now, last = [], None
            for s, b, h in (r for r in rows if r[1] <= level):
                if last is None or s - last > gap:
                    now.append([])
                now[-1].append((s, b, h))
                last = s
            for x in now:
                fresh = sum(b == level for _, b, _ in x)
                if fresh:
                    a, z = x[0][0], x[-1][0]
                    gone = [k for k in standing if a <= k[0] and k[1] <= z]
                    for k in gone:
                        standing.pop(k)[8:] = [level, a]
                    standing[a, z] = v = [u, level, a, z, len(x), fresh, len(gone), sum(h for _, _, h in x), None, None]
                    made.append(v)
        out += map(tuple, made)
    return sorted(out, key=str)


def found(spark, events, **how):
    df = spark.createDataFrame(events, "user long, second long, batch long, weight long")
    return sorted((tuple(r) for r in sessions.versions(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_over_many_blocks(spark, seed):
    """Blocks hardly longer than the gap, so that nearly every session lies in several, and many slices of batches."""
    rng = random.Random(seed)
    events = []
    for user in range(60):
        wide, late = rng.choice([300, 3000, 12_000]), rng.choice([1, 5, 40])
        for _ in range(rng.choice([1, 5, 40, 120])):
            s = rng.randrange(-wide, wide)
            events.append((user, s, rng.choice([s // 300 + rng.randrange(late), rng.randrange(late)]), rng.randrange(2**32)))
    events += events[:50]
    old, sessions.SLICES = sessions.SLICES, 3
    try:
        assert found(spark, events, gap=200, block=211) == plain(events, 200)
    finally:
        sessions.SLICES = old


def test_one_user_many_blocks(spark):
    """All rows are one user's, one session in the end, in 60 blocks and several slices of batches."""
    rng = random.Random(5)
    events = [(1, s, rng.choice([s // 900, rng.randrange(80)]), s) for s in range(0, 60 * 1000, 130)]
    assert found(spark, events, block=1000) == plain(events)


def test_hard_rows(spark):
    assert found(spark, [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)]) == []
    assert found(spark, []) == []
    assert found(spark, [(1, 5, 0, 7)] * 4) == [(1, 0, 5, 5, 4, 4, 0, 28, None, None)]
    schema = "conv_id long, turn long, role string, text string, user long, batch string, extra array<int>"
    rows = [(3, 1, None, None, 9, "x", None), (3, 1, "user", "a", 9, "x", None), (None, 1, "user", "a", 9, "x", None), (3, None, "user", "a", 9, "x", None)]
    got = sessions.session_versions(spark.createDataFrame(rows, schema)).collect()
    assert [(r.n_events, r.n_retracted) for r in got] == [(2, 0)]
    assert sessions.session_versions(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError):
        sessions.versions(spark.createDataFrame([(1, 1, 1, 1)], "user long, second long, batch long, weight long"), gap=10, block=10)


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{data}')")
    cur = con.execute(sessions.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert want and sorted(str(tuple(r[n] for n in names)) for r in sessions.session_versions(spark.read.parquet(data)).collect()) == want
