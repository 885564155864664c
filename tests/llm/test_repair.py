"""op13 against plain Python that tries every edit, row by row."""
import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from textquarry.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, present string, audit string"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            row = (turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            out[conv] += [row] * (2 if d == 3 else 1)
    return out


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
        seen.add((role, text))

    def fold(said):
        """The shortest string that can go on in the same ways; None if none can."""
        return {"": "", "s": "s", "u": "u", "su": "u", "ua": "ua", "uau": "u"}.get(said)

    @cache
    def best(i, said, inserts=0):
        found, options = [], []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", said):
                found.append((0, "", ()))
        else:
            role, text = rows[i][1:]
            extra = 5 if faults[i] == "t" else 0
            options.append(("D", 2, said, (), i + 1, 0))
            if faults[i] not in ("b", "d"):
                options.append(("K", extra, said + (role[:1] or "x"), ((role, text),), i + 1, 0))
                options += [("R", 1 + extra, said + x[0], ((x, text),), i + 1, 0) for x in ("user", "assistant")]
        if inserts < 3:
            options += [("I", 5, said + x[0], ((x, ""),), i, inserts + 1) for x in ("user", "assistant")]
        for edit, cost, to, made, *then in options:
            if fold(to) is not None:
                more, edits, after = best(then[0], fold(to), then[1])
                found.append((cost + more, edit + edits, made + after))
        return min(found, default=(10**9, "", ()))

    cost, edits, made = best(0, "")
    known = [t for t, _, _ in rows if t is not None]
    odd = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), odd, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def check(spark, rows):
    df = spark.createDataFrame([(*r, "no", "x") for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair.audits(df).collect()}
    want = {c: plain(x) for c, x in damage(rows).items()}
    assert got == want


def test_against_every_edit(spark):
    rng = random.Random(13)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ustr"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "Why? ", "end.\x0b", "ä.", "Yes.", "1 "]
    rows = [(c, rng.choice([t, t, t, rng.randrange(9), None]), rng.choice(roles), rng.choice([*texts, f"Text {t}.", f"Text {t}."])) for c in [*range(300), None] for t in range(rng.randrange(1, 11))]
    check(spark, rows)


def test_conversations_over_many_batches(spark):
    rng = random.Random(14)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, [(c, t, rng.choice(["user", "assistant"]), f"{t} {rng.choice(['.', ''])}") for c in range(5) for t in range(rng.choice([3, 120]))])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty_and_long(spark):
    assert repair.audits(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "x " * 300_000
    check(spark, [(1, 1, "user", long + "."), (1, 2, "assistant", long), (1, 3, "assistant", long + "!"), (-5, 2**40, "user", "Q?"), (-5, 3, "assistant", "A.")])


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    check(spark, [(4, turn, "user", "Gone.")])


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{data}')")
    cur = con.execute(repair.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = repair.audits(spark.read.parquet(data))
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == want
