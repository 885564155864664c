"""JSON arrays cut into ranges against one reader per file; SQLite tables with filters seen pushed down."""
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from textquarry.sources import json_arrays, sqlite


def hostile(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "\n", " ", "a", "é", "\\\\", " ", "😀", ":"]) for _ in range(rng.randrange(12)))
    if kind == 3:
        return rng.choice([None, True, 1, -2.5, 10**12])
    if kind == 4:
        return ""
    if kind == 5:
        return [hostile(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["x", "y,", 'z"', "[", "\\"]): hostile(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("size", ["23b", "200b", "64m"])
def test_records_of_hostile_arrays(spark, tmp_path, size):
    rng = random.Random(8)
    files = {f"f{i}.json": [{"id": j, "v": hostile(rng)} for j in range(rng.choice([1, 7, 60]))] for i in range(4)}
    files |= {"empty.json": [], "one.json": {"a": [1, 2, {"b": ","}]}, "flat.json": [1, "two", None, [3, [4]], "]", "["], "nested.json": [[[1, 2], [3]], [[]], [], [[[["x,]"]]]]]}
    for i, (name, data) in enumerate(files.items()):
        text = json.dumps(data, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / name).write_text(("﻿ " if i == 1 else "  \n") + text + rng.choice(["", "\n \n"]), encoding="utf-8")
    (tmp_path / "blank.json").write_text(" \n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = json_arrays.records(spark, str(tmp_path))
        got = {}
        for r in df.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.no] = json.loads(r.value)
        want = {n: dict(enumerate(x if isinstance(x, list) else [x])) for n, x in files.items() if x}
        assert got == want
        if size == "23b":
            assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_same_columns_as_one_task(spark, tmp_path):
    rows = [{"id": i, "text": 'a "quoted\\" , [text]\n' * (i % 3), "more": {"k": [i, None]}} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    try:
        got, one = json_arrays.json_array(spark, str(tmp_path / "a.json")), spark.read.option("multiLine", True).json(str(tmp_path / "a.json"))
        assert got.schema == one.schema and sorted(got.collect()) == sorted(one.collect())
        typed = json_arrays.json_array(spark, str(tmp_path / "a.json"), "id int, more struct<k:array<int>>")
        assert sorted((r.id, r.more.k[0]) for r in typed.collect()) == [(i, i) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "memory store.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE memories (id INTEGER PRIMARY KEY AUTOINCREMENT, content TEXT NOT NULL, category TEXT, success_rate REAL DEFAULT 0.5, use_count INTEGER, raw BLOB)")
    con.execute('CREATE TABLE lessons (id INTEGER PRIMARY KEY, "the title" TEXT, verified BOOLEAN DEFAULT 0)')
    con.execute("CREATE TABLE improvements (id INTEGER PRIMARY KEY, priority INTEGER DEFAULT 5, implemented BOOLEAN DEFAULT 0)")
    con.execute("CREATE TABLE empty_one (id INTEGER PRIMARY KEY, x TEXT)")
    con.execute("CREATE TABLE loose (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    con.executemany("INSERT INTO memories (content, category, success_rate, use_count, raw) VALUES (?, ?, ?, ?, ?)", [(f"m{i} 'é'", ["code", "chat", None][i % 3], None if i % 7 == 0 else i / 10, i, bytes([i])) for i in range(50)] + [("odd", "code", "no number", "many", "text")])
    con.executemany("INSERT INTO lessons VALUES (?, ?, ?)", [(i, f"t{i}", [0, 1, None, 2][i % 4]) for i in range(-10, 30)])
    con.executemany("INSERT INTO improvements VALUES (?, ?, ?)", [(i * 1000, i % 10, i % 2) for i in range(40)])
    con.executemany("INSERT INTO loose VALUES (?, ?)", [("a", 1), ("b", None), ("c", "x")])
    con.commit()
    con.close()
    return path


def pushed(path, table, *where):
    source = sqlite.SqliteSource({"path": path, "table": table, "where": json.dumps(where)})
    reader = source.reader(source.schema())
    return reader.where, reader.values


def test_the_three_filters_are_pushed(spark, store):
    category, verified, pending = ("category", "=", "code"), ("verified", "=", True), ("implemented", "=", False)
    assert pushed(store, "memories", category) == (['"category" = ?'], ["code"])
    assert pushed(store, "lessons", verified) == (['"verified" <> 0'], [])
    assert pushed(store, "improvements", pending) == (['"implemented" = 0'], [])
    assert pushed(store, "memories", ("use_count", "=", "x")) == ([], [])
    memories = sqlite.table(spark, store, "memories", 4)
    assert memories.rdd.getNumPartitions() == 4
    assert dict(memories.dtypes) == {"id": "bigint", "content": "string", "category": "string", "success_rate": "double", "use_count": "bigint", "raw": "binary"}
    assert sqlite.table(spark, store, "memories", where=[category]).count() == 18
    assert [r.id for r in sqlite.table(spark, store, "lessons", where=[verified]).orderBy("id").collect()] == [i for i in range(-10, 30) if i % 4 in (1, 3)]
    rows = sqlite.table(spark, store, "improvements", where=[pending]).orderBy(F.desc("priority"), "id").collect()
    assert [r.id for r in rows] == [i * 1000 for i in sorted(range(0, 40, 2), key=lambda i: (-(i % 10), i))]
    # one frame, several queries: nothing of one stays for the next
    assert [memories.filter("use_count = 1").count(), memories.count(), memories.filter("use_count = 2 or id = 1").count()] == [1, 51, 2]


def test_filters_change_no_result(spark, store):
    """Every condition gives what Spark gives without pushing, values of other types included."""
    m = sqlite.table(spark, store, "memories", 3)
    all_rows = spark.createDataFrame(m.collect(), m.schema)
    for where in (("success_rate", ">", 2.25), ("success_rate", "is null", None), ("success_rate", "is not null", None), ("use_count", "<=", 7), ("category", "<>", "code"), ("use_count", "in", [1, 2, 99]), ("content", "starts with", "m1"),
                  ("content", "contains", "'é"), ("category", "is null", None), ("use_count", ">=", 2**63 - 1), ("success_rate", "=", 2), ("use_count", "<", 2.5)):
        got = sqlite.table(spark, store, "memories", 3, [where])
        assert sorted(map(str, got.collect())) == sorted(map(str, all_rows.filter(sqlite._column(*where)).collect())), where
    both = sqlite.table(spark, store, "memories", 3, [("category", "=", "chat"), ("use_count", ">", 20)])
    assert sorted(r.use_count for r in both.collect()) == [i for i in range(21, 50) if i % 3 == 1]
    odd = m.filter("content = 'odd'").first()
    assert (odd.success_rate, odd.use_count, odd.raw) == (None, None, None)


def test_hard_tables(spark, store):
    assert sqlite.table(spark, store, "empty_one").collect() == []
    assert sorted(map(tuple, sqlite.table(spark, store, "loose").collect())) == [("a", 1), ("b", None), ("c", None)]
    assert [r["the title"] for r in sqlite.table(spark, store, "lessons").filter("id = -10").collect()] == ["t-10"]
    with pytest.raises(Exception):
        sqlite.table(spark, store, "missing").collect()
