"""Hand-computed results for learning stores, project detection, caches and the registry."""
import datetime as dt

from pyspark.sql import functions as F

from textquarry.functions.registry import Operator, Registry
from textquarry.operators import learning


def test_ttl_cache(spark):
    start = dt.datetime(2024, 1, 1)
    seconds = {"a": [0, 100, 299, 300, 599, 600, 2000, 2000], "b": [5, 305, 604]}
    d = spark.createDataFrame([(k, start + dt.timedelta(seconds=s)) for k, ss in seconds.items() for s in ss], "k string, ts timestamp_ntz")
    got = sorted((r.k, r.ts, r.hit) for r in learning.ttl_cache(d, "k", "ts", 300).collect())
    want = []
    for k, ss in seconds.items():
        filled = None
        for s in ss:
            hit = filled is not None and s - filled < 300
            filled = filled if hit else s
            want.append((k, hit))
    assert [(k, h) for k, _, h in got] == want


def test_projects(spark):
    d = spark.createDataFrame([
        ("a", "pyproject.toml", "uses flask and fastapi"), ("a", "src/main.py", ""),
        ("b", "pyproject.toml", "django"), ("b", "package.json", '{"dependencies": {"react": "1"}}'), ("b", "index.js", None),
        ("c", "notes.md", "x"), ("d", "package.json", "broken {"),
    ], "project string, file string, content string")
    got = {r.project: (r.language, r.framework, r.entry_points) for r in learning.projects(d).collect()}
    assert got == {"a": ("python", "fastapi", ["src/main.py"]), "b": ("javascript", "react", ["index.js"]), "c": (None, None, []), "d": ("javascript", None, [])}


def test_markdown_sections(spark):
    d = spark.createDataFrame([(1, "### One\ndate\nbody a\nb\n### Two \nd\n" + "x" * 300), (2, None), (3, "no section")], "doc_id long, text string")
    got = [(r.title, r.content) for r in learning.markdown_sections(d, "doc_id").orderBy("place").collect()]
    assert got == [("One", "body a\nb"), ("Two", "x" * 200)]


def test_parameters_and_paths(spark):
    d = spark.createDataFrame([("Read the file src/a.py",), ("write to b.txt with content: hello",), ("commit with message done",), (None,)], "text string")
    got = [(r.path, r.read_path, r.write_path, r.content, r.message) for r in learning.request_parameters(d).collect()]
    assert got[0][:2] == ("src/a.py", "src/a.py") and got[1][2:4] == ("b.txt", "hello") and got[2][4] == "done" and got[3] == (None,) * 5
    p = spark.createDataFrame([("a/b.PY",), ("x.tsx",), ("dir.d/none",), (".bashrc",), (None,)], "p string")
    assert [r[0] for r in p.select(learning.language_of_path(F.col("p"))).collect()] == ["python", "typescript", "text", "text", "text"]


def test_schedules(spark):
    at = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(1, True, at, 24), (2, True, None, 24), (3, False, at, 1), (4, True, at, 25)], "id long, enabled boolean, last_run timestamp_ntz, interval_hours int")
    got = {r.id: (r.due, r.next_due) for r in learning.due(d, "id", "2024-01-02 00:00:00").collect()}
    assert got == {1: (True, at + dt.timedelta(days=1)), 2: (True, None), 3: (False, None), 4: (False, at + dt.timedelta(hours=25))}


def test_export_and_import(spark, tmp_path):
    d = spark.createDataFrame([(1, None), (2, "x")], "id long, name string")
    learning.export_tables({"nodes": d}, str(tmp_path))
    back = learning.import_tables(spark, str(tmp_path), {"nodes": "id long, name string"})
    assert sorted(map(tuple, back["nodes"].collect())) == sorted(map(tuple, d.collect()))


def test_reasoning(spark):
    t = "tasks array<struct<task_type:string,steps:array<struct<type:string>>,decisions:array<struct<type:string>>,success:boolean>>"
    d = spark.createDataFrame([([("x", [("a",), (None,)], None, True), ("y", [], [("d",)], None)],), (None,)], t)
    assert sorted(map(tuple, learning.reasoning_types(d).collect())) == [("decision", "d", 1), ("step", "a", 1), ("step", "unknown", 1)]
    assert sorted(map(tuple, learning.reasoning_tasks(d).collect())) == [("failure", "y", 0, 1), ("success", "x", 2, 0)]


def test_registry(spark):
    r = Registry()
    r.register(Operator("head", lambda df, n: df.limit(n), {"n": int}, ("n",)))
    r.register(Operator("fail", lambda df: df.select("nothing")))
    d = spark.range(10)
    assert r.names() == ["fail", "head"] and r.call("head", d, n=3)["data"].count() == 3
    assert r.call("head", d)["error"] == "n is missing" and "wrong type" in r.call("head", d, n="3")["error"]
    assert not r.call("none", d)["success"] and not r.call("fail", d)["success"]
    done = r.chain(d, [("head", {"n": 5}), ("head", {"n": 2})])
    assert done["data"].count() == 2 and [s["success"] for s in done["steps"]] == [True, True]
    assert not r.chain(d, [("fail", {}), ("head", {"n": 1})])["success"] and r.unregister("fail") and not r.unregister("fail")
