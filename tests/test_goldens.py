"""Hand-computed results for quirks and for operators that SQL cannot express."""
import json

from pyspark.sql import functions as F

from textquarry.functions import scores as S
from textquarry.operators import arrow, conversations, corpus, metrics, nlp, retrieval, texts
from textquarry.sources import files, json_arrays
from textquarry.streaming import state


def one(spark, *cols, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(*cols).first()


def test_length_score_breakpoints(spark):
    for n, score in ((0, 0.0), (19, 0.0), (20, 0.3), (99, 0.3), (100, 1.0), (10_000, 1.0), (69_000, 0.5), (128_001, 0.2)):
        assert abs(one(spark, S.length_score(F.col("t")), t="x" * n)[0] - score) < 1e-9


def test_blank_lines_are_placeholders(spark):
    assert abs(one(spark, S.code_score(F.col("t")), t="a\n\nb\n \nc\n" + "\n" * 4)[0] - 0.2) < 1e-9


def test_pass_at_k(spark):
    for n, c, k, want in ((5, 1, 1, 0.2), (5, 5, 3, 1.0), (2, 1, 3, 0.0), (10, 3, 2, 1 - 7 / 10 * 6 / 9), (4, 2, 3, 1.0)):
        assert abs(one(spark, S.pass_at_k(F.col("n"), F.col("c"), k), n=n, c=c)[0] - want) < 1e-9


def test_lenient_and_strict_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": 1}\n\n  \nnot json\n{"b": {"c": "x"}}\n')
    assert files.jsonl(spark, [str(f), str(tmp_path / "missing.jsonl")]).count() == 2
    inferred = files.jsonl(spark, str(f), "inferred")
    assert {"a", "b"} <= set(inferred.columns) and [r.a for r in inferred.collect() if r.a is not None] == [1]
    try:
        files.jsonl(spark, str(f), "strict").collect()
        raise AssertionError("a bad line must raise")
    except Exception as e:
        assert "MALFORMED" in str(e).upper()


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "session_1.json").write_text(json.dumps({"id": 1}))
    (tmp_path / "in" / "other.txt").write_text("x")
    assert files.json_folder(spark, str(tmp_path / "in"), "session_*.json").count() == 1
    (tmp_path / "all.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert json_arrays.json_array(spark, str(tmp_path / "all.json")).count() == 2
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "src" / "node_modules" / "b.py").write_text("x = 1")
    (tmp_path / "src" / "c.md").write_text("x")
    assert [r.content for r in files.code_files(spark, str(tmp_path / "src"), (".py",)).collect()] == ["x = 1\ny = 2\n"]  # a row a file
    below = tmp_path / "dist" / ".hidden" / "build"  # names above the root do not matter, those below it do
    for name in ("a.PY", "sub dir/b.py", ".git2/c.py", "build/d.py", "sub dir/dist/e.py", ".f.py", ".py"):
        (below / name).parent.mkdir(parents=True, exist_ok=True)
        (below / name).write_text(name)
    assert sorted(r.content for r in files.code_files(spark, str(below), (".py",)).collect()) == ["a.PY", "sub dir/b.py"]
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert '"b":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    d = corpus.hash_split(spark.range(100), "id")
    files.write_splits(d, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 100
    assert files.synthetic(spark, 5, {"x": ["a", "b"]}).collect() == files.synthetic(spark, 5, {"x": ["a", "b"]}).collect()


def test_newest_records_first(spark, tmp_path):
    import os

    for i, (name, at) in enumerate({"b.json": 1_000_000, "a.json": 2_000_000, "c.json": 2_000_000, "d.txt": 3_000_000}.items()):
        (tmp_path / name).write_text(json.dumps({"id": i}))
        os.utime(tmp_path / name, (at, at))
    (tmp_path / "broken.json").write_text("{")
    assert [r.id for r in files.newest_records(spark, str(tmp_path)).collect() if r.id is not None] == [1, 2, 0]


def test_corrections(spark):
    d = spark.createDataFrame([("correction", "m", "r", {"corrected_response": "c"}), ("correction", "m2", "r2", {}), ("thumbs_up", "x", "y", {})], "feedback_type string, message string, response string, metadata map<string,string>")
    assert [tuple(r) for r in files.corrections(d).collect()] == [("m", "c"), ("m2", "r2")]


def test_entity_overlap(spark):
    d = spark.createDataFrame([(1, "mail a.b@c.de or https://x.org/p now"), (2, None)], "doc_id long, text string")
    got = [(r.kind, r.entity) for r in nlp.entity_spans(d, "doc_id").collect()]
    assert got == [("EMAIL", "a.b@c.de"), ("URL", "https://x.org/p")]


def test_custom_intent(spark):
    d = spark.createDataFrame([("deploy it",), ("zzz",), (None,)], "text string")
    got = [r.intent for r in nlp.intents(d, rules=nlp.with_rules({"deploy": (["deploy", "it"], ["^deploy"])})).collect()]
    assert got == ["deploy", "general", "general"]


def test_glob():
    import re

    rx = re.compile(texts.glob_regex("**/*.py"))
    assert rx.match("a/b/x.py") and rx.match("x.py") and not rx.match("x.pyc")
    assert re.match(texts.glob_regex("[!a]?.t"), "bc.t") and not re.match(texts.glob_regex("[!a]?.t"), "ac.t")


def test_budget_skips_what_does_not_fit(spark):
    found = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "doc_id long, score double")
    docs = spark.createDataFrame([(1, "x" * 6), (2, "x" * 9), (3, "x" * 4)], "doc_id long, text string")
    assert [r.doc_id for r in retrieval.budget_context(found, docs, 10).collect()] == [1, 3]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (3, 2, "b"), (2, 4, "a")], "src long, dst long, type string")
    assert [tuple(r) for r in retrieval.similar_nodes(e, 1).collect()] == [(3, 1.0)]
    n = spark.createDataFrame([(1, "x")], "id long, type string")
    assert {r.id: r.type for r in retrieval.with_missing_nodes(n, e).collect()} == {1: "x", 2: "unknown", 3: "unknown", 4: "unknown"}
    m = spark.createDataFrame([(1, {"k": "v"}), (2, {"k": "w"})], "id long, props map<string,string>")
    assert [r.id for r in retrieval.with_properties(m, "props", {"k": "v"}).collect()] == [1]


def test_arrow_operators(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string").withColumn("n", F.lit(4))
    assert [r.pack for r in arrow.pack(d, 9).collect()] == [0, 0, 1]
    code = "x = 1\n" * 6 + "def f(a=[]):\n    try:\n        pass\n    except:\n        pass\n"
    d = spark.createDataFrame([(1, code), (2, "def ("), (3, None)], "doc_id long, text string")
    assert [(r.start_line, r.end_line) for r in arrow.chunk_code(d).collect()] == [(1, 6), (7, 12)]
    assert [(r.parses, r.bare_excepts, r.mutable_defaults) for r in arrow.syntax(d).collect()] == [(True, 1, 1), (False, 0, 0), (True, 0, 0)]
    m = arrow.mask_labels(spark.createDataFrame([(["u", "assistant", "x", "<pad>"],)], "tokens array<string>")).first()
    assert m.labels == [None, None, "x", None]


def test_tool_calls(spark):
    d = spark.createDataFrame([([("user", "hi", []), ("assistant", None, [("f", '{"a": 1}')])],)], "messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>")
    assert '<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call><|im_end|>' in conversations.chatml_with_tools(d).first().formatted
    pairs = spark.createDataFrame([("x", "{ ... }"), ("x", " "), ("x", "y")], "code string, fullBody string")
    assert corpus.code_pairs(pairs).count() == 1
    tools = spark.createDataFrame([("t", "", None), (None, None, None)], "tool string, description string, inputSchema string")
    assert [r.description for r in corpus.tool_defaults(tools).collect()] == ["Tool for t", "Tool for unknown operation"]


def test_streams_equal_batches(spark, tmp_path):
    e = spark.range(300).select((F.col("id") % 3).alias("user_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7)").alias("ts"), F.col("id").cast("double").alias("value"))
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def drain(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert sorted(drain(state.hourly_stream(s), "complete", "hours").collect()) == sorted(metrics.hourly(e).collect())
    assert drain(state.session_stream(s), "append", "sess").count() <= metrics.sessions(e).count()
    admitted = drain(state.rate_limit(s, most=2), "append", "rate").collect()
    want, times = [], {}
    for r in sorted(e.collect(), key=lambda r: r.ts):
        at = r.ts.timestamp()
        own = times.setdefault(r.user_id, [])
        own[:] = [x for x in own if x > at - 60]
        want.append(len(own) < 2)
        if want[-1]:
            own.append(at)
    assert sum(r.admitted for r in admitted) == sum(want) and len(admitted) == 300
    q = state.append_log(s, str(tmp_path / "log"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 300
    assert state.retain(e, "2024-01-01 00:10:00", 0).count() == e.filter("ts > timestamp_ntz'2024-01-01 00:10:00'").count()
