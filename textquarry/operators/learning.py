"""Learning stores, reports, evaluation and project detection (PRJ, JOIN, AGG, WIN, TOP, STR, VEC, MATH, PIPE, STM, SNK)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.lineage import checkpointed
from .blocks import find_words, top_k_many

#: Fixed value: the extensions of each language; any other is text.
EXTENSIONS = {
    "typescript": ".ts .tsx", "javascript": ".js .jsx", "python": ".py", "go": ".go", "rust": ".rs", "java": ".java", "c": ".c .h", "cpp": ".cpp .hpp",
    "csharp": ".cs", "ruby": ".rb", "php": ".php", "swift": ".swift", "kotlin": ".kt", "scala": ".scala", "vue": ".vue", "svelte": ".svelte",
    "json": ".json", "yaml": ".yaml .yml", "markdown": ".md", "bash": ".sh .bash .zsh",
}
#: Fixed value: patterns of a path in a request; the first that matches counts.
PATHS = [rf"([a-zA-Z0-9_/\-\.]+\.{e})" for e in ("py", "js", "ts", "md", "json", "txt")] + [r"([a-zA-Z0-9_/\-\.]+\.yaml|\.yml)", r"([a-zA-Z0-9_/\-\.]+)"]
#: Fixed value: what a request says about the parameters of a tool.
PARAMETERS = {
    "read_path": r"(?i)(?:read|show|cat|view)\s+(?:the\s+)?(?:file\s+)?(.+)",
    "write_path": r"(?i)write\s+(?:to\s+)?(.+?)(?:\s+with|\s+content|\z)",
    "content": r"(?i)(?:content|with):\s*(.+)\z",
    "message": r"(?i)commit(?:\s+with)?\s+(?:message\s+)?[\"']?(.+)[\"']?",
}
#: Fixed value: names that a project starts from.
ENTRY_POINTS = ("main.py", "app.py", "index.js", "main.js", "server.py")


def concat_format(df: DataFrame, key: str) -> DataFrame:
    """PRJ-05: prompt and completion, else input and output, else instruction and output; rows without any go."""
    text = F.coalesce(F.concat("prompt", "completion"), F.concat("input", "output"), F.concat("instruction", F.lit(" "), "output"))
    return df.select(key, text.alias("text")).filter(F.col("text").isNotNull())


def memory_prompt(category: Column, content: Column) -> Column:
    """PRJ-10."""
    category, content = F.coalesce(category, F.lit("task")), F.coalesce(content, F.lit(""))
    short = F.substring(content, 1, 100)
    return (F.when(F.contains(category, F.lit("success")), F.concat(F.lit("Given a problem similar to: "), short, F.lit(", how would you solve it?")))
            .when(F.contains(category, F.lit("failure")), F.concat(F.lit("Avoid the approach that led to: "), short, F.lit(". What should be done instead?")))
            .otherwise(F.concat(F.lit("Task: "), F.substring(content, 1, 150))))


def human_number(n: Column) -> Column:
    """PRJ-17: 1.5B, 12M, or the number."""
    return F.when(n >= 1_000_000_000, F.format_string("%.1fB", n / 1e9)).when(n >= 1_000_000, F.format_string("%.0fM", n / 1e6)).otherwise(n.cast("string"))


def size_ratios(models: DataFrame, name: str, size: str) -> DataFrame:
    """PRJ-17: every pair of models with sizes, by name. The table lists models, not data."""
    m = models.filter(F.col(size) > 0)
    a, b = m.select(F.col(name).alias("a"), F.col(size).alias("_a")), m.select(F.col(name).alias("b"), F.col(size).alias("_b"))
    d = a.join(b, F.col("a") < F.col("b")).withColumn("ratio", F.round(F.col("_b") / F.col("_a"), 6))
    return d.select("a", "b", "ratio", F.when(F.col("_b") > F.col("_a"), "larger").otherwise("smaller").alias("direction"))


def tool_breakdown(cases: DataFrame, predictions: DataFrame, case: str = "case_id") -> DataFrame:
    """JOIN-02, AGG-09: cases and predictions meet by their id; a case without a prediction is wrong."""
    d = cases.select(case, "expected").join(predictions.select(case, "predicted"), case, "left")
    right = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False))
    return d.groupBy(F.col("expected").alias("tool")).agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"))


def worst(breakdown: DataFrame, k: int = 5) -> DataFrame:
    """AGG-09."""
    return breakdown.orderBy("accuracy", "tool").limit(k)


def lessons_for(tasks: DataFrame, lessons: DataFrame, task: str, *texts: str) -> DataFrame:
    """JOIN-07: lessons one of whose texts names the task, as column `task`; any number of tasks (see blocks.find_words)."""
    return find_words(lessons, tasks, task, *texts, out="task")


def recommend(options: DataFrame, memories: DataFrame, key: str, k: int = 3, least: float = 0.3, vector: str = "embedding", **bounds: int) -> DataFrame:
    """JOIN-12, TOP-04 over options (option, q) and memories (key, vector, success_rate, use_count): per option the k most similar
    memories (of at least `least`), their mean success_rate as the score (0.5 without any) and uses / 10 as confidence.
    Any number of options (see blocks.top_k_many)."""
    d = top_k_many(options, memories, "option", key, k, least, "q", vector, ("success_rate", "use_count"), **bounds)
    found = d.groupBy("option").agg(F.avg("success_rate").alias("_score"), F.sum("use_count").alias("_uses"), F.count("*").alias("_n"))
    return options.select("option").join(found, "option", "left").select(
        "option", F.round(F.coalesce("_score", F.lit(0.5)), 6).alias("score"),
        F.round(F.least(F.lit(1.0), F.coalesce("_uses", F.lit(0)) / 10), 6).alias("confidence"), F.coalesce("_n", F.lit(0)).alias("based_on"))


def best_option(recommended: DataFrame) -> DataFrame:
    """TOP-04: the option of the highest score; ties go to the one that comes first."""
    return recommended.orderBy(F.desc("score"), "option").limit(1)


def dashboard(memories: DataFrame, lessons: DataFrame, improvements: DataFrame, sessions: DataFrame) -> DataFrame:
    """AGG-04: one row over four stores."""
    n, total = F.count("*"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    done = F.col("implemented")
    rows = [
        memories.agg(n.alias("total_memories"), mean("success_rate").alias("avg_success_rate"), total("use_count").alias("total_uses")),
        lessons.agg(n.alias("total_lessons"), total("success_count").alias("lesson_successes"), total("failure_count").alias("lesson_failures")),
        improvements.agg(F.count_if(~done).alias("pending_improvements"), F.count_if(done).alias("implemented_improvements"), mean(F.when(done, F.col("impact_score"))).alias("avg_impact")),
        sessions.agg(total("tasks_completed").alias("total_tasks_completed"), total("tasks_failed").alias("total_tasks_failed")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))  # one row each
    done, failed = F.col("total_tasks_completed"), F.col("total_tasks_failed")
    return out.withColumn("overall_success_rate", F.round(F.when(done + failed > 0, done / (done + failed)).otherwise(0.0), 3))


def context_summary(df: DataFrame, length: str, ok: Column, speed: str, seconds: str) -> DataFrame:
    """AGG-12: means of the successful runs per context length."""
    return df.filter(ok).groupBy(length).agg(F.count("*").alias("count"), F.round(F.avg(speed), 2).alias("avg_tokens_per_second"), F.round(F.avg(seconds), 3).alias("avg_latency_seconds"))


def server_metrics(df: DataFrame, ts: str, tokens: Column, latency: Column, error: Column) -> DataFrame:
    """AGG-13; the uptime is the time from the first request to the last."""
    up = F.expr(f"timestampdiff(MICROSECOND, min({ts}), max({ts}))") / 1e6
    d = df.withColumns({"_tokens": tokens, "_latency": latency, "_error": error})
    d = d.agg(F.count("*").alias("total_requests"), F.coalesce(F.sum("_tokens"), F.lit(0)).cast("long").alias("total_tokens"), F.round(F.coalesce(F.avg("_latency"), F.lit(0.0)) * 1000, 3).alias("avg_latency_ms"), F.count_if("_error").alias("errors"), F.coalesce(up, F.lit(0.0)).alias("_up"))
    return d.select("total_requests", "total_tokens", "avg_latency_ms", "errors", F.round(F.when(F.col("_up") > 0, F.col("total_requests") / (F.col("_up") / 60)).otherwise(0.0), 6).alias("requests_per_minute"))


def durations(df: DataFrame, key: str, ts: str) -> DataFrame:
    """AGG-19: messages and minutes from the first to the last; 0 for a single message."""
    micros = F.expr(f"timestampdiff(MICROSECOND, min({ts}), max({ts}))")
    return df.groupBy(key).agg(F.count("*").alias("n_messages"), F.round(micros / 60e6, 6).alias("minutes"))


def tool_contexts(df: DataFrame, tool: str, context: str, k: int = 5) -> DataFrame:
    """AGG-20: the k most used tools; their contexts come as rows, since a list of them has no bound."""
    top = df.groupBy(tool).agg(F.count("*").alias("n")).orderBy(F.desc("n"), tool).limit(k)
    return df.join(F.broadcast(top), tool).withColumn("context", F.substring(context, 1, 100))  # k rows


def rarity_overlap(df: DataFrame, name: str, domain: str) -> DataFrame:
    """AGG-22: sum of 1 / (names that have the domain); 1 for a name without domains."""
    d = df.select(name, domain).distinct()
    rare = d.filter(F.col(domain).isNotNull()).groupBy(domain).agg((1 / F.count("*")).alias("_w"))
    return d.join(rare, domain, "left").groupBy(name).agg(F.round(F.coalesce(F.sum("_w"), F.lit(1.0)), 6).alias("overlap"))


def improvement_rates(df: DataFrame, **flags: Column) -> DataFrame:
    """AGG-23: the share of rows with each flag, and the mean of the shares."""
    d = df.agg(*[F.coalesce(F.avg(c.cast("int")), F.lit(0.0)).alias(k) for k, c in flags.items()])
    whole = sum((F.col(k) for k in flags), F.lit(0.0)) / len(flags)
    return d.select(*[F.round(k, 6).alias(k) for k in flags], F.round(whole, 6).alias("overall"))


def learning_curve(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """WIN-09: (last - first) / n and last - first; the slope of a single point is 0."""
    d = df.groupBy(key).agg(F.count("*").alias("n"), (F.max_by(value, order) - F.min_by(value, order)).alias("_d"))
    return d.select(key, "n", F.round(F.when(F.col("n") >= 2, F.col("_d") / F.col("n")).otherwise(0.0), 6).alias("slope"), F.round("_d", 6).alias("delta"))


def history(df: DataFrame, version: str, *metrics: str) -> DataFrame:
    """WIN-10."""
    return df.select(version, *metrics).orderBy(version)


def top_baselines(df: DataFrame, name: str, metric: str, k: int = 3) -> DataFrame:
    """TOP-05; no metric counts as 0."""
    return df.select(name, F.coalesce(metric, F.lit(0.0)).alias(metric)).orderBy(F.desc(metric), name).limit(k)


def language_of_path(path: Column) -> Column:
    """STR-08."""
    pairs = [F.lit(x) for lang, ends in EXTENSIONS.items() for e in ends.split() for x in (e, lang)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))), F.lit("text"))


def markdown_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """STR-22: ### titles, and the text from the second line after each, at most 200 characters."""
    p = F.lit(r"(?s)### (.+?)\n.*?\n(.*?)(?=### |\n?\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("t"), F.regexp_extract_all(text, p, F.lit(2)).alias("b"))
    d = df.select(key, F.posexplode(pairs).alias("place", "x"))
    return d.select(key, "place", S.strip(F.col("x.t")).alias("title"), F.substring(S.strip(F.col("x.b")), 1, 200).alias("content"))


def request_parameters(df: DataFrame, text: str = "text") -> DataFrame:
    """STR-25: path and parameters named in a request; null where there is none."""
    c = F.coalesce(F.col(text), F.lit(""))
    get = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return df.withColumns({"path": F.coalesce(*[get(p) for p in PATHS]), **{k: get(p) for k, p in PARAMETERS.items()}})


def projects(files: DataFrame, most: int = 100) -> DataFrame:
    """STR-27 over (project, file, content): the last manifest wins; entry points among the first files by name."""
    depends = lambda name: F.try_variant_get(F.try_parse_json("content"), f"$.dependencies.{name}", "string").isNotNull()
    has = lambda w: F.contains("content", F.lit(w))
    py, js = F.col("file") == "pyproject.toml", F.col("file") == "package.json"
    py_name = F.when(has("fastapi"), "fastapi").when(has("django"), "django").when(has("flask"), "flask")
    js_name = F.when(depends("next"), "next").when(depends("react"), "react")
    d = files.withColumn("_r", F.row_number().over(Window.partitionBy("project").orderBy("file")))
    entry = F.when((F.col("_r") <= most) & F.col("file").rlike("(?:" + "|".join(e.replace(".", "\\.") for e in ENTRY_POINTS) + ")$"), F.col("file"))
    return d.groupBy("project").agg(
        F.when(F.bool_or(js), "javascript").when(F.bool_or(py), "python").alias("language"),
        F.coalesce(F.max(F.when(js, js_name)), F.max(F.when(py, py_name))).alias("framework"),
        F.array_sort(F.collect_set(entry)).alias("entry_points"))


def similarity_matrix(vectors: DataFrame, name: str, key: str, column: str) -> DataFrame:
    """VEC-02 over (name, key, vector): vectors are scaled per key; only keys that both names have meet."""
    dot = lambda a, b: F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(column, column))
    v = vectors.select(name, key, column, norm.alias("_n")).withColumn(column, F.transform(column, lambda x: F.when(F.col("_n") > 1e-8, x.cast("double") / F.col("_n")).otherwise(x.cast("double"))))
    a = v.select(key, F.col(name).alias("a"), F.col(column).alias("_x"))
    b = v.select(key, F.col(name).alias("b"), F.col(column).alias("_y"))
    d = a.join(b, key).groupBy("a", "b").agg(F.sum(dot("_x", "_y")).alias("_d"), F.sum(dot("_x", "_x")).alias("_p"), F.sum(dot("_y", "_y")).alias("_q"))
    return d.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.round(F.col("_d") / (F.sqrt("_p") * F.sqrt("_q") + 1e-8), 6)).alias("similarity"))


def memory_estimate(df: DataFrame, length: str, parameters: int = 32_000_000_000) -> DataFrame:
    """MATH-02: GiB of cache and weights per context length (fixed values: 1.7 and 0.425 bytes a token)."""
    cache, small, gib = F.col(length) * 1.7, F.col(length) * 0.425, float(1 << 30)
    values = {"kv_cache_bf16_gb": cache, "kv_cache_4bit_gb": small, "model_fp16_gb": F.lit(parameters * 2.0), "model_4bit_gb": F.lit(float(parameters // 2)), "total_fp16_gb": cache + parameters * 2.0, "total_4bit_gb": small + float(parameters // 2)}
    return df.select(length, *[F.round(v / gib, 6).alias(k) for k, v in values.items()])


def mark_failures(patterns: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """PIPE-04 over (key, successes, failures): failures that name a pattern are added; names without one go."""
    more = failures.groupBy(key).agg(F.count("*").alias("_more"))
    d = patterns.select(key, "successes", "failures").join(more, key, "left").withColumn("failures", F.col("failures") + F.coalesce("_more", F.lit(0)))
    return d.select(key, "successes", "failures", F.round(S.ratio(F.col("successes"), F.col("successes") + F.col("failures")), 6).alias("rate"))


def reasoning_types(sessions: DataFrame) -> DataFrame:
    """PIPE-05 over sessions.tasks: how often each type of step and of decision occurs."""
    t = sessions.select(F.explode("tasks").alias("t"))
    part = lambda k, c: t.select(F.lit(k).alias("kind"), F.explode(c).alias("x")).groupBy("kind", F.coalesce("x.type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    return part("step", "t.steps").unionByName(part("decision", "t.decisions"))


def reasoning_tasks(sessions: DataFrame) -> DataFrame:
    """PIPE-05: each task with its outcome and the number of its steps and decisions."""
    t = sessions.select(F.explode("tasks").alias("t"))
    size = lambda c: F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(0)).cast("long")
    return t.select(F.when(F.coalesce("t.success", F.lit(False)), "success").otherwise("failure").alias("outcome"), "t.task_type", size("t.steps").alias("steps"), size("t.decisions").alias("decisions"))


def learning_report(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """PIPE-08 over success_by(): up to k approaches over 0.7 with more than 2 uses, up to k under 0.4."""
    uses = (F.col("successes") + F.col("failures")).alias("uses")
    d = df.select(key, "rate", uses)
    part = lambda rows, kind, *order: rows.orderBy(*order, key).limit(k).select(F.lit(kind).alias("kind"), key, "rate", "uses")
    return part(d.filter("rate > 0.7 AND uses > 2"), "successful_approach", F.desc("rate")).unionByName(part(d.filter("rate < 0.4"), "failure_pattern", "rate"))


def reflect(calls: DataFrame, key: str, ok: Column, response: Column, least: float = 0.7) -> DataFrame:
    """PIPE-17: failed calls, confidence as the share that succeeded (Q24), and whether to think again."""
    d = calls.withColumns({"_ok": ok, "_n": F.length(F.coalesce(response, F.lit("")))}).groupBy(key).agg(F.count_if(~F.col("_ok")).alias("failed_calls"), F.round(F.avg(F.col("_ok").cast("int")), 6).alias("confidence"), F.max("_n").cast("long").alias("response_length"))
    return d.withColumn("needs_reflection", (F.col("failed_calls") > 0) | (F.col("confidence") < least) | (F.col("response_length") < 20))


def _fills(times: np.ndarray, life: int) -> np.ndarray:
    """For each request, if it fills the cache: the last fill that follows from it within these times (sorted)."""
    out = times.copy()
    following = np.searchsorted(times, times + life, "left")
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            out[i] = out[following[i]]
    return out


def ttl_cache(df: DataFrame, key: str, ts: str, seconds: int = 300) -> DataFrame:
    """STM-07: whether each request finds a fresh entry; a hit does not renew it. Requests are dealt by ranges of key and time. What a
    range makes of the fill that reaches it from the range before is a step function (which request is the first to find the entry stale decides
    all that follows); these are composed from range to range for keys that lie in several, and then each range is read by itself. So a hot key
    is spread over its ranges, without a list of its requests. A request without a time is no hit and fills nothing."""
    life = seconds * 1_000_000
    rows = df.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    d = rows.filter("t is not null").withColumn("u", F.rand(7)).repartitionByRange("k", "t", "u").sortWithinPartitions("k", "t")
    d = checkpointed(d.drop("u")).withColumn("part", F.spark_partition_id())
    kind = df.schema[key].dataType.simpleString()

    def runs(b):
        """(keys, times, borders) of a batch: where each key begins."""
        code = b.column(0).dictionary_encode("encode").indices.to_numpy()
        return b.column(0), b.column(1).to_numpy(), np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else []

    def ends(batches):
        """The range's first key with its step function (fill from, fill after), and its last key with its last fill."""
        first, times, last, fill, part = None, [], None, None, None
        for b in batches:
            keys, t, cuts = runs(b)
            for i, j in zip(cuts, np.append(cuts[1:], len(t))):
                k = keys[int(i)].as_py()
                if part is None:
                    first, part = k, b.column(2)[0].as_py()
                if k == first and last is None:
                    times.append(t[i:j])
                    continue
                if last is None or k != last[0]:
                    last, fill = (k,), None
                own = t[i:j]
                at = 0 if fill is None else int(np.searchsorted(own, fill + life, "left"))
                fill = fill if at == len(own) else int(_fills(own[at:], life)[0])
        if part is not None:
            t = np.concatenate(times)
            after = _fills(t, life)
            at = np.flatnonzero(np.append(True, after[1:] != after[:-1]))
            cols = [pa.array([part], pa.int32()), pa.array([first], b.schema.field(0).type), pa.array([last is None]), pa.array([None if last is None else last[0]], b.schema.field(0).type), pa.array([fill], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([t[np.append(at[1:], len(t)) - 1].tolist()], pa.list_(pa.int64())), pa.array([after[at].tolist()], pa.list_(pa.int64()))], ["part", "first", "one", "last", "fill", "upto", "after"])

    starts: dict[int, int | None] = {}
    now, fill = (), None
    for r in sorted(d.mapInArrow(ends, f"part int, first {kind}, one boolean, last {kind}, fill long, upto array<long>, after array<long>").collect(), key=lambda r: r.part):  # a row a range
        starts[r.part] = fill if now == (r.first,) else None
        if not r.one:
            now, fill = (r.last,), r.fill
            continue
        place = 0 if starts[r.part] is None else int(np.searchsorted(np.array(r.upto), starts[r.part] + life, "left"))
        fill = starts[r.part] if place == len(r.upto) else r.after[place]
        now = (r.first,)
    sent = df.sparkSession.sparkContext.broadcast(starts)

    def hits(batches):
        held, at = None, None
        for b in batches:
            if not len(b):
                continue
            if held is None:
                held, at = (b.column(0)[0].as_py(),), sent.value[b.column(2)[0].as_py()]
            keys, t, cuts = runs(b)
            out = []
            for i, j in zip(cuts, np.append(cuts[1:], len(t))):
                if (k := (keys[int(i)].as_py(),)) != held:
                    held, at = k, None
                for x in t[i:j].tolist():
                    hit = at is not None and x - at < life
                    at = at if hit else x
                    out.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["k", "t", "hit"])

    out = d.mapInArrow(hits, f"k {kind}, t long, hit boolean").unionByName(rows.filter("t is null").withColumn("hit", F.lit(False)))
    return out.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), "hit")


def due(schedules: DataFrame, key: str, now: str) -> DataFrame:
    """STM-10 over (key, enabled, last_run, interval_hours)."""
    at = F.expr(f"timestamp_ntz'{now}'")
    following = F.expr("last_run + make_dt_interval(0, interval_hours)")
    on = F.coalesce("enabled", F.lit(False))
    return schedules.select(key, (on & (F.col("last_run").isNull() | (at >= following))).alias("due"), F.when(on, following).alias("next_due"))


def hash_embedding(c: Column, size: int = 256) -> Column:
    """HASH-02: the bytes of the digest over and over, divided by 255. The digest goes into the lambda as an item of an array, as
    it would else be worked out again for every place."""
    byte = lambda d, i: F.conv(F.substr(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255
    once = F.transform(F.array(F.sha2(c.cast("string"), 256)), lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(d, i)))
    return F.slice(F.flatten(F.array_repeat(F.get(once, F.lit(0)), -(-size // 32))), 1, size)


def seeded_embedding(df: DataFrame, key: str, text: str = "text", size: int = 128) -> DataFrame:
    """HASH-02: (key, embedding), normal numbers of the legacy generator seeded with the last 32 bits of the digest.
    That generator has no built-in form, hence an Arrow function per batch."""
    def run(batches):
        for b in batches:
            seeds = [int(hashlib.sha256((t or "").encode()).hexdigest(), 16) % 2**32 for t in b.column(1).to_pylist()]
            rows = [np.random.RandomState(s).randn(size).astype(np.float32).tolist() for s in seeds]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def export_tables(frames: dict[str, DataFrame], folder: str) -> None:
    """SNK-03: one JSON dataset per table; fields without a value are written too."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def import_tables(spark, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """SNK-03: the tables of export_tables(); a schema each, so that nothing is guessed."""
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}
