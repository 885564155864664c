"""Queries over operators/learning.py with their SQL; catalog.py imports them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import blocks, learning, metrics
from .catalog import COS, OK, SUCCESS, on

PIVOT = "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS u, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a, arg_min(text, turn) FILTER (WHERE role = 'system') AS s FROM conversations GROUP BY 1"


@on("conversations", "concat_format", f"SELECT conv_id, coalesce(u || a, s || ' ' || a) AS text FROM ({PIVOT}) WHERE coalesce(u || a, s || ' ' || a) IS NOT NULL")
def _(c):
    first = lambda r: F.min_by("text", F.when((F.col("role") == r) & F.col("text").isNotNull(), F.col("turn")))
    none = F.lit(None).cast("string")
    d = c.groupBy("conv_id").agg(first("user").alias("prompt"), first("assistant").alias("completion"), first("system").alias("instruction"))
    return learning.concat_format(d.withColumns({"input": none, "output": F.col("completion")}), "conv_id")


CATEGORY = "CASE event_type WHEN 'purchase' THEN 'success_pattern' WHEN 'error' THEN 'failure_pattern' ELSE event_type END"


@on("events", "memory_prompts", f"""SELECT event_id, CASE WHEN contains(c, 'success') THEN 'Given a problem similar to: ' || substr(p, 1, 100) || ', how would you solve it?'
 WHEN contains(c, 'failure') THEN 'Avoid the approach that led to: ' || substr(p, 1, 100) || '. What should be done instead?' ELSE 'Task: ' || substr(p, 1, 150) END AS prompt
 FROM (SELECT event_id, coalesce({CATEGORY}, 'task') AS c, coalesce(props, '') AS p FROM events)""")
def _(e):
    return e.select("event_id", learning.memory_prompt(F.expr(CATEGORY), F.col("props")).alias("prompt"))


@on("events", "human_numbers", "SELECT event_id, CASE WHEN n >= 1000000000 THEN printf('%.1fB', n / 1e9::DOUBLE) WHEN n >= 1000000 THEN printf('%.0fM', n / 1e6::DOUBLE) ELSE n::VARCHAR END AS label FROM (SELECT event_id, event_id * 7654321 AS n FROM events)")
def _(e):
    return e.select("event_id", learning.human_number(F.col("event_id") * 7654321).alias("label"))


@on("events", "size_ratios", "WITH m AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1) SELECT a.k AS a, b.k AS b, round(b.n::DOUBLE / a.n, 6) AS ratio, CASE WHEN b.n > a.n THEN 'larger' ELSE 'smaller' END AS direction FROM m a JOIN m b ON a.k < b.k")
def _(e):
    return learning.size_ratios(metrics.count_by(e, "event_type"), "event_type", "n")


TOOLS = "SELECT event_type AS tool, count(*) AS total, count(*) FILTER (WHERE value > 20 OR event_type = 'click') AS correct, round(avg((coalesce(value > 20, false) OR event_type = 'click')::INT), 6) AS accuracy FROM events GROUP BY 1"


def _breakdown(e: DataFrame) -> DataFrame:
    guess = e.select(F.col("event_id").alias("case_id"), F.when(F.col("value") > 20, F.col("event_type")).otherwise("click").alias("predicted"))
    return learning.tool_breakdown(e.select(F.col("event_id").alias("case_id"), F.col("event_type").alias("expected")), guess)


@on("events", "tool_breakdown", TOOLS)
def _(e):
    return _breakdown(e)


@on("events", "worst_breakdown", f"SELECT * FROM ({TOOLS}) ORDER BY accuracy, tool LIMIT 5")
def _(e):
    return learning.worst(_breakdown(e))


@on("documents", "lesson_match", f"SELECT t.lang AS task, count(*) AS n FROM (SELECT DISTINCT lang FROM documents) t JOIN documents d ON contains(lower(coalesce(d.text, '')), lower(t.lang)) GROUP BY 1")
def _(d):
    return metrics.count_by(learning.lessons_for(d, d.select("doc_id", "text"), "lang", "text"), "task")


OPTIONS = "SELECT label AS option, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1"
RECOMMENDED = f"""WITH o AS ({OPTIONS}), s AS (SELECT option, vec_id, (vec_id % 10) / 10.0::DOUBLE AS success_rate, vec_id % 7 AS use_count, round({COS.format(a='embedding', b='q')}, 6) AS s FROM embeddings, o),
 b AS (SELECT * FROM s WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY option ORDER BY s DESC, vec_id) <= 3)
 SELECT o.option, round(coalesce(avg(success_rate), 0.5), 6) AS score, round(least(1.0, coalesce(sum(use_count), 0) / 10.0), 6)::DOUBLE AS confidence, count(vec_id) AS based_on FROM o LEFT JOIN b USING (option) GROUP BY 1"""


def _recommended(e: DataFrame) -> DataFrame:
    options = e.groupBy(F.col("label").alias("option")).agg(F.min_by("embedding", "vec_id").alias("q"))
    memories = e.select("vec_id", "embedding", (F.col("vec_id") % 10 / 10).alias("success_rate"), (F.col("vec_id") % 7).alias("use_count"))
    return learning.recommend(options, memories, "vec_id")


@on("embeddings", "topk_per_option", RECOMMENDED)
def _(e):
    return _recommended(e)


@on("embeddings", "vector_topk_many", f"""SELECT q.vec_id AS query_id, e.vec_id, round({COS.format(a='q.embedding', b='e.embedding')}, 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.embedding', b='e.embedding')}, 6) DESC, e.vec_id)::INT AS rank
 FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 QUALIFY rank <= 5""")
def _(e):
    return blocks.top_k_many(e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e, "query_id", "vec_id", 5, query_vector="q")


@on("embeddings", "best_option", f"SELECT * FROM ({RECOMMENDED}) ORDER BY score DESC, option LIMIT 1")
def _(e):
    return learning.best_option(_recommended(e))


@on("documents labels events conversations", "store_dashboard", """SELECT *, round(CASE WHEN total_tasks_completed + total_tasks_failed > 0 THEN total_tasks_completed::DOUBLE / (total_tasks_completed + total_tasks_failed) ELSE 0 END, 3) AS overall_success_rate FROM
 (SELECT count(*) AS total_memories, round(coalesce(avg(n_chars % 2), 0), 3) AS avg_success_rate, coalesce(sum(n_chars), 0)::BIGINT AS total_uses FROM documents),
 (SELECT count(*) AS total_lessons, coalesce(sum(quality), 0)::BIGINT AS lesson_successes, coalesce(sum(toxic), 0)::BIGINT AS lesson_failures FROM labels),
 (SELECT count(*) FILTER (WHERE event_type <> 'purchase') AS pending_improvements, count(*) FILTER (WHERE event_type = 'purchase') AS implemented_improvements, round(coalesce(avg(value) FILTER (WHERE event_type = 'purchase'), 0), 3) AS avg_impact FROM events),
 (SELECT count(*) FILTER (WHERE role = 'assistant') AS total_tasks_completed, count(*) FILTER (WHERE role = 'system') AS total_tasks_failed FROM conversations)""")
def _(d, lab, e, c):
    return learning.dashboard(
        d.select((F.col("n_chars") % 2).alias("success_rate"), F.col("n_chars").alias("use_count")),
        lab.select(F.col("quality").alias("success_count"), F.col("toxic").alias("failure_count")),
        e.select((F.col("event_type") == "purchase").alias("implemented"), F.col("value").alias("impact_score")),
        c.select((F.col("role") == "assistant").cast("int").alias("tasks_completed"), (F.col("role") == "system").cast("int").alias("tasks_failed")))


@on("events", "context_summary", f"SELECT event_type, count(*) AS count, round(avg(value), 2) AS avg_tokens_per_second, round(avg(user_id), 3) AS avg_latency_seconds FROM events WHERE {OK} GROUP BY 1")
def _(e):
    return learning.context_summary(e, "event_type", F.expr(OK), "value", "user_id")


@on("events", "server_metrics", "SELECT count(*) AS total_requests, sum(length(props))::BIGINT AS total_tokens, round(avg(value) * 1000, 3) AS avg_latency_ms, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6::DOUBLE / 60), 6) AS requests_per_minute FROM events")
def _(e):
    return learning.server_metrics(e, "ts", F.length("props"), F.col("value"), F.col("event_type") == "error")


@on("events", "conversation_durations", "SELECT user_id, count(*) AS n_messages, round(date_diff('microsecond', min(ts), max(ts)) / 60e6::DOUBLE, 6) AS minutes FROM events GROUP BY 1")
def _(e):
    return learning.durations(e, "user_id", "ts")


@on("events", "tool_contexts", "WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT event_id, event_type, n, substr(props, 1, 100) AS context FROM events JOIN t USING (event_type)")
def _(e):
    return learning.tool_contexts(e, "event_type", "props").select("event_id", "event_type", "n", "context")


@on("documents", "rarity_overlap", "WITH d AS (SELECT DISTINCT source, lang FROM documents), r AS (SELECT lang, 1.0::DOUBLE / count(*) AS w FROM d WHERE lang IS NOT NULL GROUP BY 1) SELECT source, round(coalesce(sum(w), 1), 6) AS overlap FROM d LEFT JOIN r USING (lang) GROUP BY 1")
def _(d):
    return learning.rarity_overlap(d, "source", "lang")


@on("labels", "improvement_rates", "SELECT round(q, 6) AS memory_retention, round(t, 6) AS pattern_accuracy, round((q + t) / 2, 6) AS overall FROM (SELECT avg((quality = 1)::INT) AS q, avg((toxic = 0)::INT) AS t FROM labels)")
def _(lab):
    return learning.improvement_rates(lab, memory_retention=F.col("quality") == 1, pattern_accuracy=F.col("toxic") == 0)


@on("events", "learning_curve", "SELECT user_id, n, round(CASE WHEN n >= 2 THEN d / n ELSE 0 END, 6) AS slope, round(d, 6) AS delta FROM (SELECT user_id, count(*) AS n, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS d FROM events GROUP BY 1)")
def _(e):
    return learning.learning_curve(e, "user_id", F.struct("ts", "event_id"), "value")


@on("nation", "version_history", "SELECT n_nationkey, n_name FROM nation ORDER BY 1")
def _(n):
    return learning.history(n, "n_nationkey", "n_name")


@on("events", "top_baselines", f"SELECT user_id, rate FROM ({SUCCESS}) ORDER BY rate DESC, user_id LIMIT 3")
def _(e):
    return learning.top_baselines(metrics.success_by(e, "user_id", F.expr(OK)), "user_id", "rate")


PATH = "'src/m' || page_id || CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.yml' WHEN 3 THEN '.zip' ELSE '' END"


@on("pages", "path_language", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'yaml' ELSE 'text' END AS language FROM pages")
def _(p):
    return p.select("page_id", learning.language_of_path(F.expr(PATH)).alias("language"))


@on("documents", "markdown_sections")
def _(d):
    return learning.markdown_sections(d, "doc_id")


def _first(p: str) -> str:
    p = p.replace("'", "''")
    return f"nullif(regexp_extract(coalesce(text, ''), '{p}', 1), '')"


@on("conversations", "request_parameters", f"SELECT conv_id, turn, coalesce({', '.join(_first(p) for p in learning.PATHS)}) AS path, " + ", ".join(f"{_first(p)} AS {k}" for k, p in learning.PARAMETERS.items()) + " FROM conversations")
def _(c):
    return learning.request_parameters(c).select("conv_id", "turn", "path", *learning.PARAMETERS)


@on("embeddings", "similarity_matrix", f"WITH o AS ({OPTIONS}) SELECT x.option AS a, y.option AS b, CASE WHEN x.option = y.option THEN 1.0 ELSE round({COS.format(a='x.q', b='y.q')}, 6) END::DOUBLE AS similarity FROM o x, o y")
def _(e):
    return learning.similarity_matrix(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).withColumn("key", F.lit("layer")), "label", "key", "v")


LENGTHS = "SELECT 1024 << r_regionkey::INT AS context_length FROM region"
GB = lambda x: f"round(({x}) / 1073741824::DOUBLE, 6)"


@on("region", "memory_estimate", f"SELECT context_length, {GB('context_length * 1.7::DOUBLE')} AS kv_cache_bf16_gb, {GB('context_length * 0.425::DOUBLE')} AS kv_cache_4bit_gb, {GB('64e9::DOUBLE')} AS model_fp16_gb, {GB('16e9::DOUBLE')} AS model_4bit_gb, {GB('context_length * 1.7::DOUBLE + 64e9')} AS total_fp16_gb, {GB('context_length * 0.425::DOUBLE + 16e9')} AS total_4bit_gb FROM ({LENGTHS})")
def _(r):
    return learning.memory_estimate(r.select(F.expr("shiftleft(1024, cast(r_regionkey as int))").alias("context_length")), "context_length")


@on("events", "mark_failures", f"SELECT user_id, successes, failures + views AS failures, round(successes::DOUBLE / (successes + failures + views), 6) AS rate FROM ({SUCCESS}) JOIN (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views FROM events GROUP BY 1) USING (user_id)")
def _(e):
    return learning.mark_failures(metrics.success_by(e, "user_id", F.expr(OK)), e.filter("event_type = 'view'"), "user_id")


def _sessions(e: DataFrame) -> DataFrame:
    step = F.struct(F.col("event_type").alias("type"))
    t = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(step).alias("steps"), F.collect_list(F.when(F.col("event_type") == "purchase", step)).alias("decisions"), F.bool_and(F.expr(OK)).alias("success"))
    return t.groupBy("user_id").agg(F.collect_list(F.struct(F.col("day").cast("string").alias("task_type"), "steps", "decisions", "success")).alias("tasks"))


@on("events", "reasoning_types", "SELECT 'step' AS kind, event_type AS type, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'decision', event_type, count(*) FROM events WHERE event_type = 'purchase' GROUP BY 2")
def _(e):
    return learning.reasoning_types(_sessions(e))


@on("events", "reasoning_tasks", f"SELECT CASE WHEN bool_and({OK}) THEN 'success' ELSE 'failure' END AS outcome, strftime(ts, '%Y-%m-%d') AS task_type, count(*) AS steps, count(*) FILTER (WHERE event_type = 'purchase') AS decisions FROM events GROUP BY user_id, 2")
def _(e):
    return learning.reasoning_tasks(_sessions(e))


@on("events", "learning_report", f"WITH s AS (SELECT user_id, rate, successes + failures AS uses FROM ({SUCCESS})) (SELECT 'successful_approach' AS kind, user_id, rate, uses FROM s WHERE rate > 0.7 AND uses > 2 ORDER BY rate DESC, user_id LIMIT 10) UNION ALL (SELECT 'failure_pattern', user_id, rate, uses FROM s WHERE rate < 0.4 ORDER BY rate, user_id LIMIT 10)")
def _(e):
    return learning.learning_report(metrics.success_by(e, "user_id", F.expr(OK)), "user_id")


@on("events", "reflection", f"SELECT *, failed_calls > 0 OR confidence < 0.7 OR response_length < 20 AS needs_reflection FROM (SELECT user_id, count(*) FILTER (WHERE NOT ({OK})) AS failed_calls, round(avg(({OK})::INT), 6) AS confidence, max(length(coalesce(props, ''))) AS response_length FROM events GROUP BY 1)")
def _(e):
    return learning.reflect(e, "user_id", F.expr(OK), F.col("props"))


@on("events", "ttl_cache")
def _(e):
    return learning.ttl_cache(e, "user_id", "ts", 3600)


@on("events", "due_check", "SELECT user_id, TIMESTAMP '2024-01-20 00:00:00' >= max(ts) + INTERVAL 24 HOUR AS due, max(ts) + INTERVAL 24 HOUR AS next_due FROM events GROUP BY 1")
def _(e):
    d = e.groupBy("user_id").agg(F.max("ts").alias("last_run")).withColumns({"enabled": F.lit(True), "interval_hours": F.lit(24)})
    return learning.due(d, "user_id", "2024-01-20 00:00:00")


@on("embeddings", "hash_embedding_256", "SELECT vec_id, i::INT AS place, round(('0x' || substr(h, (i % 32 * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE, 6) AS v FROM (SELECT vec_id, sha256(vec_id::VARCHAR) AS h FROM embeddings), range(256) AS r(i)")
def _(e):
    return e.select("vec_id", F.posexplode(learning.hash_embedding(F.col("vec_id"))).alias("place", "v")).withColumn("v", F.round("v", 6))
