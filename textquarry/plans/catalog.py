"""Every query of the library with its SQL twin. A query without one is held against goldens in tests/."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import arrow, conversations, corpus, metrics, nlp, retrieval, texts
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Queries that SQL cannot express, and the tests that hold them against plain Python.
DONE_BY_TESTS: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(table: str, name: str, sql: str | None = None):
    """Register a query over one table (or more, separated by blanks)."""
    def put(f):
        QUERIES[name] = lambda s, d: f(*[read(s, d, t) for t in table.split()])
        if sql:
            ORACLES[name] = sql
        return f
    return put


def sql_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def sql_hits(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')::INT" for w in words) + ")"


def sql_re(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}')"


def sql_count(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, '{p.replace(chr(39), chr(39) * 2)}'))"


# --- corpus: STR-01..04, FLT-02/03, AGG-14/16/17, PIPE-01/02, SET-05/06, HASH-01 ---------------------------------
LENGTH = "CASE WHEN length(t) < 20 THEN 0.0 WHEN length(t) > 128000 THEN 0.2 WHEN length(t) < 100 THEN 0.3 WHEN length(t) <= 10000 THEN 1.0 ELSE greatest(0.5, 1.0 - (length(t) - 10000) / 118000.0::DOUBLE) END"
BLANKS = "len(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '\\S')))"
CODE = (
    "CASE WHEN length(t) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.5::DOUBLE + CASE WHEN regexp_matches(t, '```[\\s\\S]*?```') THEN 0.2::DOUBLE ELSE 0 END + least(0.2::DOUBLE, ("
    + " + ".join(f"{sql_re('t', p)}::INT" for p in S.CODE_PATTERNS)
    + ") * 0.05::DOUBLE) - CASE WHEN " + " + ".join(sql_count("t", p) for p in S.PLACEHOLDERS) + f" + {BLANKS} > 5 THEN 0.3::DOUBLE ELSE 0 END)) END"
)
SCORED = f"SELECT doc_id, lang, t, ({LENGTH})::DOUBLE AS ls, ({CODE})::DOUBLE AS cs FROM (SELECT *, coalesce(text, '') AS t FROM documents)"
UNIQUE = "SELECT * FROM documents WHERE regexp_matches(text, '\\S') QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1"


@on("documents", "quality_scores", f"SELECT doc_id, round(ls, 6) AS length_score, round(cs, 6) AS code_score, round(0.3 * ls + 0.4 * cs + 0.15, 6) AS overall FROM ({SCORED})")
def _(d):
    return corpus.with_scores(d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("length_score", "code_score", "overall")])


@on("documents", "quality_issues", f"SELECT doc_id, (CASE WHEN ls < 0.3 THEN 'low_length' ELSE '' END) || (CASE WHEN cs < 0.2 THEN 'low_code' ELSE '' END) AS issues FROM ({SCORED})")
def _(d):
    return corpus.with_scores(d).select("doc_id", F.array_join(S.issues(F.col("length_score"), F.col("code_score"), F.col("structure_score")), "").alias("issues"))


@on("documents", "length_filter", "SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '\\S') AND length(text) BETWEEN 10 AND 128000")
def _(d):
    return corpus.length_filter(d).select("doc_id", F.length("text").cast("long").alias("n"))


@on("documents", "dedup_exact", "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS digest FROM documents GROUP BY 2")
def _(d):
    return corpus.first_of_content(d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@on("documents", "quality_pipeline", f"""WITH i AS (SELECT lang, count(*) AS total_input FROM documents GROUP BY 1),
 u AS (SELECT lang, round(avg(0.3 * ls + 0.4 * cs + 0.15), 6) AS avg_score, count(*) AS n, count(*) FILTER (WHERE 0.3 * ls + 0.4 * cs + 0.15 >= 0.4) AS final_count
       FROM ({SCORED.replace('FROM documents', f'FROM ({UNIQUE})')}) GROUP BY 1)
 SELECT lang, total_input, total_input - coalesce(n, 0) AS removed, coalesce(final_count, 0) AS final_count, avg_score FROM i LEFT JOIN u USING (lang)""")
def _(d):
    return corpus.quality_pipeline(d)


SPLIT = "CASE WHEN ('0x' || substr(md5('split' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.9 THEN 'train' ELSE 'eval' END"


@on("documents", "train_eval_split", f"SELECT doc_id, {SPLIT} AS split FROM documents")
def _(d):
    return corpus.hash_split(d.select("doc_id"), "doc_id")


@on("documents", "random_sample", "SELECT doc_id FROM documents ORDER BY md5('sample' || doc_id), doc_id LIMIT 50")
def _(d):
    return corpus.sample_by_hash(d.select("doc_id"), "doc_id", 50)


@on("documents", "prep_pipeline", f"SELECT doc_id, {SPLIT} AS split, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_tokens FROM ({UNIQUE}) WHERE length(text) BETWEEN 10 AND 128000")
def _(d):
    return corpus.prep_pipeline(d)


@on("documents", "duplication_stats", "SELECT sum(n)::BIGINT AS total, count(*) AS distinct_prompts, round(sum(n) / count(*), 6) AS avg_duplication, max(n) AS most FROM (SELECT count(*) AS n FROM documents GROUP BY coalesce(text, ''))")
def _(d):
    return corpus.duplication(d)


@on("documents", "content_ids", "SELECT doc_id, substr(sha256(text), 1, 16) AS sha16, substr(md5(text), 1, 16) AS md16 FROM documents")
def _(d):
    return d.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("sha16"), F.substring(F.md5("text"), 1, 16).alias("md16"))


# --- records: SRC-01, JSON-01/02, SRC-09, PRJ-14..16 --------------------------------------------------------------
@on("events", "jsonl_lenient", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE json_valid(props)")
def _(e):
    return files.lenient(e, "props").select("event_id", F.expr("try_variant_get(record, '$.k', 'bigint')").alias("k"))


@on("events", "json_digest", "SELECT event_id, sha256(replace(props, ' ', '')) AS digest FROM events")
def _(e):
    return e.select("event_id", F.sha2(F.to_json(F.try_parse_json("props")), 256).alias("digest"))


@on("documents", "line_range", "SELECT doc_id, i::INT AS line_no, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i BETWEEN 2 AND 4")
def _(d):
    return texts.line_range(d, 1, 3)


@on("documents", "token_estimate", "SELECT doc_id, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE, 6) AS tokens FROM documents")
def _(d):
    return d.select("doc_id", F.round(S.tokens_estimate(F.col("text")).cast("double"), 6).alias("tokens"))


@on("documents", "brief_summary", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:3], chr(10)) AS brief FROM documents")
def _(d):
    return d.select("doc_id", F.array_join(texts.brief(F.col("text"), 3), "\n").alias("brief"))


@on("events", "structure_detect", "SELECT event_id, json_valid(props) AS is_json FROM events")
def _(e):
    return e.select("event_id", F.try_parse_json("props").isNotNull().alias("is_json"))


# --- conversations: PRJ-01..08, FLT-01, WIN, PIPE-13 ---------------------------------------------------------------
@on("conversations", "extract_content", "SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS content FROM conversations GROUP BY 1")
def _(c):
    return conversations.extract_content(c)


@on("conversations", "extract_response", "SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS response FROM conversations GROUP BY 1")
def _(c):
    return conversations.extract_response(c)


@on("conversations", "format_sample", "SELECT conv_id, regexp_replace(string_agg('### ' || upper(role[1]) || role[2:] || ':' || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS formatted FROM conversations GROUP BY 1")
def _(c):
    return conversations.format_sample(c)


@on("conversations", "format_instruction", """SELECT conv_id, CASE WHEN length(s) > 0 THEN '### System:' || chr(10) || s || chr(10) || chr(10) ELSE '' END || '### User:' || chr(10) || u || chr(10) || chr(10) || '### Assistant:' || chr(10) || a AS formatted
 FROM (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'system') AS s, arg_max(text, turn) FILTER (WHERE role = 'user') AS u, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY 1) WHERE u IS NOT NULL AND a IS NOT NULL""")
def _(c):
    return conversations.format_instruction(c)


@on("conversations", "chatml_render", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS formatted FROM conversations GROUP BY 1")
def _(c):
    return conversations.chatml(c)


@on("conversations", "turn_template", "SELECT conv_id, string_agg('<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10) || text || '<end_of_turn>' || chr(10), '' ORDER BY turn) AS formatted FROM conversations GROUP BY 1")
def _(c):
    return conversations.turn_template(c)


@on("conversations", "completeness", "SELECT conv_id, u AND a AND t AS complete, round(least(1.0, 0.5 + CASE WHEN u AND a THEN 0.3 ELSE 0 END + CASE WHEN s THEN 0.1 ELSE 0 END), 6)::DOUBLE AS structure_score FROM (SELECT conv_id, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a, bool_or(role = 'system') AS s, bool_or(regexp_matches(text, '\\S')) AS t FROM conversations GROUP BY 1)")
def _(c):
    return conversations.completeness(c)


@on("conversations", "last_n_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def _(c):
    return corpus.last_n(c, "conv_id", "turn", 2).select("conv_id", "turn", "role")


WORDS = "list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: length(w) > 3))"


@on("conversations", "conversation_quality", f"""WITH d AS (SELECT conv_id, role, lower(coalesce(text, '')) AS t, row_number() OVER w - 1 AS i,
   lag(lower(coalesce(text, ''))) OVER w AS p1, lag(lower(coalesce(text, '')), 2) OVER w AS p2, lag(lower(coalesce(text, '')), 3) OVER w AS p3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 h AS (SELECT *, {' OR '.join(f"coalesce(regexp_matches({p}, '\\S') AND contains(t, regexp_split_to_array(regexp_replace({p}, '^\\s+', ''), '\\s+')[1]), false)" for p in ('p1', 'p2', 'p3'))} AS refers,
   len(list_intersect({WORDS.format('t')}, {WORDS.format("coalesce(p1, '')")})) > 0 AS shares FROM d),
 g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE i >= 2 AND refers) AS kept, count(*) FILTER (WHERE i >= 1 AND shares) AS near,
   count(*) FILTER (WHERE i >= 1 AND {sql_any('t', conversations.CORRECTIONS)}) AS fixed, count(*) FILTER (WHERE role = 'user' AND {sql_any('t', conversations.SATISFIED)}) AS glad FROM h GROUP BY 1)
 SELECT conv_id, n AS n_messages, round(CASE WHEN n < 3 THEN 1.0 ELSE kept::DOUBLE / (n - 2) END, 6) AS context_retention, round(CASE WHEN n < 2 THEN 1.0 ELSE near::DOUBLE / (n - 1) END, 6) AS coherence,
   round(CASE WHEN n < 3 THEN 1.0 ELSE fixed::DOUBLE / (n - 1) END, 6) AS error_recovery, round(glad::DOUBLE / n * 0.5 + least(n, 20) / 20.0 * 0.5, 6)::DOUBLE AS satisfaction FROM g""")
def _(c):
    return conversations.conversation_quality(c)


# --- rules: NLP, STR-26, PIPE-03/12 --------------------------------------------------------------------------------
T = "lower(coalesce(text, ''))"
STRIPPED = f"regexp_replace({T}, '^\\s+|\\s+$', '', 'g')"
INTENTS = " UNION ALL ".join(
    f"SELECT conv_id, turn, {i} AS i, '{k}' AS intent, {sql_hits('t', w)} + 1.5::DOUBLE * (" + " + ".join(f"{sql_re('t', p)}::INT" for p in ps) + ") AS raw_score FROM c"
    for i, (k, (w, ps)) in enumerate(nlp.INTENTS.items()))


@on("conversations", "intent_detect", f"""WITH c AS (SELECT conv_id, turn, {STRIPPED} AS t FROM conversations), s AS ({INTENTS}), r AS (SELECT *, raw_score / max(raw_score) OVER (PARTITION BY conv_id, turn) AS share, row_number() OVER (PARTITION BY conv_id, turn ORDER BY raw_score DESC, i) AS place FROM s WHERE raw_score > 0)
 SELECT c.conv_id, c.turn, coalesce(max(intent) FILTER (WHERE place = 1), 'general') AS intent, coalesce(max(raw_score), 0.0)::DOUBLE AS raw_score, 1.0::DOUBLE AS confidence,
 coalesce(string_agg(intent || ':' || (round(share, 6) * 1000000)::BIGINT, '|' ORDER BY place) FILTER (WHERE place BETWEEN 2 AND 4 AND round(share, 6) >= 0.3), '') AS alternatives FROM c LEFT JOIN r USING (conv_id, turn) GROUP BY 1, 2""")
def _(c):
    others = F.transform("alternatives", lambda x: F.concat(x.intent, F.lit(":"), F.round(x.confidence * 1_000_000).cast("bigint").cast("string")))
    return nlp.intents(c).select("conv_id", "turn", "intent", F.col("raw_score").cast("double").alias("raw_score"), "confidence", F.array_join(others, "|").alias("alternatives"))


@on("conversations", "intent_multi", f"WITH c AS (SELECT conv_id, turn, {STRIPPED} AS t FROM conversations), s AS ({INTENTS}) SELECT conv_id, turn, intent, raw_score::DOUBLE AS raw_score FROM s WHERE raw_score >= 1")
def _(c):
    return nlp.intents_multi(c).select("conv_id", "turn", "intent", F.col("raw_score").cast("double").alias("raw_score"))


SENTIMENT = f"""SELECT {{key}}, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
 round(CASE WHEN p > n THEN least(0.5 + (p - n) * 0.1::DOUBLE, 0.95) WHEN n > p THEN greatest(0.5 + (p - n) * 0.1::DOUBLE, 0.05) ELSE 0.5 END, 6)::DOUBLE AS score,
 CASE WHEN n > p THEN 'empathetic' WHEN p > n THEN 'enthusiastic' WHEN {sql_any('t', nlp.FRUSTRATED)} THEN 'supportive' WHEN {sql_any('t', nlp.ASKING)} THEN 'helpful' ELSE 'neutral' END AS tone
 FROM (SELECT *, {sql_hits('t', nlp.POSITIVE)} AS p, {sql_hits('t', nlp.NEGATIVE)} AS n FROM (SELECT *, {T} AS t FROM {{table}}))"""


@on("documents", "sentiment", SENTIMENT.format(key="doc_id", table="documents"))
def _(d):
    return nlp.sentiment(d).select("doc_id", "sentiment", "score", "tone")


@on("conversations", "chat_analysis", f"SELECT sentiment, tone, count(*) AS n FROM ({SENTIMENT.format(key='conv_id', table='conversations')}) GROUP BY 1, 2")
def _(c):
    return nlp.sentiment(c).groupBy("sentiment", "tone").agg(F.count("*").alias("n"))


EMOTIONS = " UNION ALL ".join(f"SELECT doc_id, '{e}' AS emotion, round({sql_hits('t', w)} / {len(w)}.0::DOUBLE, 6) AS score FROM d" for e, w in nlp.EMOTIONS.items())


@on("documents", "emotions", f"WITH d AS (SELECT doc_id, {T} AS t FROM documents) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, emotion))::INT AS rank, emotion, score FROM ({EMOTIONS}) WHERE score > 0 QUALIFY rank <= 3")
def _(d):
    return nlp.emotions(d, "doc_id")


ROUTE = "CASE " + " ".join(f"WHEN {' AND '.join(sql_any('t', g) for g in groups)} THEN '{tool}'" for groups, tool in nlp.ROUTES) + " ELSE 'BashTool' END"


@on("documents", "route_tool", f"SELECT doc_id, {ROUTE} AS tool FROM (SELECT doc_id, {T} AS t FROM documents)")
def _(d):
    return nlp.route(d).select("doc_id", "tool")


KINDS = ("EMAIL", "PHONE", "IP_ADDRESS", "URL")


@on("documents", "entity_texts", "SELECT doc_id, kind, entity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '{nlp.ENTITIES[k]}')) AS entity FROM documents" for k in KINDS) + ") GROUP BY 1, 2, 3")
def _(d):
    return nlp.entity_texts(d, "doc_id", kinds=KINDS)


@on("documents", "entity_spans")
def _(d):
    return nlp.entity_spans(d, "doc_id")


@on("documents", "entity_summary")
def _(d):
    return metrics.count_by(nlp.entity_spans(d, "doc_id"), "kind")


@on("documents", "pattern_mine", "SELECT pattern_type, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS pattern_type FROM documents WHERE {sql_re('text', p)}" for k, p in nlp.PATTERNS.items()) + ") GROUP BY 1")
def _(d):
    return nlp.mine_patterns(d)


# --- text, web, code: STR, FLT-07..13 ------------------------------------------------------------------------------
STOPS = ", ".join(f"'{w}'" for w in texts.STOP_WORDS)
KEYWORDS = f"list_filter(regexp_extract_all({T}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({STOPS}))"
TERMS = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({KEYWORDS}) AS term FROM documents) GROUP BY 1, 2"


@on("documents", "keywords", f"SELECT doc_id, len({KEYWORDS}) AS n, md5(array_to_string({KEYWORDS}, ' ')) AS digest FROM documents")
def _(d):
    k = texts.keywords(F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("digest"))


@on("documents", "bow_tf", f"SELECT doc_id, term, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS weight FROM ({TERMS})")
def _(d):
    return texts.term_vectors(d).withColumn("weight", F.round("weight", 6))


@on("documents", "detect_language", f"""SELECT doc_id, CASE WHEN regexp_matches(t, '\\bdef\\s+\\w+\\s*\\(') OR regexp_matches(t, '\\bimport\\s+\\w+') THEN 'python' WHEN regexp_matches(t, '\\bfunction\\s+\\w+\\s*\\(') OR regexp_matches(t, 'const\\s+\\w+\\s*=') THEN 'javascript'
 WHEN regexp_matches(t, '\\bpublic\\s+class\\s+\\w+') OR regexp_matches(t, '\\bSystem\\.out\\.print') THEN 'java' WHEN regexp_matches(t, '\\bpackage\\s+main') OR regexp_matches(t, '\\bfunc\\s+\\w+\\s*\\(') THEN 'go'
 WHEN regexp_matches(t, '\\bfn\\s+\\w+\\s*\\(') OR regexp_matches(t, '\\blet\\s+mut\\s+') THEN 'rust' WHEN regexp_matches(t, '#include\\s*<') OR regexp_matches(t, '\\bint\\s+main\\s*\\(') THEN 'c' ELSE 'unknown' END AS code_language FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def _(d):
    return d.select("doc_id", S.language_of(F.coalesce("text", F.lit(""))).alias("code_language"))


HTML = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@on("pages", "html_text", f"SELECT page_id, {HTML} AS content FROM pages")
def _(p):
    return p.select("page_id", S.readable(F.col("html")).alias("content"))


@on("pages", "html_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=[\"'']([^\"'']+)[\"'']', 1)[1:50]) AS link FROM pages")
def _(p):
    return p.select("page_id", F.explode(texts.links(F.col("html"))).alias("link"))


META = {"title": "(?i)<title[^>]*>([^<]+)</title>", "description": "(?i)<meta[^>]+name=[\"'']description[\"''][^>]+content=[\"'']([^\"'']+)[\"'']", "og_image": "(?i)<meta[^>]+property=[\"'']og:image[\"''][^>]+content=[\"'']([^\"'']+)[\"'']"}


@on("pages", "html_meta", "SELECT page_id, " + ", ".join(f"nullif(trim(regexp_extract(html, '{p}', 1)), '') AS {k}" for k, p in META.items()) + " FROM pages")
def _(p):
    return texts.page_meta(p).select("page_id", *META)


COUNTS = {"functions": "def\\s+\\w+", "methods": "def\\s+\\w+\\(self", "classes": "class\\s+\\w+", "ifs": "\\bif\\s+", "fors": "\\bfor\\s+", "whiles": "\\bwhile\\s+", "tries": "\\btry\\s+"}
COMPLEX = "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*#'))) AS loc, " + ", ".join(f"{sql_count('text', p)} AS {k}" for k, p in COUNTS.items()) + " FROM documents"


@on("documents", "complexity", f"SELECT *, 1 + ifs + fors + whiles + tries AS cyclomatic FROM ({COMPLEX})")
def _(d):
    return texts.complexity(d).select("doc_id", "loc", *COUNTS, "cyclomatic")


@on("documents", "maintainability", f"SELECT doc_id, round(CASE WHEN loc = 0 THEN 100 ELSE greatest(0, 100 - 20 * least(loc / 100, 1) - 30 * least((1 + ifs + fors + whiles + tries) / 20, 1)) END, 6)::DOUBLE AS maintainability FROM ({COMPLEX})")
def _(d):
    return texts.complexity(d).select("doc_id", "maintainability")


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents"


@on("documents", "code_issues", f"""SELECT doc_id, 'todo' AS issue, line_no FROM ({LINES}) WHERE regexp_matches(upper(line), 'TODO|FIXME') UNION ALL SELECT doc_id, 'long_line', line_no FROM ({LINES}) WHERE length(line) > 120
 UNION ALL SELECT doc_id, 'empty_except', NULL FROM documents WHERE regexp_matches(text, 'except\\s*:\\s*\\n\\s*pass') UNION ALL SELECT doc_id, 'hardcoded_credentials', NULL FROM documents WHERE regexp_matches(text, '(?i)password\\s*=\\s*["'']')
 UNION ALL SELECT doc_id, 'debug_print', NULL FROM documents WHERE regexp_matches(text, '\\bprint\\s*\\(') AND NOT starts_with(text, '# debug') UNION ALL SELECT doc_id, 'global_variable', NULL FROM documents WHERE regexp_matches(text, '(?m)^([A-Z_][A-Z0-9_]*)\\s*=\\s*')""")
def _(d):
    return texts.code_issues(d)


@on("documents", "grep_lines", f"SELECT doc_id, line_no, line FROM ({LINES}) WHERE regexp_matches(line, 'tion\\b.*the')")
def _(d):
    return texts.grep(d, "tion\\b.*the")


@on("documents", "grep_count", f"SELECT doc_id, count(*) AS n FROM ({LINES}) WHERE regexp_matches(line, '(?i)\\bder\\b') GROUP BY 1")
def _(d):
    return metrics.count_by(texts.grep(d, "\\bder\\b", ignore_case=True), "doc_id")


@on("documents", "grep_context", f"SELECT doc_id, line_no, line, before, after FROM (SELECT *, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM ({LINES})) WHERE regexp_matches(line, 'worthless|sche?n')")
def _(d):
    return texts.grep_context(d, "worthless|sche?n", 2, 2)


@on("documents", "substring_search", f"SELECT doc_id FROM documents WHERE contains({T}, 'the on')")
def _(d):
    return texts.substring_search(d, "The On").select("doc_id")


@on("pages", "domain_filter", "SELECT page_id, url FROM pages WHERE NOT (contains(url, 'example.org') OR contains(url, '7'))")
def _(p):
    return texts.domain_filter(p, "url", ["example.org", "7"]).select("page_id", "url")


@on("pages", "glob_match", "SELECT page_id FROM pages WHERE regexp_matches(url, '^(?:.*/)?[^/]*1[^/]$')")
def _(p):
    return texts.glob_match(p, "url", "**/*1?").select("page_id")


@on("documents", "regex_replace", "SELECT doc_id, len(regexp_extract_all(text, '[#$%&*]{3}')) AS n_replaced, regexp_replace(text, '[#$%&*]{3}', '', 'g') AS replaced FROM documents")
def _(d):
    return texts.replace_counted(d, "[#$%&*]{3}", "").select("doc_id", "n_replaced", "replaced")


@on("documents", "line_delete", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, ' \\| ')), chr(10)) AS kept FROM documents")
def _(d):
    return d.select("doc_id", texts.delete_lines(F.col("text"), " \\| ").alias("kept"))


@on("documents", "snippets", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS snippet FROM documents")
def _(d):
    return d.select("doc_id", texts.snippet(F.col("text"), 80).alias("snippet"))


@on("documents", "code_fence", "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_extract(text, '(?s)```python(.*?)```', 1), '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(regexp_extract(text, '(?s)```(.*?)```', 1), '^\\s+|\\s+$', '', 'g'), ''), regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS code FROM documents")
def _(d):
    return d.select("doc_id", texts.code_fence(F.col("text")).alias("code"))


@on("pages", "answer_extract", "SELECT page_id, coalesce(nullif(regexp_extract(u, '(?i)(?:the\\s+)?answer\\s+is\\s+(\\d+)', 1), ''), nullif(regexp_extract(u, '=\\s*(\\d+)', 1), ''), nullif(regexp_extract(u, '(\\d+)\\s*$', 1), ''), regexp_extract_all(u, '\\d+')[-1], u) AS answer FROM (SELECT page_id, regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS u FROM pages)")
def _(p):
    return p.select("page_id", texts.final_answer(F.col("url")).alias("answer"))


# --- metrics, stores, evaluation -----------------------------------------------------------------------------------
OK = "event_type <> 'error'"


@on("events", "count_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(e):
    return metrics.count_by(e, "event_type")


SUCCESS = f"SELECT user_id, count(*) FILTER (WHERE {OK}) AS successes, count(*) FILTER (WHERE NOT ({OK})) AS failures, round(count(*) FILTER (WHERE {OK})::DOUBLE / count(*), 6) AS rate FROM events GROUP BY 1"


@on("events", "success_by_user", SUCCESS)
def _(e):
    return metrics.success_by(e, "user_id", F.expr(OK))


@on("events", "rating_stats", "SELECT count(*) AS total, round(coalesce(avg(value) FILTER (WHERE event_type = 'view'), 0), 6) AS avg_rating, count(*) FILTER (WHERE event_type = 'purchase') AS processed, count(*) FILTER (WHERE event_type <> 'purchase') AS unprocessed FROM events")
def _(e):
    return metrics.rating_stats(e, F.when(F.col("event_type") == "view", F.col("value")), F.col("event_type") == "purchase")


@on("events", "last100_avg", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY 1")
def _(e):
    return metrics.last_average(e, "event_type", [F.desc("ts"), F.desc("event_id")], "value")


@on("events", "hourly_trend", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def _(e):
    return metrics.hourly(e)


@on("events", "period_summary", "SELECT " + ", ".join(f"round(coalesce(avg(value) FILTER (WHERE event_type = '{k}'), 0), 6) AS avg_{k}" for k in ("click", "error", "purchase", "view")) + " FROM events")
def _(e):
    return metrics.period_summary(e, ["click", "error", "purchase", "view"])


@on("events", "latency_stats", "SELECT event_type, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events WHERE value > 0 GROUP BY 1")
def _(e):
    return e.filter("value > 0").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


@on("events", "retention_filter", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY")
def _(e):
    return e.filter(F.col("ts") > F.expr("timestamp_ntz'2024-01-20 00:00:00' - interval 10 days")).select("event_id")


SESSIONS = "SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 60 MINUTE, true)::INT AS new FROM events)"


@on("events", "sessions_timeout", f"SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM ({SESSIONS}) GROUP BY 1, 2")
def _(e):
    return metrics.sessions(e)


@on("events", "session_eviction", "SELECT user_id, max(ts) AS last_activity FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(e):
    return metrics.evict(e, "user_id", "ts", 10)


@on("events", "latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def _(e):
    return metrics.latest(e, "user_id", F.struct("ts", "event_id"), "event_type", "value")


@on("events labels", "delete_by_key", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def _(e, lab):
    return metrics.without(e, lab.select(F.col("doc_id").alias("event_id")), "event_id").select("event_id")


@on("events", "running_mean", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS running_mean FROM events")
def _(e):
    return metrics.running_mean(e, "user_id", "event_id", "value")


@on("events", "request_demand", "SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def _(e):
    return metrics.demand(e, "user_id", "ts", 3600)


@on("events", "top_patterns", f"SELECT * FROM ({SUCCESS}) WHERE rate >= 0.5 ORDER BY rate DESC, successes DESC, user_id LIMIT 10")
def _(e):
    return metrics.top_by_rate(metrics.success_by(e, "user_id", F.expr(OK)), "user_id", 10, 0.5)


@on("events", "pending_improvements", "SELECT event_id, value, round(value / 10, 6) AS score FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 10")
def _(e):
    return e.filter("event_type = 'error'").select("event_id", "value", F.round(F.col("value") / 10, 6).alias("score")).orderBy(F.desc("value"), "event_id").limit(10)


@on("events", "session_recommendations", "SELECT user_id, failures, least(10, 5 + failures) AS priority FROM (SELECT user_id, count(*) FILTER (WHERE event_type IN ('error', 'click', 'view')) AS failures, count(*) FILTER (WHERE event_type NOT IN ('error', 'click', 'view')) AS successes FROM events GROUP BY 1) WHERE failures > successes")
def _(e):
    return metrics.recommendations(metrics.success_by(e, "user_id", ~F.col("event_type").isin("error", "click", "view")), "user_id")


STEPS = "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(*) AS n_steps, count(*) FILTER (WHERE event_type = 'signup') AS n_decisions FROM events GROUP BY 1"


@on("events", "failure_suggestions", f"WITH s AS ({STEPS}) SELECT user_id, 8 AS priority, 'many_errors' AS reason FROM s WHERE n_errors > 2 UNION ALL SELECT user_id, 7, 'many_steps' FROM s WHERE n_steps > 10 UNION ALL SELECT user_id, 6, 'no_decisions' FROM s WHERE n_decisions = 0")
def _(e):
    return metrics.suggestions(e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count("*").alias("n_steps"), F.count_if(F.col("event_type") == "signup").alias("n_decisions")), "user_id")


@on("events", "training_from_knowledge", f"(SELECT user_id, 'positive' AS kind FROM ({SUCCESS}) WHERE rate > 0.6 ORDER BY rate DESC, user_id LIMIT 20) UNION ALL (SELECT user_id, 'negative' FROM ({SUCCESS}) WHERE rate < 0.4 ORDER BY rate, user_id LIMIT 10)")
def _(e):
    return metrics.training_from_knowledge(metrics.success_by(e, "user_id", F.expr(OK)), "user_id")


@on("events", "improvement_pct", """SELECT event_type, round(CASE WHEN b = 0 THEN CASE WHEN c > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE (c - b) / b * 100 END, 6) AS improvement_pct FROM (SELECT event_type, round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS c, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS b FROM events GROUP BY 1)""")
def _(e):
    score = lambda r: e.filter(F.col("event_id") % 2 == r).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("score"))  # noqa: E731  two runs
    return metrics.improvement(score(0), score(1), "event_type")


@on("nation region", "config_full_outer", "SELECT coalesce(n.n_nationkey, r.r_regionkey) AS key, coalesce(n.n_name, r.r_name) AS value, n.n_name IS NOT NULL AS is_set FROM nation n FULL JOIN region r ON n.n_nationkey = r.r_regionkey + 23 AND true")
def _(n, r):
    return metrics.config_full_outer(n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), r.select((F.col("r_regionkey") + 23).alias("key"), F.col("r_name").alias("default_value")))


ORACLES["config_full_outer"] = "SELECT coalesce(n.n_nationkey, r.r_regionkey + 23) AS key, coalesce(n.n_name, r.r_name) AS value, n.n_name IS NOT NULL AS is_set FROM nation n FULL JOIN region r ON n.n_nationkey = r.r_regionkey + 23"


@on("customer orders", "available_tools", "SELECT c_mktsegment, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS available FROM customer SEMI JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(c, o):
    d = c.select("c_mktsegment", "c_nationkey", F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")).distinct(), "k", "left_semi")
    return metrics.available(d.select("c_mktsegment", F.col("c_nationkey").cast("string").alias("n")), d.select(F.col("c_nationkey").cast("string").alias("n")), "n", "c_mktsegment")



@on("events", "pass_at_k", f"SELECT user_id, n, c, round(CASE WHEN n < 3 THEN 0 WHEN n - c < 3 THEN 1 ELSE 1 - ((n - c) * (n - c - 1) * (n - c - 2))::DOUBLE / (n * (n - 1) * (n - 2)) END, 6)::DOUBLE AS pass_unbiased, round(1 - pow(1 - c::DOUBLE / n, 3), 6) AS pass_replaced FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY 1)")
def _(e):
    return metrics.passes(e, "user_id", F.col("event_type") == "purchase", 3)


@on("events", "category_accuracy", "SELECT event_type, n, tool_accuracy, param_accuracy, round((tool_accuracy + param_accuracy) / 2, 6) AS overall FROM (SELECT event_type, count(*) AS n, round(avg((value > 10)::INT), 6) AS tool_accuracy, round(avg((user_id % 2 = 0)::INT), 6) AS param_accuracy FROM events GROUP BY ROLLUP (event_type))")
def _(e):
    return metrics.category_accuracy(e, "event_type", F.col("value") > 10, F.col("user_id") % 2 == 0)


@on("events", "worst_tools", f"SELECT user_id, rate FROM ({SUCCESS}) ORDER BY rate, user_id LIMIT 5")
def _(e):
    return metrics.success_by(e, "user_id", F.expr(OK)).select("user_id", "rate").orderBy("rate", "user_id").limit(5)


@on("events", "cron_due", "SELECT event_id FROM events WHERE minute(ts) % 5 = 0 AND dayofweek(ts) IN (1, 2)")
def _(e):
    return metrics.cron_matches(e, "ts", "*/5", "*", "1,2").select("event_id")


# --- retrieval, vectors, graph -------------------------------------------------------------------------------------
ASK = "the ention thereon mit der attention"
QUERY_TERMS = f"SELECT DISTINCT unnest(list_filter(regexp_extract_all('{ASK}', '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({STOPS}))) AS term"
FOUND = f"""WITH d AS ({TERMS}), v AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM d),
 q AS (SELECT term, 1 / sqrt(count(*) OVER ()) AS qw FROM ({QUERY_TERMS}) SEMI JOIN d USING (term))
 SELECT doc_id, round(sum(w * qw), 6) AS score FROM v JOIN q USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""


@on("documents", "rag_retrieve", FOUND)
def _(d):
    return retrieval.retrieve(d, ASK, 20)


@on("documents", "keyword_candidates", f"SELECT doc_id FROM documents WHERE list_has_any({KEYWORDS}, (SELECT list(term) FROM ({QUERY_TERMS})))")
def _(d):
    return retrieval.candidates(d, ASK).select("doc_id")


@on("documents", "rag_context")
def _(d):
    return retrieval.budget_context(retrieval.retrieve(d, ASK, 20), d, 5_000)


COS = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])) + 1e-8)"


def _vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()
    q = F.lit([float(x) for x in first[0]]) if first else F.array().cast("array<double>")
    return retrieval.vector_topk(e, q, 10, 0.0)


QUERIES["vector_topk"] = _vector_topk
ORACLES["vector_topk"] = f"SELECT vec_id, round({COS.format(a='embedding', b='(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)')}, 6) AS score FROM embeddings WHERE round({COS.format(a='embedding', b='(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)')}, 6) >= 0 ORDER BY 2 DESC, 1 LIMIT 10"


@on("embeddings", "weighted_mean_vector", "SELECT place::INT AS place, round(sum(v * w) / sum(w), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS place, label + 1 AS w FROM embeddings) GROUP BY 1")
def _(e):
    return retrieval.weighted_mean_vector(e, F.col("label") + 1)


@on("embeddings", "hash_embedding", "SELECT vec_id, round(('0x' || substr(sha256(vec_id::VARCHAR), 1, 2))::INT / 255.0::DOUBLE, 6) AS first_place FROM embeddings")
def _(e):
    return e.select("vec_id", F.round(F.conv(F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 2), 16, 10).cast("double") / 255, 6).alias("first_place"))




def _edges(c: DataFrame) -> DataFrame:
    return c.select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey"), F.lit(40)).alias("dst"), F.col("o_orderpriority").alias("type"))


EDGES = "(SELECT o_custkey AS src, o_orderkey % 40 AS dst, o_orderpriority AS type FROM orders)"


@on("orders", "graph_relationships", f"SELECT src, dst, type FROM {EDGES} WHERE src = 7 OR dst = 7")
def _(o):
    return retrieval.neighbours(_edges(o), 7)


@on("orders", "graph_similar", f"""WITH e AS (SELECT DISTINCT src, dst FROM {EDGES}), m AS (SELECT dst FROM e WHERE src = 7) SELECT src AS node, round(c::DOUBLE / (s + (SELECT count(*) FROM m) - c), 6) AS jaccard
 FROM (SELECT src, count(*) AS s, count(*) FILTER (WHERE dst IN (SELECT dst FROM m)) AS c FROM e WHERE src <> 7 GROUP BY 1) WHERE c > 0 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(o):
    return retrieval.similar_nodes(_edges(o), 7)


@on("orders", "graph_subgraph", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {EDGES}), n(node, d) AS (SELECT 7, 0 UNION SELECT e.dst, d + 1 FROM e JOIN n ON e.src = n.node WHERE d < 2) SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def _(o):
    return retrieval.subgraph(_edges(o), 7, 2)


@on("orders", "graph_stats", f"SELECT count(*) AS n_edges, count(DISTINCT type) AS edge_types, (SELECT count(*) FROM (SELECT src FROM {EDGES} UNION SELECT dst FROM {EDGES})) AS n_nodes FROM {EDGES}")
def _(o):
    return retrieval.graph_stats(_edges(o))


# --- Arrow operators -----------------------------------------------------------------------------------------------
@on("documents", "tokenize_pad", "SELECT doc_id, array_to_string(list_resize(w[1:16], 16, '<pad>'), ' ') AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)")
def _(d):
    return arrow.tokenize(d, 16).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@on("documents", "tokenize_pad_full", f"SELECT doc_id, array_to_string(list_resize(w[1:{arrow.MAX_LENGTH}], {arrow.MAX_LENGTH}, '<pad>'), ' ') AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)")
def _(d):
    return arrow.tokenize(d, arrow.MAX_LENGTH).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@on("documents", "pack_sequences")
def _(d):
    return arrow.pack(d.select("doc_id", F.size(F.split("text", "\\s+")).alias("n")), 2048)


@on("documents", "code_chunks")
def _(d):
    return arrow.chunk_code(d)


@on("documents", "code_syntax")
def _(d):
    return arrow.syntax(d)


from . import learning_queries, rule_queries  # noqa: E402, F401  they register their queries

ORACLES["rag_context"] = rule_queries.FOLD.format(found=FOUND)
ORACLES["ttl_cache"] = rule_queries.CACHE
DONE_BY_TESTS |= dict.fromkeys(["entity_spans", "entity_summary", "pack_sequences", "code_chunks", "code_syntax", "markdown_sections"], "tests/test_plain.py")
