"""Queries over rules, records, schedules and retrieval with their SQL; catalog.py imports them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrow, conversations, corpus, nlp, retrieval, schedule, stores, texts
from .catalog import ASK, DONE_BY_TESTS, KEYWORDS, SENTIMENT, T, TERMS, on, sql_any, sql_count, sql_hits, sql_re

quoted = lambda x: "'" + x.replace("'", "''") + "'"

# --- texts: STR-15, 19, 20, 21, FLT-13 -----------------------------------------------------------------------------
LOC = "len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*#')))"
CYCLOMATIC = "1 + " + " + ".join(sql_count("t", p) for p in ("\\bif\\s+", "\\bfor\\s+", "\\bwhile\\s+", "\\btry\\s+"))
ADVICE = {
    "complex": f"{CYCLOMATIC} > 10", "large": f"{LOC} > 500", "bare_except": "contains(t, 'except:')", "print": "contains(t, 'print(')",
    "none": "contains(t, '==') AND contains(t, 'None')", "enumerate": sql_re("t", "for\\s+\\w+\\s+in\\s+range\\s*\\(\\s*len\\s*\\("),
}


@on("documents", "suggestions", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {ADVICE[k]} THEN {quoted(v)} END" for k, v in texts.SUGGESTIONS.items()) + "], lambda x: x IS NOT NULL), '|') AS suggestions FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _(d):
    return texts.suggestions(d).select("doc_id", F.array_join("suggestions", "|").alias("suggestions"))


@on("documents", "normalised_match", "SELECT doc_id, coalesce(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) = 'src1', false) AS same FROM documents")
def _(d):
    return d.select("doc_id", texts.same_text(F.concat(F.lit(" \n"), F.upper("source"), F.lit("\t")), F.lit("Src1 ")).alias("same"))


@on("documents", "answer_check", "SELECT doc_id, coalesce(n_chars % 3 < 2, false) AS correct FROM documents")
def _(d):
    answer = F.concat(F.lit("So the answer is "), F.col("n_chars").cast("string"), F.lit(" exactly"))
    wanted = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit(" "), F.col("n_chars").cast("string"))).when(F.col("n_chars") % 3 == 1, F.concat(F.col("n_chars").cast("string"), F.lit(".0"))).otherwise("none")
    return d.select("doc_id", texts.same_answer(answer, wanted).alias("correct"))


@on("documents", "line_edits", """SELECT doc_id, md5(CASE WHEN n < 3 THEN t ELSE array_to_string(l[:1] || l[4:], chr(10)) END) AS deleted, md5(CASE WHEN n < 2 THEN t ELSE array_to_string(l[:2] || ['# new'] || l[3:], chr(10)) END) AS inserted
 FROM (SELECT doc_id, t, string_split(t, chr(10)) AS l, len(string_split(t, chr(10))) AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def _(d):
    c = F.coalesce(F.col("text"), F.lit(""))
    return d.select("doc_id", F.md5(texts.delete_range(c, 2, 3)).alias("deleted"), F.md5(texts.insert_line(c, 3, "# new")).alias("inserted"))


@on("documents", "code_presence", f"SELECT doc_id, coalesce({sql_any('text', ['```', 'import ', ' | '])}, false) AS has_code FROM documents")
def _(d):
    return d.select("doc_id", texts.has_code(F.col("text"), ("```", "import ", " | ")).alias("has_code"))


#: Advice for errors, as an operator's user would give it.
ERRORS = {"TypeError": "check the types", "KeyError": "check the keys", "ImportError": "install it"}
NAMED = "coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'TypeError: bad' WHEN 1 THEN ' KeyError: ' || lang WHEN 2 THEN ' OSError: x KeyError: y' ELSE ' Error: none' END"


def _named(d):
    i = F.col("doc_id") % 5
    return F.concat(F.coalesce("text", F.lit("")), F.when(i == 0, F.lit("\nTypeError: bad")).when(i == 1, F.concat(F.lit(" KeyError: "), "lang")).when(i == 2, F.lit(" OSError: x KeyError: y")).otherwise(F.lit(" Error: none")))


@on("documents", "error_advice", f"SELECT doc_id, coalesce(CASE regexp_extract(t, '([A-Za-z0-9_]+Error):', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ERRORS.items()) + f" END, 'unknown') AS advice FROM (SELECT doc_id, {NAMED} AS t FROM documents)")
def _(d):
    return d.select("doc_id", texts.error_type(_named(d), ERRORS).alias("advice"))


FRAMES = f"replace(replace({NAMED}, '. ', chr(10) || '  File \"'), ', ', chr(10) || 'Exception in ')"


@on("documents", "traceback_frames", f"""SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*File \"')))::INT AS n_frames, md5(coalesce(list_filter(l, lambda x: regexp_matches(x, 'Error|Exception'))[-1], '')) AS error_line
 FROM (SELECT doc_id, string_split({FRAMES}, chr(10)) AS l FROM documents)""")
def _(d):
    t = F.replace(F.replace(_named(d), F.lit(". "), F.lit('\n  File "')), F.lit(", "), F.lit("\nException in "))
    return texts.traceback_parts(d.select("doc_id", t.alias("text"))).select("doc_id", "n_frames", F.md5(F.coalesce("error_line", F.lit(""))).alias("error_line"))


@on("documents", "substituted", "SELECT doc_id, '[' || lang || '] ' || source || ' ' || n_chars || ' {other}' AS said FROM documents")
def _(d):
    return d.select("doc_id", texts.substitute(F.lit("[{lang}] {source} {n} {other}"), {"lang": F.col("lang"), "source": F.col("source"), "n": F.col("n_chars").cast("string")}).alias("said"))


@on("conversations", "tool_call_results", """SELECT a.conv_id, a.turn, length(b.text) AS n_result FROM (SELECT * FROM conversations WHERE role = 'user') a
 LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(c):
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("tool_call_id")
    calls = c.filter("role = 'user'").select("conv_id", "turn", key(F.col("turn") + 1))
    results = c.filter("role = 'assistant'").select(key(F.col("turn")), F.length("text").cast("long").alias("n_result"))
    return conversations.tool_call_results(calls, results).drop("tool_call_id")


@on("documents pages benchmark", "union_sources", """SELECT dataset, count(*) AS n, count(lang) AS n_lang, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM (SELECT 'documents' AS dataset, lang, text FROM documents
 UNION ALL SELECT 'pages', NULL, html FROM pages UNION ALL SELECT 'benchmark', NULL, text FROM benchmark) GROUP BY 1""")
def _(d, p, b):
    every = corpus.union_all(documents=d.select("doc_id", "lang", "text"), pages=p.select("page_id", F.col("html").alias("text")), benchmark=b.select("text", "item_id"))
    return every.groupBy("dataset").agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


@on("conversations", "turn_checks", """SELECT conv_id, bool_or(contains(t, '?')) AS any_question, bool_and(regexp_matches(t, '\\S')) AS all_say, (count(*) FILTER (WHERE length(t) > 200))::INT AS n_long,
 coalesce(sum(length(t)) FILTER (WHERE role = 'user'), 0)::BIGINT AS user_chars, coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS assistant_chars, string_agg(role[1], '' ORDER BY turn, role, t) AS roles
 FROM (SELECT *, coalesce(text, '') AS t FROM conversations) GROUP BY 1""")
def _(c):
    return conversations.turn_checks(c)


# --- rules: NLP-11, PIPE-03, FLT-15 --------------------------------------------------------------------------------
TONE = SENTIMENT.format(key="conv_id, turn, t, coalesce(text, '') AS reply", table="conversations")
BY_EMOTION = "list_sort(list_filter([" + ", ".join(f"{{'minus': -round({sql_hits('t', w)} / {len(w)}.0::DOUBLE, 6), 'emotion': '{e}'}}" for e, w in nlp.EMOTIONS.items()) + "], lambda x: x.minus < 0))"
PREFIX = "CASE tone " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in nlp.PREFIXES.items()) + " END"
FRUSTRATED, ASKING = sql_any("t", nlp.FRUSTRATED), sql_any("t", nlp.ASKING)


@on("conversations", "empathy", f"""SELECT conv_id, turn, tone, CASE WHEN {FRUSTRATED} THEN 'frustrated' WHEN {ASKING} THEN 'confused' ELSE coalesce({BY_EMOTION}[1].emotion, 'neutral') END AS dominant_emotion,
 sentiment = 'negative' OR {FRUSTRATED} AS needs_empathy, md5(CASE WHEN sentiment = 'negative' AND tone = 'empathetic' THEN p || reply || CASE WHEN regexp_matches(p || reply, '(\\. |[!?])$') THEN '' ELSE '.' END || {quoted(nlp.REASSURANCE)} ELSE p || reply END) AS said,
 md5(CASE WHEN {FRUSTRATED} THEN string_split(reply, chr(10) || chr(10))[1] ELSE reply END) AS brief FROM (SELECT *, {PREFIX} AS p FROM ({TONE}))""")
def _(c):
    d = nlp.empathy(c, "text", "text")
    return d.select("conv_id", "turn", "tone", "dominant_emotion", "needs_empathy", F.md5("said").alias("said"), F.md5("brief").alias("brief"))


@on("documents", "pattern_structures", """SELECT pattern_type, snippet, count(*) AS n FROM (
 SELECT 'function_definition' AS pattern_type, 'def ' || f || '(...)' AS snippet FROM (SELECT regexp_extract_all(coalesce(code, ''), 'def\\s+(\\w+)\\s*\\([^)]*\\):', 1)[1] AS f FROM (SELECT 'class ' || source || ':' || chr(10) || ' def ' || lang || '(self): ' || coalesce(text, '') AS code FROM documents)) WHERE f IS NOT NULL
 UNION ALL SELECT 'class_definition', 'class ' || unnest(regexp_extract_all(code, 'class\\s+(\\w+)', 1)) FROM (SELECT 'class ' || source || ':' || chr(10) || ' def ' || lang || '(self): ' || coalesce(text, '') AS code FROM documents)) GROUP BY 1, 2""")
def _(d):
    code = F.concat(F.lit("class "), "source", F.lit(":\n def "), "lang", F.lit("(self): "), F.coalesce("text", F.lit("")))
    return nlp.structures(d.select(code.alias("text")))


@on("events", "valid_tool_calls", "SELECT event_id, event_type IN ('click', 'purchase') AS valid FROM events")
def _(e):
    calls = F.when(F.col("event_type") == "click", F.concat(F.lit('[{"function": {"name": "'), "event_type", F.lit('"}}]'))).when(F.col("event_type") == "view", F.lit('[{"function": {}}]'))
    calls = calls.when(F.col("event_type") == "error", F.lit("[{")).when(F.col("event_type") == "purchase", F.lit("[]"))
    return e.select("event_id", conversations.valid_tool_calls(calls).alias("valid"))


# --- records: FLT-05, FLT-14, STM-12, GRF-01, AGG-24, TOP-06 -------------------------------------------------------
@on("events", "field_filters", "SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id = 7")
def _(e):
    return stores.where_equal(e.withColumn("tags", F.array("event_type")), tags="purchase", user_id=7, value=None).select("event_id")


@on("events", "row_checks", """SELECT event_id, array_to_string(list_filter([CASE WHEN value IS NULL THEN 'value is required' END, CASE WHEN event_type NOT IN ('view', 'click') THEN 'event_type is not allowed' END,
 CASE WHEN value < 5 OR value > 50 THEN 'value is out of range' END, CASE WHEN (props IS NOT NULL)::INT + (ts IS NOT NULL)::INT > 1 THEN 'props and ts exclude each other' END], lambda x: x IS NOT NULL), '|') AS problems FROM events""")
def _(e):
    wrong = stores.violations(("value",), {"event_type": ["view", "click"]}, {"value": (5, 50)}, (("props", "ts"),))
    return e.select("event_id", F.array_join(wrong, "|").alias("problems"))


@on("events", "merged_maps", "SELECT user_id, string_agg(event_type || '=' || k, '|' ORDER BY event_type) AS entries FROM (SELECT user_id, event_type, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS k FROM events GROUP BY 1, 2) GROUP BY 1")
def _(e):
    d = e.withColumns({"at": F.struct("ts", "event_id"), "entries": F.create_map("event_type", F.get_json_object("props", "$.k"))})
    d = stores.merged_maps(d, "user_id", "at", "entries")
    pairs = F.transform(F.array_sort(F.map_entries("entries")), lambda x: F.concat(x.key, F.lit("="), x.value))
    return d.select("user_id", F.array_join(pairs, "|").alias("entries"))


LOG = "(SELECT user_id AS src, user_id % 13 + 1000 AS dst, event_type AS type, event_id AS pos FROM events)"


def _log(e):
    entities = e.filter("event_type <> 'view'").select(F.col("user_id").alias("id"), F.col("event_type").alias("type"), F.col("event_id").alias("at"))
    relations = e.select(F.col("user_id").alias("src"), (F.col("user_id") % 13 + 1000).alias("dst"), F.col("event_type").alias("type"), F.col("event_id").alias("at"))
    return stores.graph_of(entities, relations, 30, 40)


@on("events", "graph_nodes", f"""WITH g AS (SELECT src, dst, min(pos) AS pos FROM {LOG} GROUP BY 1, 2 ORDER BY pos, 1, 2 LIMIT 40),
 o AS (SELECT src AS id, min(pos) AS pos, arg_max(type, pos) AS type FROM {LOG} WHERE type <> 'view' GROUP BY 1),
 e AS (SELECT id, min(pos) AS pos FROM (SELECT src AS id, pos FROM g UNION ALL SELECT dst, pos FROM g) GROUP BY 1),
 n AS (SELECT id, type, e.pos IS NOT NULL AS is_end, row_number() OVER (ORDER BY least(o.pos, e.pos), id) AS place FROM o FULL JOIN e USING (id))
 SELECT id, coalesce(type, 'unknown') AS type FROM n WHERE place <= 30 OR is_end""")
def _(e):
    return _log(e)[0]


@on("events", "graph_edges", f"SELECT src, dst, type FROM (SELECT src, dst, arg_max(type, pos) AS type, min(pos) AS first FROM {LOG} GROUP BY 1, 2 ORDER BY first, 1, 2 LIMIT 40)")
def _(e):
    return _log(e)[1]


@on("events nation", "channel_info", "SELECT n_nationkey AS user_id, n_name, count(event_id) AS message_count FROM nation LEFT JOIN events ON user_id = n_nationkey GROUP BY 1, 2")
def _(e, n):
    return stores.channel_info(e, n.select(F.col("n_nationkey").cast("bigint").alias("user_id"), "n_name"), "user_id")


@on("documents", "grep_capped", "SELECT *, count(*) OVER () >= 100 AS truncated FROM (SELECT doc_id, i::INT AS line_no, md5(line) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE contains(line, 'the') ORDER BY 1, 2 LIMIT 100)")
def _(d):
    found = stores.first_n(texts.grep(d, "the"), 100, "doc_id", "line_no")
    return found.withColumn("line", F.md5("line"))


# --- schedules: STM-09 ---------------------------------------------------------------------------------------------
@on("events", "cron_next", "SELECT event_id, arg_min(m, m) AS next_fire FROM events, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31 23:59:00', INTERVAL 15 MINUTE)) AS m) WHERE hour(m) = 9 AND dayofweek(m) = 1 AND m > date_trunc('minute', ts) GROUP BY 1")
def _(e):
    return e.select("event_id", schedule.next_fire(F.col("ts"), "*/15 9 * * 1").alias("next_fire"))


RULE = "CASE event_id % 8 WHEN 0 THEN '* * * * *' WHEN 1 THEN '*/' || (event_id % 30 + 1) || ' * * * *' WHEN 2 THEN '0 */' || (event_id % 11 + 1) || ' * * *' WHEN 3 THEN '0 * * * *' WHEN 4 THEN minute(ts) || ' ' || hour(ts) || ' * * *' WHEN 5 THEN minute(ts) || ' ' || hour(ts) || ' ' || day(ts) || ' ' || month(ts) || ' *' WHEN 6 THEN minute(ts) || ' ' || hour(ts) || ' * * ' || event_id % 7 ELSE '1-5 ' || hour(ts) || ' * 3 2,4' END"


@on("events", "cron_described", f"""SELECT event_id, CASE k WHEN 0 THEN 'every minute' WHEN 1 THEN 'every ' || (event_id % 30 + 1) || ' minutes' WHEN 2 THEN 'every ' || (event_id % 11 + 1) || ' hours' WHEN 3 THEN 'every hour'
 WHEN 4 THEN 'daily at ' || CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || ':' || lpad(m::VARCHAR, 2, '0') || CASE WHEN h < 12 THEN ' am' ELSE ' pm' END
 WHEN 5 THEN 'on day ' || day(ts) || ' of month ' || month(ts) || ' at ' || h || ':' || m WHEN 6 THEN 'weekly on ' || ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][event_id % 7 + 1] || ' at ' || h || ':' || m
 ELSE 'at ' || h || ':1-5' END AS said FROM (SELECT *, event_id % 8 AS k, minute(ts) AS m, hour(ts) AS h FROM events)""")
def _(e):
    return e.select("event_id", schedule.described(F.expr(RULE)).alias("said"))


# --- retrieval and packs: TOP-07, PIPE-12, PRJ-11, STM-07 ----------------------------------------------------------
FOLD = f"""WITH RECURSIVE f AS (SELECT doc_id, score, length(text) AS n, row_number() OVER (ORDER BY score DESC, doc_id) AS i FROM ({{found}}) JOIN documents USING (doc_id)),
 s(i, used, took) AS (SELECT 0::BIGINT, 0::BIGINT, NULL::BIGINT UNION ALL SELECT f.i, s.used + CASE WHEN s.used + f.n <= 5000 THEN f.n ELSE 0 END, CASE WHEN s.used + f.n <= 5000 THEN f.doc_id END FROM s JOIN f ON f.i = s.i + 1)
 SELECT took AS doc_id FROM s WHERE took IS NOT NULL"""
#: The k best items of the benchmark for each user turn.
PAIRS = f"""WITH bt AS (SELECT item_id, unnest({KEYWORDS}) AS term FROM benchmark), b AS (SELECT item_id, term, count(*) AS tf FROM bt GROUP BY 1, 2), bv AS (SELECT item_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY item_id)) AS v FROM b),
 ct AS (SELECT conv_id * 100000 + turn AS q, unnest({KEYWORDS}) AS term FROM conversations WHERE role = 'user'), c AS (SELECT q, term, count(*) AS tf FROM ct GROUP BY 1, 2), cv AS (SELECT q, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY q)) AS w FROM c)
 SELECT q, item_id AS doc_id, round(sum(w * v), 6) AS score FROM cv JOIN bv USING (term) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(sum(w * v), 6) DESC, item_id) <= 2"""


def _turns(c):
    return c.filter("role = 'user'").withColumn("q", F.col("conv_id") * 100_000 + F.col("turn"))


@on("conversations benchmark", "rag_many", PAIRS)
def _(c, b):
    return retrieval.retrieve_many(_turns(c).select("q", "text"), b.withColumnRenamed("item_id", "doc_id"), "q", 2)


MAILS = f"len(regexp_extract_all(coalesce(text, ''), {quoted(nlp.ENTITIES['TIME'])})) + len(regexp_extract_all(coalesce(text, ''), {quoted(nlp.ENTITIES['EMAIL'])}))"
BEST_INTENT = "list_sort([" + ", ".join(f"{{'minus': -({sql_hits('s', w)} + 1.5::DOUBLE * (" + " + ".join(f"{sql_re('s', p)}::INT" for p in ps) + f")), 'i': {i}, 'intent': '{k}'}}" for i, (k, (w, ps)) in enumerate(nlp.INTENTS.items())) + "])[1]"


@on("conversations benchmark", "chat_process", f"""WITH r AS (SELECT q, string_agg(doc_id::VARCHAR, ',' ORDER BY score DESC, doc_id) AS context FROM ({PAIRS}) GROUP BY 1),
 m AS (SELECT conv_id * 100000 + turn AS q, conv_id, turn, {BEST_INTENT} AS best, {MAILS} AS n_entities FROM (SELECT *, regexp_replace({T}, '^\\s+|\\s+$', '', 'g') AS s FROM conversations WHERE role = 'user')),
 t AS ({SENTIMENT.format(key='conv_id, turn', table='conversations')})
 SELECT conv_id, turn, CASE WHEN best.minus < 0 THEN best.intent ELSE 'general' END AS intent, n_entities::BIGINT AS n_entities, sentiment, tone, coalesce(context, '') AS context FROM m JOIN t USING (conv_id, turn) LEFT JOIN r USING (q)""")
def _(c, b):
    found = retrieval.retrieve_many(_turns(c).select("q", "text"), b.withColumnRenamed("item_id", "doc_id"), "q", 2)
    return conversations.process(_turns(c), found, "q", ("TIME", "EMAIL")).select("conv_id", "turn", "intent", "n_entities", "sentiment", "tone", F.array_join("context", ",").alias("context"))


WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"


@on("documents", "mask_labels", f"SELECT doc_id, (CASE WHEN list_contains(w, 'the') THEN len(list_filter(w[len(w) - list_position(list_reverse(w), 'the') + 2:], lambda x: x <> 'tool')) ELSE len(list_filter(w[floor(len(w) * 0.7::DOUBLE)::BIGINT + 1:], lambda x: x <> 'tool')) END)::INT AS n_kept FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def _(d):
    return arrow.mask_labels(arrow.words(d), marker="the").select("doc_id", F.size(F.filter("labels", lambda x: x.isNotNull())).alias("n_kept"))


#: An entry lives for an hour from its fill, and a hit does not renew it: requests are followed one by one.
CACHE = """WITH RECURSIVE r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
 s(user_id, ts, i, filled, hit) AS (SELECT user_id, ts, i, ts, false FROM r WHERE i = 1
 UNION ALL SELECT r.user_id, r.ts, r.i, CASE WHEN r.ts - s.filled < INTERVAL 1 HOUR THEN s.filled ELSE r.ts END, r.ts - s.filled < INTERVAL 1 HOUR FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
 SELECT user_id, ts, hit FROM s"""


@on("documents", "code_search")
def _(d):
    return arrow.search_code(arrow.chunk_code(d), ASK).drop("content")


DONE_BY_TESTS["code_search"] = "tests/test_plain.py"
