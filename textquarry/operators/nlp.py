"""Rule-based text analysis: intents, sentiment, emotions, tone, entities, routing, patterns (NLP, STR-26, PIPE-03).

Rules are data; each becomes one column expression, so that no join of rules with texts is needed."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .texts import free_names, settled

#: Keywords and patterns of each intent.
INTENTS: dict[str, tuple[list[str], list[str]]] = {
    "greeting": (["hello", "hi", "hey", "greetings", "good morning", "good afternoon", "good evening"], ["^hi(?: there)?", "^hello", "^hey", "^good (?:morning|afternoon|evening)"]),
    "farewell": (["bye", "goodbye", "see you", "later", "quit", "exit", "good night"], ["^(?:good )?bye", "see you", "(?:good )?night", "^later"]),
    "help": (["help", "assist", "support", "can you", "how do i", "how to", "what can you do"], ["^help", "can you .*(?:help|do)", "how (?:do|can) i", "what can you"]),
    "question": (["what", "how", "why", "when", "where", "who", "which", "?"], ["^(?:what|how|why|when|where|who|which)", "\\?$"]),
    "code_request": (["write", "code", "create", "implement", "function", "class", "script", "program"], ["(?:write|create|implement|generate) .*(?:code|function|class|script)"]),
    "debug_request": (["debug", "fix", "error", "bug", "issue", "problem", "broken", "not working", "crash"], ["(?:debug|fix) .*(?:error|bug|issue)", "(?:there(?:'s| is) an? )?error", "(?:not working|crash|broken)"]),
    "refactor": (["refactor", "improve", "optimize", "clean", "simplify", "restructure"], ["(?:refactor|improve|optimize|clean(?: up)?)"]),
    "explain": (["explain", "describe", "tell me about", "what is", "how does", "what does"], ["(?:explain|describe|tell me about|what is|how does)"]),
    "search": (["search", "find", "look up", "google", "web search"], ["(?:search|find|look up)"]),
    "analysis": (["analyze", "review", "check", "test", "evaluate", "compare"], ["(?:analyze|review|check|test|evaluate|compare)"]),
    "tool_use": (["use tool", "run command", "execute", "shell", "bash"], ["(?:run|execute) .*(?:command|shell)", "bash", "shell"]),
    "learning": (["learn", "teach me", "train", "understand", "study"], ["(?:learn|teach me|train)"]),
    "feedback": (["feedback", "rating", "opinion", "suggest", "improve", "better"], ["(?:feedback|rating|opinion|suggest|improve)"]),
    "clarification": (["clarify", "repeat", "restate", "what do you mean", "explain more"], ["(?:clarify|repeat|what do you mean)", "(?:could you|can you) (?:repeat|clarify)"]),
}
#: Words of the sentiment and emotion rules.
POSITIVE = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "happy", "joy", "best", "perfect", "awesome", "like"]
NEGATIVE = ["bad", "terrible", "awful", "horrible", "worst", "hate", "sad", "angry", "disappointed", "frustrated", "annoying", "poor", "fail"]
EMOTIONS = {
    "joy": ["happy", "joy", "excited", "wonderful", "great", "love", "amazing", "awesome", "fantastic"],
    "sadness": ["sad", "unhappy", "depressed", "down", "disappointed", "unfortunate", "sorry"],
    "anger": ["angry", "mad", "frustrated", "annoyed", "irritated", "furious", "hate"],
    "fear": ["afraid", "scared", "worried", "anxious", "nervous", "terrified", "fear"],
    "surprise": ["surprised", "amazing", "incredible", "unexpected", "shocked", "wow"],
    "anticipation": ["looking forward", "hope", "expect", "excited about", "can't wait"],
}
FRUSTRATED = ["frustrated", "annoyed", "angry", "mad", "sick of", "tired of", "this is useless", "this doesn't work", "why won't", "can't figure out"]
ASKING = ["help", "how do i", "can you", "please", "i need", "need help", "stuck", "confused", "don't understand", "having trouble"]
#: Entity patterns.
ENTITIES = {
    "EMAIL": "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b",
    "URL": "https?://[^\\s]+",
    "PHONE": "\\b\\d{3}[-.]?\\d{3}[-.]?\\d{4}\\b",
    "IP_ADDRESS": "\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b",
    "DATE": "\\b\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}\\b",
    "TIME": "\\b\\d{1,2}:\\d{2}(?:\\s*[AaPp][Mm])?\\b",
    "FILE_PATH": "(?:/[a-zA-Z0-9_.-]+)+",
    "CODE": "`[^`]+`",
    "QUOTED_STRING": "\"[^\"]*\"|'[^']*'",
}
#: Pattern types mined from code (without the back-references, which RE2 lacks).
PATTERNS = {
    "iteration": "for\\s+|while\\s+", "list_comprehension": "\\[.*for.*in.*\\]", "dictionary": "\\{\\w+:|dict\\(|defaultdict\\(",
    "set_operations": "set\\(|\\&\\s*|\\|\\s*|\\-\\s*", "sorting": "sorted\\(|\\.sort\\(", "searching": "\\.index\\(|\\.find\\(|in\\s+",
    "file_io": "open\\(|read\\(|write\\(", "error_handling": "try:|except|finally:", "class_definition": "class\\s+\\w+|def\\s+__init__",
    "function_composition": "\\.map\\(|\\.filter\\(|\\.reduce\\(",
}
#: Fixed value: the pattern type with back-references.
RECURSION = "def\\s+(\\w+)\\s*\\([^)]*\\):\\s*.*\\1\\(|return\\s+(\\w+)\\s*\\([^)]*\\)\\s*\\2\\("
#: Routing rules in order; every group of words must have one that occurs. Tasks are never created or
#: updated, as those words match earlier rules, there as here.
ROUTES: list[tuple[list[list[str]], str]] = [
    ([["read", "show", "display", "view", "cat", "open"], ["pattern", "find"]], "GlobTool"),
    ([["read", "show", "display", "view", "cat", "open"]], "FileReadTool"),
    ([["write", "create", "save", "make file"]], "FileWriteTool"),
    ([["edit", "replace", "update", "modify", "change"]], "FileEditTool"),
    ([["grep", "search"], ["web", "internet"]], "WebSearchTool"),
    ([["grep", "search"]], "GrepTool"),
    ([["git", "commit", "push", "pull", "branch"]], "BashTool"),
    ([["run", "execute", "shell", "bash", "command"]], "BashTool"),
    ([["task"], ["create"]], "TaskCreateTool"),
    ([["task"], ["list"]], "TaskListTool"),
    ([["task"], ["update"]], "TaskUpdateTool"),
    ([["task"]], "TaskGetTool"),
    ([["todo"]], "TodoWriteTool"),
    ([["fetch", "url"]], "WebFetchTool"),
    ([["config"]], "ConfigTool"),
    ([["skill"]], "SkillTool"),
]


def intent_scores(df: DataFrame, text: str, out: str, rules: dict | None = None) -> DataFrame:
    """Add an array<struct<score,intent>> of the intents with a score, in the order of the rules: 1.0 per keyword, 1.5 per
    pattern, in the text without white space around it. The text is prepared once, and the scores once from it."""
    (t,) = free_names(df, "_t")
    before = df.columns
    df = settled(df, *before, **{t: S.strip(F.lower(F.coalesce(F.col(text), F.lit(""))))})
    c = F.col(t)
    each = [F.struct((S.hits(c, words) + 1.5 * sum((c.rlike(p).cast("int") for p in pats), F.lit(0))).alias("score"), F.lit(name).alias("intent")) for name, (words, pats) in (rules or INTENTS).items()]
    df = settled(df, *before, **{out: F.array(*each)})
    return df.withColumn(out, F.filter(out, lambda x: x.score > 0))


def with_rules(extra: dict[str, tuple[list[str], list[str]]]) -> dict:
    """NLP-03, UDF-05: the last rule of a name holds."""
    return INTENTS | extra


def intents(df: DataFrame, text: str = "text", rules: dict | None = None, least: float = 0.3) -> DataFrame:
    """NLP-01: the intent with the largest score, raw_score, and confidence, its share of the largest score (so 1.0);
    up to three others as alternatives, whose share is at least `least`. Without a score, or with `least` over 1, it is
    general, with confidence 1.0. Ties: in the order of the rules."""
    (r,) = free_names(df, "_r")
    df = intent_scores(df, text, r, rules)
    df = settled(df, *[c for c in df.columns if c != r], **{r: F.sort_array(F.transform(r, lambda x, i: F.struct((-x.score).alias("minus"), i.alias("i"), x.intent.alias("intent"))))})
    first = F.get(r, F.lit(0))
    df = df.withColumn(r, F.when((F.size(r) > 0) & (F.lit(1.0) >= least), F.col(r)).otherwise(F.slice(r, 1, 0)))
    shares = F.transform(F.slice(r, 2, 3), lambda x: F.struct(x.intent.alias("intent"), F.round(x.minus / first.minus, 6).alias("confidence")))
    return df.withColumns({
        "intent": F.coalesce(first.intent, F.lit("general")), "raw_score": F.coalesce(-first.minus, F.lit(0.0)), "confidence": F.lit(1.0),
        "alternatives": F.filter(shares, lambda x: x.confidence >= least)}).drop(r)


def intents_multi(df: DataFrame, text: str = "text", least: float = 1.0) -> DataFrame:
    """NLP-02: one row for each intent with a score of at least `least`."""
    (r,) = free_names(df, "_r")
    df = intent_scores(df, text, r)
    df = df.select(*[c for c in df.columns if c != r], F.explode(r).alias(r)).filter(F.col(f"{r}.score") >= least)
    return df.withColumns({"intent": F.col(f"{r}.intent"), "raw_score": F.col(f"{r}.score")}).drop(r)


def sentiment(df: DataFrame, text: str = "text") -> DataFrame:
    """NLP-07, NLP-10, NLP-11: label, score, flags and tone."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_p": S.hits(t, POSITIVE), "_n": S.hits(t, NEGATIVE), "frustrated": S.any_of(t, FRUSTRATED), "asks_help": S.any_of(t, ASKING)})
    net = F.col("_p") - F.col("_n")
    df = df.withColumns({"sentiment": F.when(net > 0, "positive").when(net < 0, "negative").otherwise("neutral"), "score": F.round(F.when(net > 0, F.least(0.5 + net * 0.1, F.lit(0.95))).when(net < 0, F.greatest(0.5 + net * 0.1, F.lit(0.05))).otherwise(0.5), 6)})
    tone = F.when(F.col("sentiment") == "negative", "empathetic").when(F.col("sentiment") == "positive", "enthusiastic").when(F.col("frustrated"), "supportive").when(F.col("asks_help"), "helpful").otherwise("neutral")
    return df.withColumn("tone", tone).drop("_p", "_n")


#: How a reply begins in each tone, and what is added for a negative message.
PREFIXES = {"empathetic": "I understand. ", "enthusiastic": "Great question! ", "supportive": "No problem at all. ", "helpful": "Happy to help! ", "neutral": ""}
REASSURANCE = " I'm here to help you work through this."


def empathy(df: DataFrame, message: str, reply: str) -> DataFrame:
    """NLP-11: tone, dominant_emotion (frustrated, else confused for a call for help, else the first of the emotions),
    needs_empathy, said (the reply with the prefix of its tone, and reassurance for a negative message) and brief (the
    reply; for the frustrated its first paragraph)."""
    answer = F.coalesce(F.col(reply), F.lit(""))
    d = sentiment(df, message)
    (top,) = free_names(d, "_e")
    d = ranked_emotions(d, message, top)
    prefix = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[F.col("tone")]
    full = F.concat(prefix, answer)
    stop = F.when(full.rlike("(?:\\. |[!?])\\z"), F.lit("")).otherwise(F.lit("."))
    sad = F.col("sentiment") == "negative"
    return d.withColumns({
        "dominant_emotion": F.when(F.col("frustrated"), "frustrated").when(F.col("asks_help"), "confused").otherwise(F.coalesce(F.get(top, F.lit(0)).emotion, F.lit("neutral"))),
        "needs_empathy": sad | F.col("frustrated"),
        "said": F.when(sad & (F.col("tone") == "empathetic"), F.concat(full, stop, F.lit(REASSURANCE))).otherwise(full),
        "brief": F.when(F.col("frustrated"), F.get(F.split(answer, "\n\n", 2), F.lit(0))).otherwise(answer),
    }).drop(top)


def ranked_emotions(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add an array<struct<minus,emotion>> of the emotions that a text has, the strongest first; ties by name."""
    (t,) = free_names(df, "_t")
    before = df.columns
    df = settled(df, *before, **{t: F.lower(F.coalesce(F.col(text), F.lit("")))})
    each = F.array(*[F.struct((-F.round(S.hits(F.col(t), w) / len(w), 6)).alias("minus"), F.lit(e).alias("emotion")) for e, w in EMOTIONS.items()])
    df = settled(df, *before, **{out: each})
    return df.withColumn(out, F.sort_array(F.filter(out, lambda x: x.minus < 0)))


def emotions(df: DataFrame, key: str, text: str = "text", top: int = 3) -> DataFrame:
    """NLP-08, NLP-09: up to three emotions by hits / lexicon size; ties by name."""
    d = ranked_emotions(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", "_e")
    d = d.select(F.col("k").alias(key), F.posexplode(F.slice("_e", 1, top)).alias("p", "e"))
    return d.select(key, (F.col("p") + 1).alias("rank"), F.col("e.emotion").alias("emotion"), (-F.col("e.minus")).alias("score"))


def route(df: DataFrame, text: str = "text") -> DataFrame:
    """STR-26: the first rule whose groups of words all occur; BashTool by default."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = F.lit("BashTool")
    for groups, tool in reversed(ROUTES):
        cond = F.lit(True)
        for g in groups:
            cond = cond & S.any_of(t, g)
        out = F.when(cond, F.lit(tool)).otherwise(out)
    return df.withColumn("tool", out)


def entity_texts(df: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = ("EMAIL", "PHONE", "IP_ADDRESS", "URL")) -> DataFrame:
    """NLP-04, NLP-06: texts of the entities of some kinds, counted."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(S.re2(ENTITIES[k])), F.lit(0)).alias("found")) for k in kinds])
    d = df.select(key, F.explode(each).alias("e")).select(key, F.col("e.kind").alias("kind"), F.explode("e.found").alias("entity"))
    return d.groupBy(key, "kind", "entity").agg(F.count("*").alias("n"))


def entity_spans(df: DataFrame, key: str, text: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """NLP-04, NLP-05, JOIN-11: spans of all kinds; of overlapping ones that of the larger score stays, then the longer, then
    in order of start. scores: by kind, 1.0 for others. Offsets of all matches have no built-in form, hence an Arrow
    function per batch."""
    compiled, weight = {k: re.compile(p) for k, p in ENTITIES.items()}, scores or {}

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = sorted(((m.end() - m.start(), m.start(), m.end(), k, m.group()) for k, p in compiled.items() for m in p.finditer(t or "")), key=lambda x: (-weight.get(x[3], 1.0), -x[0], x[1], x[3]))
                taken, kept = bytearray(len(t or "")), []
                for f in found:  # with equal scores a longer span never lies within a shorter one: its ends tell whether it is free
                    if f[0] and not (taken[f[1]] or taken[f[2] - 1] or (weight and any(taken[f[1] : f[2]]))):
                        taken[f[1] : f[2]] = b"\1" * f[0]
                        kept.append(f)
                rows += [(i, k, e, s, z) for _, s, z, k, e in sorted(kept, key=lambda x: x[1])]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [b.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], [key, "kind", "entity", "start", "stop"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, kind string, entity string, start long, stop long")


def structures(df: DataFrame, text: str = "text") -> DataFrame:
    """PIPE-03: (pattern_type, snippet, n): the first function that a text defines and every class, counted over texts."""
    c = F.coalesce(F.col(text), F.lit(""))
    one = F.transform(F.slice(F.regexp_extract_all(c, F.lit("def\\s+(\\w+)\\s*\\([^)]*\\):"), F.lit(1)), 1, 1), lambda x: F.struct(F.lit("function_definition").alias("t"), F.concat(F.lit("def "), x, F.lit("(...)")).alias("s")))
    every = F.transform(F.regexp_extract_all(c, F.lit("class\\s+(\\w+)"), F.lit(1)), lambda x: F.struct(F.lit("class_definition").alias("t"), F.concat(F.lit("class "), x).alias("s")))
    d = df.select(F.explode(F.concat(one, every)).alias("x"))
    return d.groupBy(F.col("x.t").alias("pattern_type"), F.col("x.s").alias("snippet")).agg(F.count("*").alias("n"))


def recursive(c: Column) -> Column:
    """PIPE-03: whether a function calls itself on the line of its definition or in what it returns; RE2 has no
    back-references, so that this type stands beside PATTERNS."""
    some = F.contains(c, F.lit("def")) | F.contains(c, F.lit("return"))  # most texts hold neither, which is told faster
    return F.coalesce(some & c.rlike(RECURSION), F.lit(False))


def mine_patterns(df: DataFrame, text: str = "text") -> DataFrame:
    """PIPE-03, AGG-01/02: texts with each pattern type."""
    each = F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in PATTERNS.items()], F.when(recursive(F.col(text)), F.lit("recursion")))
    found = settled(df.select(text), k=each)  # worked out once, not again in the filters that explode() brings along
    return found.select(F.explode("k").alias("pattern_type")).filter("pattern_type is not null").groupBy("pattern_type").agg(F.count("*").alias("n"))


def ranked(df: DataFrame, key: str, order: list) -> DataFrame:
    """WIN-12."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
