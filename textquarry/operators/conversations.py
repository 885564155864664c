"""Conversation operators over (conv_id, turn, role, text): shaping (PRJ), completeness (FLT-01), quality (WIN-04..08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from . import nlp
from .corpus import structure_score

#: Words that mark a correction, and a satisfied user.
CORRECTIONS = ["correction:", "actually", "sorry", "correction", "correction to", "i meant", "meant to say", "correction -", "correction--"]
SATISFIED = ["thanks", "thank you", "great", "good", "excellent", "perfect", "awesome", "wonderful", "love", "amazing"]


def joined(value: Column, sep: str) -> Column:
    """Values of a conversation in the order of turn. One conversation's turns are gathered in one row."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))), lambda x: x.v), sep)


def extract_content(c: DataFrame) -> DataFrame:
    """PRJ-01."""
    return c.groupBy("conv_id").agg(joined(F.coalesce("text", F.lit("")), " ").alias("content"))


def extract_response(c: DataFrame) -> DataFrame:
    """PRJ-02, WIN-02: the first assistant message, else ''."""
    return c.groupBy("conv_id").agg(F.coalesce(F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))), F.lit("")).alias("response"))


def format_sample(c: DataFrame) -> DataFrame:
    """PRJ-03, the messages layout."""
    head = F.when(F.col("role").isin("user", "assistant", "system"), F.concat(F.lit("### "), F.initcap("role"), F.lit(":\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))).otherwise("")
    return c.groupBy("conv_id").agg(S.strip(joined(head, "")).alias("formatted"))


def format_instruction(c: DataFrame) -> DataFrame:
    """PRJ-04: the last message of each role; rows without user or assistant are dropped instead of raising."""
    last = lambda r: F.max_by("text", F.when(F.col("role") == r, F.col("turn")))
    d = c.groupBy("conv_id").agg(last("system").alias("s"), last("user").alias("u"), last("assistant").alias("a")).filter("u IS NOT NULL AND a IS NOT NULL")
    system = F.when(F.length("s") > 0, F.concat(F.lit("### System:\n"), F.col("s"), F.lit("\n\n"))).otherwise("")
    return d.select("conv_id", F.concat(system, F.lit("### User:\n"), "u", F.lit("\n\n### Assistant:\n"), "a").alias("formatted"))


def chatml(c: DataFrame) -> DataFrame:
    """PRJ-06 without tool calls, with the trailing assistant header."""
    return c.groupBy("conv_id").agg(F.concat(joined(F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")), ""), F.lit("<|im_start|>assistant\n")).alias("formatted"))


def chatml_with_tools(messages: DataFrame) -> DataFrame:
    """PRJ-06 over an array column messages<role, content, tool_calls<name, arguments>>."""
    calls = lambda m: F.array_join(F.transform(m.tool_calls, lambda t: F.concat(F.lit('<tool_call>\n{"name": "'), t["name"], F.lit('", "arguments": '), t["arguments"], F.lit("}\n</tool_call>"))), "\n")
    body = lambda m: F.when(F.coalesce(F.size(m.tool_calls), F.lit(0)) > 0, F.concat(calls(m), F.when(F.length(m.content) > 0, F.concat(F.lit("\n"), m.content)).otherwise(""))).otherwise(F.coalesce(m.content, F.lit("")))
    one = lambda m: F.concat(F.lit("<|im_start|>"), m.role, F.lit("\n"), body(m), F.lit("<|im_end|>\n"))
    return messages.withColumn("formatted", F.concat(F.array_join(F.transform("messages", one), ""), F.lit("<|im_start|>assistant\n")))


def turn_template(c: DataFrame) -> DataFrame:
    """PRJ-08."""
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    return c.groupBy("conv_id").agg(joined(F.concat(F.lit("<start_of_turn>"), role, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<end_of_turn>\n")), "").alias("formatted"))


def completeness(c: DataFrame) -> DataFrame:
    """FLT-01, STR-03."""
    has = lambda r: F.bool_or(F.col("role") == r)
    d = c.groupBy("conv_id").agg(has("user").alias("u"), has("assistant").alias("a"), has("system").alias("s"), F.bool_or(S.non_blank(F.col("text"))).alias("t"))
    return d.select("conv_id", (F.col("u") & F.col("a") & F.col("t")).alias("complete"), F.round(structure_score(F.col("u"), F.col("a"), F.col("s"), F.lit(0)), 6).alias("structure_score"))


def _w() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: F.length(w) > 3))


def conversation_quality(c: DataFrame) -> DataFrame:
    """PIPE-13 = WIN-04..08, JOIN-06, AGG-19: retention, coherence, recovery and satisfaction of each conversation."""
    text = F.lower(F.coalesce("text", F.lit("")))
    d = c.withColumn("t", text)
    before = F.collect_list("t").over(_w().rowsBetween(-3, -1))
    refers = F.exists(before, lambda p: S.non_blank(p) & F.contains(F.col("t"), F.element_at(F.split(S.strip(p), "\\s+"), 1)))
    d = d.select("conv_id", "turn", "role", "t", (F.row_number().over(_w()) - 1).alias("i"), refers.alias("refers"), F.lag("t").over(_w()).alias("prev"))
    shares = F.size(F.array_intersect(_words(F.col("t")), _words(F.coalesce("prev", F.lit(""))))) > 0
    g = d.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.count_if((F.col("i") >= 2) & F.col("refers")).alias("kept"),
        F.count_if((F.col("i") >= 1) & shares).alias("near"),
        F.count_if((F.col("i") >= 1) & S.any_of(F.col("t"), CORRECTIONS)).alias("fixed"),
        F.count_if((F.col("role") == "user") & S.any_of(F.col("t"), SATISFIED)).alias("glad"))
    n = F.col("n_messages")
    return g.select(
        "conv_id", "n_messages",
        F.round(F.when(n < 3, 1.0).otherwise(S.ratio(F.col("kept"), n - 2)), 6).alias("context_retention"),
        F.round(F.when(n < 2, 1.0).otherwise(S.ratio(F.col("near"), n - 1)), 6).alias("coherence"),
        F.round(F.when(n < 3, 1.0).otherwise(S.ratio(F.col("fixed"), n - 1)), 6).alias("error_recovery"),
        F.round(S.ratio(F.col("glad"), n) * 0.5 + F.least(n, F.lit(20)) / 20 * 0.5, 6).alias("satisfaction"))


def turn_checks(turns: DataFrame, key: str = "conv_id", long: int = 200) -> DataFrame:
    """ARR-01: over the turns of a conversation as an array: whether any asks, whether all say something, how many are long, and how many
    characters the roles have in all. A null text is empty."""
    t = turns.select(key, F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t")).groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    chars = lambda role: F.aggregate(F.filter("ts", lambda x: x.role == role), F.lit(0).cast("long"), lambda n, x: n + F.length(x.text))
    return t.select(
        key, F.exists("ts", lambda x: F.contains(x.text, F.lit("?"))).alias("any_question"), F.forall("ts", lambda x: S.non_blank(x.text)).alias("all_say"),
        F.size(F.filter("ts", lambda x: F.length(x.text) > long)).alias("n_long"), chars("user").alias("user_chars"), chars("assistant").alias("assistant_chars"),
        F.array_join(F.transform("ts", lambda x: F.substring(x.role, 1, 1)), "").alias("roles"))


def tool_call_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """JOIN-13: calls with their results; calls without one have a null result."""
    return calls.join(results, "tool_call_id", "left")


def valid_tool_calls(calls: Column) -> Column:
    """FLT-15 over a JSON text: whether it is a list of objects that each have a function with a name (null counts as
    one). An empty list passes; anything else, null and broken JSON included, does not. A function that is no object fails."""
    each = F.try_variant_get(F.try_parse_json(calls), "$", "array<variant>")
    return F.coalesce(F.forall(each, lambda c: F.coalesce(F.try_variant_get(c, "$.function.name", "variant").isNotNull(), F.lit(False))), F.lit(False))


def process(turns: DataFrame, found: DataFrame, key: str, kinds: tuple[str, ...] = tuple(nlp.ENTITIES)) -> DataFrame:
    """PIPE-12: turns with intent and confidence, the number of entities of some kinds (before overlaps are settled),
    sentiment, tone and context: the ids of the texts found for them (key, doc_id, score), the best first. Entities as
    nodes of a graph: nlp.entity_spans() and stores.graph_of()."""
    d = nlp.sentiment(nlp.intents(turns))
    n = sum((F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(S.re2(nlp.ENTITIES[k])), F.lit(0))) for k in kinds), F.lit(0))
    best = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("_x"))  # as many as are found for a turn
    d = d.withColumn("n_entities", n.cast("long")).join(best, key, "left")
    return d.withColumn("context", F.coalesce(F.transform("_x", lambda x: x.doc_id.cast("string")), F.array().cast("array<string>"))).drop("_x")
