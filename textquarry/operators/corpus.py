"""Training-corpus operators: scores, completeness, exact dedup, pipelines (STR, FLT, AGG-14..17, PIPE-01/02, SET-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def with_scores(df: DataFrame, response: str = "text", structure: Column | None = None) -> DataFrame:
    """STR-01..04, FLT-02: every row with its scores. Without messages the structure score is the base 0.5."""
    r = F.coalesce(F.col(response), F.lit(""))
    df = df.withColumns({"length_score": S.length_score(r), "code_score": S.code_score(r), "structure_score": structure if structure is not None else F.lit(0.5)})
    return df.withColumn("overall", S.overall_score(F.col("length_score"), F.col("code_score"), F.col("structure_score")))


def first_of_content(df: DataFrame, content: str = "text", order: str = "doc_id") -> DataFrame:
    """AGG-16: of equal contents the row that comes first stays. The smallest order per digest is aggregated
    before the shuffle, so a hot content costs one row per task."""
    d = df.withColumn("_digest", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    first = d.groupBy("_digest").agg(F.min(order).alias("_first"))
    return d.join(first, (d["_digest"] == first["_digest"]) & (d[order] == first["_first"]), "left_semi").drop("_digest")


def length_filter(df: DataFrame, response: str = "text", least: int = 10, most: int = 128_000) -> DataFrame:
    """FLT-03 on the record (Q2)."""
    return df.filter(S.non_blank(F.col(response)) & (F.length(response) >= least) & (F.length(response) <= most))


def quality_pipeline(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """PIPE-01: non-blank, exact dedup, score, threshold; statistics by language (AGG-14; Q1: true input counts)."""
    total = docs.groupBy("lang").agg(F.count("*").alias("total_input"))
    unique = first_of_content(docs.filter(S.non_blank(F.col("text"))))
    scored = with_scores(unique).groupBy("lang").agg(
        F.count("*").alias("unique_count"), F.count_if(F.col("overall") >= least).alias("final_count"), F.round(F.avg("overall"), 6).alias("avg_score"))
    return total.join(scored, "lang", "left").select("lang", "total_input", (F.col("total_input") - F.coalesce("unique_count", F.lit(0))).alias("removed"), F.coalesce("final_count", F.lit(0)).alias("final_count"), "avg_score")


def hash_split(df: DataFrame, key: str, share: float = 0.9, seed: str = "split") -> DataFrame:
    """SET-05: a stable split; a row's side depends on its key alone."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < share, "train").otherwise("eval"))


def sample_by_hash(df: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    """SET-06: n rows in the order of a seeded hash."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def duplication(df: DataFrame, prompt: str = "text") -> DataFrame:
    """AGG-17: total, distinct, average duplication, largest group."""
    per = df.groupBy(F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256).alias("h")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_prompts"), F.round(S.ratio(F.sum("n"), F.count("*")), 6).alias("avg_duplication"), F.max("n").alias("most"))


def prep_pipeline(docs: DataFrame) -> DataFrame:
    """PIPE-02: dedup, length filter on the record, split, format, whitespace tokens."""
    d = hash_split(length_filter(first_of_content(docs)), "doc_id")
    return d.select("doc_id", "split", F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")).cast("long").alias("n_tokens"))


def structure_score(has_user: Column, has_assistant: Column, has_system: Column, tool_messages: Column) -> Column:
    """STR-03."""
    return F.least(F.lit(1.0), 0.5 + F.when(has_user & has_assistant, 0.3).otherwise(0.0) + F.when(has_system, 0.1).otherwise(0.0) + tool_messages * 0.1)


def code_pairs(df: DataFrame) -> DataFrame:
    """FLT-04."""
    return df.filter(S.non_blank(F.col("code")) & S.non_blank(F.col("fullBody")) & ~F.contains("fullBody", F.lit("{ ... }")))


def tool_defaults(df: DataFrame) -> DataFrame:
    """PRJ-09."""
    return df.withColumns({"description": F.coalesce(F.nullif(F.col("description"), F.lit("")), F.concat(F.lit("Tool for "), F.coalesce("tool", F.lit("unknown operation")))), "inputSchema": F.coalesce("inputSchema", F.lit('{"type": "object", "properties": {}}'))})


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """WIN-01."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def union_all(**parts: DataFrame) -> DataFrame:
    """SET-01: all rows of the datasets, with the name of theirs as column `dataset`; columns are matched by name, and null where a dataset
    lacks them."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
