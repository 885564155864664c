"""Records that are kept and changed: filters, checks, merges, graphs, channels, capped lists (FLT-05, FLT-14, STM-12, GRF-01, AGG-22, AGG-24, TOP-06)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from .retrieval import components


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """FLT-05: rows whose columns have the given values; an array column has to hold the value, a wanted None is no
    condition. A null in a row equals nothing."""
    kinds = dict(df.dtypes)
    one = lambda c, v: F.array_contains(c, v) if kinds[c].startswith("array") else F.col(c) == F.lit(v)
    tests = [one(c, v) for c, v in wanted.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def violations(required: tuple[str, ...] = (), enums: dict[str, list] | None = None, ranges: dict[str, tuple] | None = None, exclusive: tuple[tuple[str, ...], ...] = ()) -> Column:
    """FLT-14: array of what is wrong with a row. A null breaks `required` only; of the columns of a group in
    `exclusive` at most one may have a value."""
    out = [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in required]
    out += [F.when(~F.col(c).isin(values), F.lit(f"{c} is not allowed")) for c, values in (enums or {}).items()]
    out += [F.when((F.col(c) < low) | (F.col(c) > high), F.lit(f"{c} is out of range")) for c, (low, high) in (ranges or {}).items()]
    some = lambda g: reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in g])
    out += [F.when(some(g) > 1, F.lit(f"{' and '.join(g)} exclude each other")) for g in exclusive]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def merged_maps(log: DataFrame, key: str, version: str, column: str) -> DataFrame:
    """STM-12: the map of each key after all updates of it: an entry keeps the value that came last."""
    d = log.select(key, F.col(version).alias("_v"), F.explode(column).alias("_k", "_x"))
    d = d.groupBy(key, "_k").agg(F.max_by("_x", "_v").alias("_x"))
    merged = d.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_x")))).alias(column))
    return log.select(key).distinct().join(merged, key, "left")


def graph_of(entities: DataFrame, relations: DataFrame, max_nodes: int = 10_000, max_edges: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """GRF-01 over logs (id, type, at) and (src, dst, type, at). Edges: those that appear first, up to max_edges, each with the
    type written last. Nodes: those that appear first, alone or as an end of such an edge, up to max_nodes; ends of the edges are
    nodes whatever their number, as adding an edge adds them. Ends that nobody added are unknown. The caps are the feature; what is
    kept is bounded by them. Equal times: by id, or by src and dst; null ids are none."""
    relations = relations.filter("src is not null and dst is not null")
    edges = relations.groupBy("src", "dst").agg(F.min("at").alias("_at"), F.max_by("type", "at").alias("type"))
    edges = edges.orderBy("_at", "src", "dst").limit(max_edges)
    ends = edges.select(F.col("src").alias("id"), "_at").unionByName(edges.select(F.col("dst").alias("id"), "_at")).groupBy("id").agg(F.min("_at").alias("_end"))
    own = entities.filter("id is not null").groupBy("id").agg(F.min("at").alias("_own"), F.max_by("type", "at").alias("type"))
    nodes = own.join(ends, "id", "full_outer").withColumn("_at", F.least("_own", "_end"))
    first = nodes.orderBy("_at", "id").limit(max_nodes)
    nodes = first.unionByName(nodes.filter("_end is not null").join(first.select("id"), "id", "left_anti"))
    return nodes.select("id", F.coalesce("type", F.lit("unknown")).alias("type")), edges.select("src", "dst", "type")


def channel_info(messages: DataFrame, channels: DataFrame, channel: str) -> DataFrame:
    """AGG-24: every channel of the metadata with the number of its messages. Counts come first, so that the join
    holds one row per channel."""
    n = messages.groupBy(channel).agg(F.count("*").alias("message_count"))
    return channels.join(n, channel, "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def first_n(df: DataFrame, n: int, *order) -> DataFrame:
    """TOP-06: the first n rows, and whether the list is full, as a column `truncated` (as it is there: from n on)."""
    rows = df.orderBy(*order).limit(n)
    return rows.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) >= n)


def damped_weights(models: DataFrame, similar: DataFrame, least: float = 0.9, damping: float = 0.3) -> DataFrame:
    """AGG-22 over (name, score, examples, overlap) and (a, b, similarity): weights score * examples / 1000 * overlap;
    pairs of very similar models, by name, pull each other towards their mean, one pair after another; then the weights
    are scaled to sum 1 (equal ones, if the sum is 0). A pair changes only what later pairs of the same connected component see, so each
    component is folded by itself. Pairs with a name that no model has are ignored, as are
    models without a name; of a name that repeats the smallest weight counts; a weight with a null in it is 0."""
    weight = F.coalesce(F.col("score") * F.col("examples") / 1000.0 * F.col("overlap"), F.lit(0.0))
    rows = models.filter("name is not null").groupBy("name").agg(F.min(weight).alias("weight"))
    known = lambda c: rows.select(F.col("name").alias(c))
    near = similar.filter((F.col("similarity") > least) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    near = checkpointed(near.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi"))
    label = checkpointed(components(near.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    near = near.join(label.select(F.col("node").alias("a"), F.col("root").alias("of")), "a")
    tied = rows.join(label.select(F.col("node").alias("name"), "root"), "name", "left")

    def fold(m: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        w = dict(zip(m["name"], m["weight"], strict=True))
        for a, b in sorted(zip(pairs["a"], pairs["b"], strict=True)):
            mean = (w[a] + w[b]) / 2
            w[a], w[b] = (x + damping * (mean - x) for x in (w[a], w[b]))
        return pd.DataFrame({"name": list(w), "weight": list(w.values())})

    kind = rows.schema["name"].dataType.simpleString()
    pulled = tied.filter("root is not null").groupBy("root").cogroup(near.groupBy("of")).applyInPandas(fold, f"name {kind}, weight double")
    every = checkpointed(tied.filter("root is null").select("name", "weight").unionByName(pulled))
    total, n = every.agg(F.sum("weight"), F.count("*")).first()
    return every.withColumn("weight", F.col("weight") / total if total and total > 0 else F.lit(1.0 / n if n else 0.0))
