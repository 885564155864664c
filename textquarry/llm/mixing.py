"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source of `size` characters that is to make up the share w of a mixture as large as the input gets the mean
repetition rate  size_of_all * w / size.  Every document gets a uniform number in (0, 1) from the md5 of seed and
doc_id (of its text, if doc_id is null) and is repeated as often as the inverted Poisson distribution says. A rate
over STEP is the sum of equal independent parts, so that the distribution's table stays short. Copies are dealt
to partitions, and sorted there, by an md5 of their own: a global shuffle that is the same in every run.

Without given weights, a source's share is proportional to size ** ALPHA. Given weights name sources; a source
that is not named gets none. A null source is a source of its own. A source without a character has rate 0.
Null text is kept as null and has size 0. Repeated rows get the same number. An empty table gives no row. Texts are never cut:
a very long one only weighs more in its source. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_small

ALPHA, STEP, TERMS, SEED = 0.7, 20.0, 100, "mix-1"


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """source, size, share and rate of every source."""
    size = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("size"))
    size = cut(size.coalesce(1))
    if weights is None:
        part = F.pow(F.col("size").cast("double"), F.lit(ALPHA))
    else:
        part = F.lit(0.0)
        for name, w in weights.items():
            part = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(part)
    part = F.when(F.col("size") > 0, part).otherwise(0.0)
    whole, parts = size.agg(F.sum("size"), F.sum(part)).first()
    share = part / F.lit(float(parts or 1))
    rate = F.when(F.col("size") > 0, F.lit(float(whole or 0)) * share / F.col("size")).otherwise(0.0)
    return size.select("source", "size", share.alias("share"), rate.alias("rate"))


def uniform(*seed: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of what is given."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *seed)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED) -> DataFrame:
    """The mixture: all columns of docs, replica (from 1) and shuffle_key."""
    rate = rates(docs, weights)
    mean = F.col("rate") / F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1))
    grow = lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k)).alias("cdf"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    table = rate.withColumn("mean", mean).select(
        "source",
        F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int").alias("parts"),
        F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, grow, lambda acc: acc["cdf"]).alias("cdf"),
    )
    parts, cdf, draws, key, replica, shuffle_key = fresh(docs, "parts", "cdf", "draws", "key", "replica", "shuffle_key")
    d = join_small(docs, table.withColumnsRenamed({"parts": parts, "cdf": cdf}), ["source"])
    d = d.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    # a generator stands between the numbers and the table's lambda, which would else hash anew for each of its steps
    drawn = F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda j: uniform(F.lit(seed), F.col(key), j.cast("string")))
    d = d.withColumn(draws, F.explode(F.array(drawn)))
    n = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(cdf), lambda c: c < u)))
    d = d.select("*", F.posexplode(F.array_repeat(F.lit(True), n)).alias(replica, f"{replica}_")).drop(parts, cdf, draws, f"{replica}_")
    d = d.withColumn(replica, F.col(replica) + 1)
    d = d.withColumn(shuffle_key, F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col(key), F.col(replica).cast("string")))).drop(key)
    d = d.repartition(shuffle_key).sortWithinPartitions(shuffle_key)
    return d.drop("replica", "shuffle_key").withColumnsRenamed({replica: "replica", shuffle_key: "shuffle_key"})


def mixture(docs: DataFrame) -> DataFrame:
    """op6."""
    return mix(docs.select("doc_id", "source", "text"))


#: SQL for the rows of mixture().
SQL = f"""
WITH s AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS whole, sum(CASE WHEN size > 0 THEN pow(size, {ALPHA}) ELSE 0 END) AS parts FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN whole * (pow(size, {ALPHA}) / parts) / size ELSE 0 END AS rate FROM s, t),
m AS (SELECT source, rate, greatest(ceil(rate / {STEP}), 1)::BIGINT AS parts FROM r),
p AS (SELECT source, k, CASE WHEN rate > 0 THEN exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS p
      FROM m, range(0, {TERMS + 1}) AS g(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT d.doc_id, d.source, d.text, coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) AS key, m.parts
      FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
x AS (SELECT DISTINCT source, key, j, (('0x' || substr(md5('{SEED}|' || key || '|' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
      FROM (SELECT source, key, unnest(range(0, parts)) AS j FROM u)),
n AS (SELECT x.source, x.key, count(*) AS n FROM x JOIN c ON x.source IS NOT DISTINCT FROM c.source AND c.cdf < x.u GROUP BY ALL)
SELECT doc_id, source, text, replica::INTEGER AS replica, md5('{SEED}|order|' || key || '|' || replica) AS shuffle_key
FROM (SELECT u.*, unnest(range(1, n.n + 1)) AS replica FROM u JOIN n ON u.source IS NOT DISTINCT FROM n.source AND u.key = n.key)
"""
