"""Joins on keys of very different frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_dealt(big: DataFrame, small: DataFrame, counts: DataFrame, on: str, row: str, least: int = 10_000) -> DataFrame:
    """big joined to small on column `on`, where the written table counts (on, n) says how many rows of big have a key. A key of more than
    `least` rows, and of more than its share of a quarter of a partition, is dealt to several tasks by a hash of big's column `row`, and its rows of small are
    copied for each. There are at most 4 * partitions such keys, which allows to broadcast them."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(least, -(-total // (4 * partitions(big))))
    hot = counts.filter(F.col("n") > limit).select(F.col(on).alias("_on"), F.ceil(F.col("n") / limit).cast("int").alias("_deals"))
    if hot.isEmpty():
        return big.join(small, on)
    hot = F.broadcast(hot)
    big = big.join(hot, big[on] == F.col("_on"), "left").withColumn("_deal", F.pmod(F.xxhash64(row), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_on", "_deals")
    small = small.join(hot, small[on] == F.col("_on"), "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_on", "_deals")
    return big.join(small, [on, "_deal"]).drop("_deal")
