"""Event metrics, stores, joins of small tables, learning and evaluation (AGG, WIN, TOP, SET, JOIN, STM, PIPE-04..09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.lineage import checkpointed


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """AGG-01, AGG-24."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def success_by(df: DataFrame, key: str, ok: Column) -> DataFrame:
    """AGG-02, AGG-10: successes, failures and rate per key."""
    d = df.withColumn("_ok", ok).groupBy(key).agg(F.count_if("_ok").alias("successes"), F.count_if(~F.col("_ok")).alias("failures"))
    return d.withColumn("rate", F.round(S.ratio(F.col("successes"), F.col("successes") + F.col("failures")), 6))


def rating_stats(df: DataFrame, rating: Column, processed: Column) -> DataFrame:
    """AGG-03."""
    return df.agg(F.count("*").alias("total"), F.round(F.coalesce(F.avg(rating), F.lit(0.0)), 6).alias("avg_rating"), F.count_if(processed).alias("processed"), F.count_if(~processed).alias("unprocessed"))


def last_average(df: DataFrame, key: str, order: list, value: str, limit: int | None = 100) -> DataFrame:
    """AGG-05, AGG-06 (Q12): the mean of the last `limit` values per key; all with None."""
    if limit:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= limit)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg_value"))


def hourly(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """AGG-07, STM-01; window() keeps naive time (Q30)."""
    return df.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg_value")).select(F.col("w.start").alias("hour"), "n", "avg_value")


def period_summary(df: DataFrame, kinds: list[str], kind: str = "event_type", value: str = "value") -> DataFrame:
    """AGG-06 in one pass."""
    return df.agg(*[F.round(F.coalesce(F.avg(F.when(F.col(kind) == k, F.col(value))), F.lit(0.0)), 6).alias(f"avg_{k}") for k in kinds])


def sessions(df: DataFrame, key: str = "user_id", ts: str = "ts", minutes: int = 60) -> DataFrame:
    """STM-02: a session ends when the next event comes more than `minutes` later (strict, Q25). Events meet by key and day; what a
    day holds comes down to a row a session before the days of a key are put together, so a hot key is spread over its days.
    Events without a time are one session, the first."""
    wide = lambda a, b: F.expr(f"coalesce(timestampdiff(MICROSECOND, {a}, {b}) > {minutes * 60_000_000}, true)").cast("int")
    day = Window.partitionBy(key, "_day").orderBy("_t")
    d = df.select(key, F.col(ts).alias("_t"), F.to_date(ts).alias("_day")).withColumn("_before", F.lag("_t").over(day))
    d = d.withColumn("_part", F.sum(wide("_before", "_t")).over(day)).groupBy(key, "_day", "_part").agg(F.count("*").alias("n"), F.min("_t").alias("started"), F.max("_t").alias("ended"))
    whole = Window.partitionBy(key).orderBy("_day", "_part")
    d = d.withColumn("_before", F.lag("ended").over(whole)).withColumn("session", F.sum(wide("_before", "started")).over(whole))
    return d.groupBy(key, "session").agg(F.sum("n").alias("n"), F.min("started").alias("started"), F.max("ended").alias("ended"))


def evict(df: DataFrame, key: str, ts: str, most: int) -> DataFrame:
    """STM-03: the `most` keys that were active last."""
    return df.groupBy(key).agg(F.max(ts).alias("last_activity")).orderBy(F.desc("last_activity"), key).limit(most)


def latest(df: DataFrame, key: str, version: Column, *values: str) -> DataFrame:
    """STM-12, Q13: latest row per key."""
    d = df.groupBy(key).agg(F.max_by(F.struct(*values), version).alias("_v"))
    return d.select(key, *[F.col(f"_v.{v}").alias(v) for v in values])


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SET-04."""
    return df.join(gone.select(key), key, "left_anti")


def running_mean(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """AGG-15, STM-05. Rows are dealt by ranges of key and order; each range has the means of its own rows, to which the sums of the
    ranges of its key before it are added, a row a range. So a hot key is spread over its ranges."""
    d = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    d = checkpointed(d.repartitionByRange("k", "o").sortWithinPartitions("k", "o")).withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("k", "part").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    sums = d.groupBy(F.col("k").alias("_k"), F.col("part").alias("_part")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.count("v").alias("n"))
    ahead = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", "_part", F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"))
    d = d.select("k", "part", "o", F.coalesce(F.sum("v").over(own), F.lit(0.0)).alias("x"), F.count("v").over(own).alias("y"))
    d = d.join(sums, d["k"].eqNullSafe(sums["_k"]) & (d["part"] == sums["_part"]))
    return d.select(F.col("k").alias(key), F.col("o").alias(order), F.round(F.try_divide(F.col("x") + F.col("s"), F.col("y") + F.col("n")), 9).alias("running_mean"))


def top_by_rate(df: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """TOP-01, FLT-11 over success_by()."""
    return df.filter(F.col("rate") >= least).orderBy(F.desc("rate"), F.desc("successes"), key).limit(k)


def improvement(current: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """JOIN-01: % change of score; no base: infinite if there is a score, else 0."""
    j = current.select(key, F.col("score").alias("c")).join(base.select(key, F.col("score").alias("b")), key)
    pct = F.when(F.col("b") == 0, F.when(F.col("c") > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise((F.col("c") - F.col("b")) / F.nullif(F.col("b"), F.lit(0)) * 100)
    return j.select(key, F.round(pct, 6).alias("improvement_pct"))


def config_full_outer(user: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """JOIN-09, SET-02, TOP-08."""
    return user.join(known, key, "full_outer").select(key, F.coalesce("value", "default_value").alias("value"), F.col("value").isNotNull().alias("is_set")).orderBy(key)


def available(wanted: DataFrame, registry: DataFrame, key: str, group: str) -> DataFrame:
    """JOIN-10, SET-03."""
    return wanted.join(registry.select(key).distinct(), key, "left_semi").groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("available"))


def recommendations(df: DataFrame, key: str) -> DataFrame:
    """PIPE-06 over success_by(): types that fail more often than they succeed, priority min(10, 5 + failures)."""
    return df.filter(F.col("failures") > F.col("successes")).select(key, "failures", F.least(F.lit(10), 5 + F.col("failures")).cast("long").alias("priority"))


def suggestions(df: DataFrame, key: str) -> DataFrame:
    """PIPE-07 over (key, n_errors, n_steps, n_decisions)."""
    rules = F.array_compact(F.array(F.when(F.col("n_errors") > 2, F.struct(F.lit(8).alias("priority"), F.lit("many_errors").alias("reason"))), F.when(F.col("n_steps") > 10, F.struct(F.lit(7).alias("priority"), F.lit("many_steps").alias("reason"))), F.when(F.col("n_decisions") == 0, F.struct(F.lit(6).alias("priority"), F.lit("no_decisions").alias("reason")))))
    return df.select(key, F.explode(rules).alias("r")).select(key, "r.priority", "r.reason")


def training_from_knowledge(df: DataFrame, key: str) -> DataFrame:
    """PIPE-09: best 20 over 0.6 and worst 10 under 0.4 of success_by()."""
    good = df.filter("rate > 0.6").orderBy(F.desc("rate"), key).limit(20).select(key, F.lit("positive").alias("kind"))
    bad = df.filter("rate < 0.4").orderBy("rate", key).limit(10).select(key, F.lit("negative").alias("kind"))
    return good.unionByName(bad)


def passes(df: DataFrame, task: str, ok: Column, k: int) -> DataFrame:
    """AGG-11: unbiased pass@k, and 1 - (1 - c/n)^k (Q3)."""
    d = df.groupBy(task).agg(F.count("*").alias("n"), F.count_if(ok).alias("c"))
    return d.select(task, "n", "c", F.round(S.pass_at_k(F.col("n"), F.col("c"), k), 6).alias("pass_unbiased"), F.round(1 - F.pow(1 - F.col("c") / F.col("n"), F.lit(k)), 6).alias("pass_replaced"))


def category_accuracy(df: DataFrame, category: str, tool_ok: Column, params_ok: Column) -> DataFrame:
    """AGG-08, PIPE-14: per category and overall in one pass (grouping sets)."""
    d = df.select(F.col(category), tool_ok.cast("int").alias("t"), params_ok.cast("int").alias("p"))
    g = d.rollup(category).agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("tool_accuracy"), F.round(F.avg("p"), 6).alias("param_accuracy"))
    return g.withColumn("overall", F.round((F.col("tool_accuracy") + F.col("param_accuracy")) / 2, 6))


def cron_matches(df: DataFrame, ts: str, minute: str, hour: str, weekday: str) -> DataFrame:
    """STM-09: rows whose minute a cron rule names; lists, steps and * (0 is Sunday, Q6)."""
    def field(text: str, value: Column) -> Column:
        if text == "*":
            return F.lit(True)
        if text.startswith("*/"):
            return value % int(text[2:]) == 0
        return value.isin([int(x) for x in text.split(",")])
    return df.filter(field(minute, F.minute(ts)) & field(hour, F.hour(ts)) & field(weekday, F.dayofweek(ts) - 1))


def demand(df: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """WIN-11: requests of a key within the last `seconds`, denied ones included (Q23). Requests meet by key and block of time; the last
    ones of a block also go to the next block, where they are counted but not returned. So a hot key is spread over its blocks."""
    back, block = seconds * 1_000_000, max(seconds, 3_600) * 1_000_000
    d = df.select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    d = d.withColumn("_block", F.expr(f"(_at - pmod(_at, {block})) div {block}"))
    near = F.when(F.col("_at") >= (F.col("_block") + 1) * block - back, F.struct((F.col("_block") + 1).alias("b"), F.lit(False).alias("own")))
    d = d.select(key, ts, "_at", F.explode(F.array_compact(F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own")), near))).alias("_x"))
    w = Window.partitionBy(key, "_b").orderBy("_at").rangeBetween(-back, 0)
    d = d.select(key, ts, "_at", F.col("_x.b").alias("_b"), F.col("_x.own").alias("_own"))
    return d.withColumn("in_window", F.count("*").over(w)).filter("_own").select(key, ts, "in_window")
