"""Structured Streaming forms (STM-01, 02, 04, 06, 08). Each gives its batch twin's result once all input is read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP; naive times go there and back in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STM-01."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "avg_value")


def session_stream(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """STM-02; equality with the gap starts a new session here (Q25)."""
    return _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def retain(events: DataFrame, now: str, days: int = 30) -> DataFrame:
    """STM-06, FLT-12: now is a parameter."""
    return events.filter(F.col("ts") > F.expr(f"timestamp_ntz'{now}' - interval {days} days"))


def rate_limit(events: DataFrame, key: str = "user_id", most: int = 60, seconds: int = 60) -> DataFrame:
    """STM-04, Q23: a request is admitted if fewer than `most` were admitted in the last `seconds`. The state of a key
    is the times of its admitted requests within the window, at most `most`."""
    def admit(keys, frames, state):
        times = list(state.get[0]) if state.exists else []
        out = []
        for f in frames:
            for t in sorted(f["at"]):
                times = [x for x in times if x > t - seconds]
                ok = len(times) < most
                times += [t] * ok
                out.append((keys[0], t, ok))
        state.update((times,))
        yield pd.DataFrame(out, columns=[key, "at", "admitted"])

    kind = events.schema[key].dataType.simpleString()
    d = events.select(key, (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return d.groupBy(key).applyInPandasWithState(admit, f"{key} {kind}, at double, admitted boolean", "times array<double>", "append", "NoTimeout")


def append_log(events: DataFrame, path: str, checkpoint: str):
    """SNK-04, STM-08: a file sink by micro-batches."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
