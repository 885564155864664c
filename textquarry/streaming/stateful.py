"""Stateful processors and upserts (STM-03, STM-05, STM-07, STM-12 as streams). Each gives its batch twin's result once all input is read.

The processors keep their state in the state store that a cluster configures; transformWithState takes the RocksDB one
(configured() sets it)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


class _Cache(StatefulProcessor):
    """STM-07 of one key: when its entry was filled. A timer in event time drops the entry once no request can find it fresh."""

    def __init__(self, key: str, ts: str, seconds: int) -> None:
        self.key, self.ts, self.life = key, ts, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.filled = handle, handle.getValueState("filled", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        at = self.filled.get()[0] if self.filled.exists() else None
        out, old = [], at
        for t in sorted(x for f in rows for x in f["at"]):
            hit = at is not None and t - at < self.life
            at = at if hit else t
            out.append((key[0], pd.Timestamp(t, unit="us"), hit))
        if at != old:
            self.filled.update((at,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((at + self.life) // 1000 + 1)
        yield pd.DataFrame(out, columns=[self.key, self.ts, "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.filled.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_cache_stream(events: DataFrame, key: str, ts: str, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """STM-07: (key, ts, hit) for each request, as ttl_cache(); requests of a key come in order from batch to batch, within a batch
    they are sorted. Requests later than the watermark are dropped, as their entry may be gone; so are null keys and times."""
    kind = events.schema[key].dataType
    d = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    d = d.select(key, _micros(ts).alias("at"), F.col(ts).cast("timestamp").alias("_time")).withWatermark("_time", late)
    out = T.StructType([T.StructField(key, kind), T.StructField(ts, T.TimestampType()), T.StructField("hit", T.BooleanType())])
    return d.groupBy(key).transformWithStateInPandas(_Cache(key, ts, seconds), out, "Append", "EventTime")


class _Sessions(StatefulProcessor):
    """STM-03 of one shard of the keys: the keys that were active last, at most `most`."""

    def __init__(self, key: str, kind: T.DataType, most: int, idle_ms: int | None) -> None:
        self.key, self.kind, self.most, self.idle_ms = key, kind, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", T.StructType([T.StructField("key", self.kind)]), T.StructType([T.StructField("at", T.LongType())]), self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        seen: dict = {}
        for f in rows:
            for k, t in zip(f[self.key], f["at"], strict=True):
                seen[k] = max(t, seen.get(k, t))
        known = {k[0]: v[0] for k, v in self.live.iterator()}
        changed = {k: t for k, t in seen.items() if t > known.get(k, t - 1)}
        ranked = sorted({**known, **changed}.items(), key=lambda x: (-x[1], x[0]))
        gone = {k for k, _ in ranked[self.most :]}
        for k in gone & known.keys():
            self.live.removeKey((k,))
        for k, t in changed.items():
            if k not in gone:
                self.live.updateValue((k,), (t,))
        out = [(k, pd.Timestamp(t, unit="us"), True) for k, t in changed.items() if k not in gone]
        out += [(k, pd.Timestamp(known[k], unit="us"), False) for k in gone & known.keys()]
        yield pd.DataFrame(out, columns=[self.key, "last_activity", "live"])

    def close(self) -> None:
        pass


def session_store_stream(events: DataFrame, key: str, ts: str, most: int, shards: int = 8, idle_ms: int | None = None) -> DataFrame:
    """STM-03: changes (key, last_activity, live) of the sessions that are kept. Keys are dealt to shards, each of which keeps its own
    `most` last active ones, so that no state is larger and no task sees all keys; live_sessions() takes the best of the shards. With
    idle_ms the state store also forgets sessions that no event renewed for so long (by the clock)."""
    kind = events.schema[key].dataType
    d = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    d = d.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("_shard"), key, _micros(ts).alias("at"))
    out = T.StructType([T.StructField(key, kind), T.StructField("last_activity", T.TimestampType()), T.StructField("live", T.BooleanType())])
    return d.groupBy("_shard").transformWithStateInPandas(_Sessions(key, kind, most, idle_ms), out, "Update", "ProcessingTime" if idle_ms else "None")


def live_sessions(changes: DataFrame, key: str, most: int) -> DataFrame:
    """What the changes of session_store_stream() have come to, as evict(): a key that was dropped and came back is live."""
    last = changes.groupBy(key).agg(F.max(F.struct("last_activity", (~F.col("live")).alias("gone"))).alias("x"))
    last = last.filter(~F.col("x.gone")).select(key, F.col("x.last_activity").alias("last_activity"))
    return last.orderBy(F.desc("last_activity"), key).limit(most)


class _Mean(StatefulProcessor):
    """STM-05 of one key: number and sum of the values so far."""

    def __init__(self, key: str, order: str) -> None:
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        n, total = self.sums.get() if self.sums.exists() else (0, 0.0)
        d = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        count = d["value"].notna().cumsum() + n
        sums = d["value"].fillna(0.0).cumsum() + total
        self.sums.update((int(count.iloc[-1]), float(sums.iloc[-1])))
        yield pd.DataFrame({self.key: [key[0]] * len(d), self.order: d[self.order].to_numpy(), "running_mean": (sums / count.where(count > 0)).round(9).to_numpy()})

    def close(self) -> None:
        pass


def running_mean_stream(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """STM-05: (key, order, running_mean) for each row, as running_mean(); rows of a key come in order from batch to batch, within a
    batch they are sorted. Null values do not count; null keys take no part."""
    d = events.filter(F.col(key).isNotNull()).select(key, order, F.col(value).cast("double").alias("value"))
    out = T.StructType([events.schema[key], events.schema[order], T.StructField("running_mean", T.DoubleType())])
    return d.groupBy(key).transformWithStateInPandas(_Mean(key, order), out, "Append", "None")


class Snapshot:
    """STM-12: a table with the latest row of each key, upserted batch by batch. A batch rewrites the buckets of keys that it touches and
    then commits by writing which batch holds each bucket. A batch that is committed already changes nothing, and what a
    crash left without a commit is written anew, so a restarted stream goes on where it was. Equal versions: the row that compares larger; rows
    without a key take no part, null versions are the lowest."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.version, self.buckets = spark, path.rstrip("/"), key, version, buckets
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def commits(self) -> list[int]:
        """Committed batches, in order."""
        if not self._fs.exists(self._at("commits")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at("commits")))
        return sorted(int(n) for n in names if n.isdigit())

    def _held(self, batch: int) -> dict[str, int]:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{batch}", wholetext=True).first()[0])

    def _read(self, held: dict[str, int], wanted: set[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/data/{b}/_bucket={i}" for i, b in held.items() if wanted is None or int(i) in wanted]
        return self.spark.read.parquet(*paths) if paths else None

    def table(self) -> DataFrame | None:
        """The table as of the last commit; None before the first."""
        done = self.commits()
        return self._read(self._held(done[-1])) if done else None

    def upsert(self, rows: DataFrame, batch: int) -> None:
        done = self.commits()
        if batch in done:
            return
        held = self._held(done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = rows.filter(F.col(self.key).isNotNull())
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # `buckets` numbers at most
        if touched:
            old = self._read(held, touched)
            every = rows if old is None else old.unionByName(rows)
            rest = [c for c in rows.columns if c not in (self.key, self.version)]
            last = every.groupBy(self.key).agg(F.max(F.struct(self.version, *rest)).alias("_x")).select(self.key, "_x.*").select(*rows.columns)
            last.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{batch}")
        held |= {str(i): batch for i in touched}
        out = self._fs.create(self._at(f"commits/.{batch}"), True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        self._fs.rename(self._at(f"commits/.{batch}"), self._at(f"commits/{batch}"))
        used = {str(b) for x in (self._held(done[-1]) if done else {}, held) for b in x.values()}
        for s in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else ():
            if s.getPath().getName() not in used:  # neither this commit nor the one before it reads it
                self._fs.delete(s.getPath(), True)

    def follow(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer that upserts every batch of a stream."""
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint)
