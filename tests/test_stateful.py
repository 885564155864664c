"""Streams that keep state, against their batch twins after all input; upserts over restarts."""
import os
import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import learning, metrics
from textquarry.streaming import stateful

DATA = "/root/testdata/sf0.001/events.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in five files in the order of time."""
    stateful.configured(spark)
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(DATA)
    cuts = e.approxQuantile("event_id", [0.2, 0.4, 0.6, 0.8], 0.0)
    for i, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 1e18])):
        e.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.parquet(f"{folder}/p{i}")
    return e, f"{folder}/*"


def run(spark, folder, schema, make, tmp_path, mode="append"):
    """All rows of make(stream), read file by file and stopped once in between."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = []
    for _ in range(2):  # the second start finds nothing new, but ends what a batch without data may still do
        q = make(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda d, i: rows.extend(d.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    return rows


def test_cache(spark, parts, tmp_path):
    e, folder = parts
    rows = run(spark, folder, e.schema, lambda s: stateful.ttl_cache_stream(s, "user_id", "ts", 3600), tmp_path)
    want = learning.ttl_cache(e, "user_id", "ts", 3600).collect()
    assert sorted((r.user_id, r.ts, r.hit) for r in rows) == sorted((r.user_id, r.ts, r.hit) for r in want)
    assert {r.hit for r in want} == {True, False}


def test_session_store(spark, parts, tmp_path):
    e, folder = parts
    rows = run(spark, folder, e.schema, lambda s: stateful.session_store_stream(s, "user_id", "ts", 2, shards=2), tmp_path, "update")
    assert any(not r.live for r in rows)
    changes = spark.createDataFrame(rows, "user_id long, last_activity timestamp, live boolean")
    got = [(r.user_id, r.last_activity) for r in stateful.live_sessions(changes, "user_id", 2).collect()]
    assert got == [(r.user_id, r.last_activity) for r in metrics.evict(e, "user_id", "ts", 2).collect()]


def test_running_mean(spark, parts, tmp_path):
    e, folder = parts
    rows = run(spark, folder, e.schema, lambda s: stateful.running_mean_stream(s, "user_id", "event_id", "value"), tmp_path)
    want = metrics.running_mean(e, "user_id", "event_id", "value").collect()
    plain = lambda rs: sorted((r.user_id, r.event_id, round(r.running_mean, 8)) for r in rs)
    assert plain(rows) == plain(want)


def test_upserts_survive_a_restart(spark, parts, tmp_path):
    e, folder = parts
    path, checkpoint = str(tmp_path / "t"), str(tmp_path / "ck")
    make = lambda: stateful.Snapshot(spark, path, "user_id", "event_id", buckets=7)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder).select("user_id", "event_id", "event_type", "value")

    class Stopped(Exception):
        pass

    table = make()

    def fails(rows, batch):
        if batch == 2:  # after data was written, before the commit
            rows.withColumn("_bucket", F.lit(0)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/2")
            raise Stopped
        table.upsert(rows, batch)

    with pytest.raises(Exception):
        stream.writeStream.foreachBatch(fails).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert table.commits() == [0, 1]
    again = make()
    again.follow(stream, checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert again.commits() == [0, 1, 2, 3, 4]
    want = sorted(tuple(r) for r in metrics.latest(e, "user_id", F.col("event_id"), "event_id", "event_type", "value").collect())
    assert sorted(tuple(r) for r in again.table().collect()) == want
    again.upsert(e.select("user_id", "event_id", "event_type", (F.col("value") + 1).alias("value")), 4)  # the same batch again
    assert sorted(tuple(r) for r in again.table().collect()) == want


def test_upserts_of_hard_rows(spark, tmp_path):
    t = stateful.Snapshot(spark, str(tmp_path / "t"), "k", "v", buckets=3)
    assert t.table() is None
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long, x string")
    t.upsert(rows(), 0)
    t.upsert(rows(("a", None, "n"), (None, 1, "no"), ("b", 2, None), ("b", 2, "p")), 1)
    t.upsert(rows(("a", 0, "z"), ("b", 1, "late")), 2)
    assert sorted(map(tuple, t.table().collect())) == [("a", 0, "z"), ("b", 2, "p")]
    rng, best = random.Random(2), {}
    for batch in range(3, 8):
        some = [(f"k{rng.randrange(30)}", rng.randrange(1000), f"x{rng.randrange(9)}") for _ in range(40)]
        t.upsert(rows(*some), batch)
        for k, v, x in some:
            best[k] = max(best.get(k, (v, x)), (v, x))
    assert {r.k: (r.v, r.x) for r in t.table().filter("k like 'k%'").collect()} == best
    assert len(os.listdir(tmp_path / "t" / "data")) <= 7
