"""What the operators share: the shared folder, free column names, Arrow access to text."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: dict[str, SparkSession] = {}
_local: list[str] = []
_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: on a local session through PYTHONPATH, else as a zip that Spark ships."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local":
        env = sc.environment
        if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    elif sc.applicationId not in _shipped:
        name = os.path.join(tempfile.mkdtemp(prefix="textquarry-"), "textquarry.zip")
        with zipfile.ZipFile(name, "w") as z:
            for at, _, files in os.walk(os.path.join(ROOT, "textquarry")):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), ROOT))
        sc.addPyFile(name)
        atexit.register(shutil.rmtree, os.path.dirname(name), True)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session
    without that setting gets a temporary folder, deleted with the driver; a cluster without it is refused."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="textquarry-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


def cut(df: DataFrame, codec: str = "snappy", share: int = 1) -> DataFrame:
    """Cut lineage: write to the shared folder, under a folder named after the application, and read again. The table
    goes with free(), else when the driver ends; what a crashed driver leaves stands under its application's id.
    zstd makes tables that hold text smaller, for some memory and CPU. A table that is much smaller than what it comes
    from is written as partitions / share files: many small files cost more than they hold, and on local file systems
    each makes the JVM start a process."""
    spark = df.sparkSession
    if share > 1:
        df = df.coalesce(max(1, partitions(spark) // share))
    path = f"{shared_dir(spark)}/textquarry-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    if not _written:
        atexit.register(_clean)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = spark
    out._cut_path = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing will read again."""
    for t in tables:
        if getattr(t, "_cut_path", None) in _written:
            _delete(t._cut_path)


def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may be gone already
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def summed(rows: DataFrame, key: str, slots: int) -> DataFrame:
    """Sums of the float64 vectors in binary column `total` per key (none null), on two levels: by slot of the partitions first, so that
    no task holds a vector of every partition."""
    kind = rows.schema[key].dataType.simpleString()

    def add(*by: str):
        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            whole = np.zeros(0)
            for x in pdf["total"]:
                whole = np.frombuffer(x, np.float64) + (whole if len(whole) else 0)
            return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in by}, "total": [whole.tobytes()]})
        return total

    rows = rows.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
    rows = rows.groupBy(key, "slot").applyInPandas(add(key, "slot"), f"{key} {kind}, slot int, total binary")
    return rows.select(key, "total").groupBy(key).applyInPandas(add(key), f"{key} {kind}, total binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = f"_{n}"
        while k.lower() in taken:
            k = f"_{k}"
        taken.add(k.lower())
        out.append(k)
    return out


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of an id as text, mod m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its values; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int):
    """Ranges of rows of at most so many bytes each (a longer row stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def join_small(big: DataFrame, small: DataFrame, on: list[str], most: int = 10_000, salts: int = 64) -> DataFrame:
    """Left join to a table with one row per key (null keys match). Up to `most` rows, counted first, the table
    is broadcast; beyond, its rows are repeated for `salts` salts so that a hot key spreads over many tasks."""
    names = fresh(big, *[f"k{i}" for i in range(len(on))], "salt")
    keys, salt = names[:-1], names[-1]
    small = small.withColumnsRenamed(dict(zip(on, keys, strict=True)))
    same = [big[a].eqNullSafe(F.col(b)) for a, b in zip(on, keys, strict=True)]
    if small.count() <= most:
        out = big.join(F.broadcast(small), same, "left")
    else:
        mine = f"{salt}_"
        big = big.withColumn(mine, F.pmod(F.xxhash64(*[big[c] for c in big.columns]), F.lit(salts)))
        small = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        out = big.join(small, [*same, F.col(mine) == F.col(salt)], "left").drop(mine, salt)
    return out.drop(*keys)


def join_hot(big: DataFrame, small: DataFrame, on: str, count: str, how: str = "inner", least: int = 1_000) -> DataFrame:
    """big joined to small (a written table with one row per key, none null) on column `on`, where small's column `count`
    says how many rows of big have the key. A key with more than `limit` rows is dealt to as many tasks as it has
    multiples of that, its row of small copied for each. limit is at least total / (4 * partitions), so that there
    are at most 4 * partitions such keys, with twice as many copies: a bound that allows to broadcast them."""
    spark = big.sparkSession
    total = small.agg(F.sum(count)).first()[0] or 0
    limit = max(least, -(-total // (4 * partitions(spark))))
    key, n, salt, mine = fresh(big.join(small.limit(0), on), "key", "salts", "salt", "mine")
    hot = small.filter(F.col(count) > limit).select(F.col(on).alias(key), F.ceil(F.col(count) / limit).cast("int").alias(n))
    if hot.isEmpty():
        return big.join(small, on, how)
    size = F.when(F.col(count) > limit, F.ceil(F.col(count) / limit).cast("int")).otherwise(1)
    small = small.withColumn(salt, F.explode(F.sequence(F.lit(0), size - 1)))
    rows = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns])
    big = big.join(F.broadcast(hot), F.col(on) == F.col(key), "left").withColumn(mine, F.pmod(rows, F.coalesce(F.col(n), F.lit(1))).cast("int")).drop(key, n)
    return big.join(small.withColumnRenamed(on, key), (F.col(on) == F.col(key)) & (F.col(mine) == F.col(salt)), how).drop(key, mine, salt)
