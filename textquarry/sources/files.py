"""Readers and writers (SRC-01..04, 06, 08..10, SNK-01..05, SNK-07); JSON arrays and SQLite have modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fixed value: folders that hold no code of a project's own; hidden ones are skipped besides.
SKIPPED = ("node_modules", ".git", "dist", "build", "out", "__pycache__", ".next", ".nuxt", ".svelte-kit", "coverage", ".cache", ".venv", "venv", "env", ".env", "vendor")


def lenient(values: DataFrame, column: str = "value") -> DataFrame:
    """SRC-01: JSON lines as VARIANT; blank and malformed lines are skipped."""
    d = values.filter(F.col(column).rlike("\\S")).withColumn("record", F.try_parse_json(column))
    return d.filter(F.col("record").isNotNull())


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """SRC-03: those of the paths that exist, in any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if of(p).getFileSystem(conf).exists(of(p))]


def jsonl(spark: SparkSession, paths: str | list[str], mode: str = "lenient") -> DataFrame:
    """SRC-01..04: lenient (VARIANT records), strict (any bad line raises) or inferred."""
    paths = existing(spark, [paths] if isinstance(paths, str) else paths)
    if mode == "lenient":
        return lenient(spark.read.text(paths))
    return spark.read.option("mode", "FAILFAST" if mode == "strict" else "PERMISSIVE").json(paths)


def json_folder(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """SRC-06: a record per file; malformed files are skipped."""
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).json(path)


def newest_records(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """TOP-08: the records of json_folder() with the time their file was last written, the newest first; files of one time by path."""
    d = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).json(path)
    d = d.withColumns({"modified": F.col("_metadata.file_modification_time"), "file": F.col("_metadata.file_path")})
    return d.orderBy(F.desc("modified"), "file")


def code_files(spark: SparkSession, path: str, extensions: tuple[str, ...], skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """SRC-08: path and content of files by extension (upper and lower case alike), without those in skipped or hidden folders
    below `path`; the names of the folders above it do not matter. Files whose own names begin with _ or . are not listed by
    Spark's readers."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    depth = len([x for x in root.getFileSystem(conf).makeQualified(root).toUri().getPath().split("/") if x])
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    parts = F.split(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/", ""), "/")  # folders and the file
    name, folders = F.element_at(parts, -1), F.slice(parts, 1 + depth, F.greatest(F.size(parts) - 1 - depth, F.lit(0)))
    d = d.filter(F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin([e.lstrip(".").lower() for e in extensions]))
    return d.filter(~F.exists(folders, lambda p: p.isin(list(skipped)) | p.startswith(".")))


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK-01; nulls are kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """SNK-02."""
    df.write.partitionBy(split).parquet(path)


def corrections(feedback: DataFrame) -> DataFrame:
    """SNK-05, PRJ-07."""
    return feedback.filter(F.col("feedback_type") == "correction").select(F.col("message").alias("instruction"), F.coalesce(F.col("metadata")["corrected_response"], F.col("response")).alias("output"))


def synthetic(spark: SparkSession, n: int, pools: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """SNK-07: seeded examples, each value drawn from its pool by a hash of seed, id and name."""
    pick = lambda k, v: F.element_at(F.array(*map(F.lit, v)), (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(len(v))) + 1).cast("int")).alias(k)
    return spark.range(n).select("id", *[pick(k, v) for k, v in pools.items()])
