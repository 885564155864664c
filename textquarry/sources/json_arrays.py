"""SRC-05: large JSON arrays, split over many tasks.

Spark's text reader cuts a file into ranges and these into pieces between commas, on any store. Whether a comma parts two records depends
on all that stands before it: on whether it is within a string, and on how deep in brackets it is. Each range works out what it makes of
both ways of entering it (within a string or not): the parity of its quotes and the change of depth. These few numbers are composed from range to range;
then each range knows where it starts, and cuts its records. What lies over the borders of ranges comes together again by the number of its record."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

_BLANK = "\ufeff \t\r\n"


def _piece_ends(texts: list[str], within: bool) -> tuple[np.ndarray, np.ndarray]:
    """At the comma after each piece: whether it is within a string, and the depth counted from the first piece's start, which is within
    a string or not."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b",".join([*raw, b""]), np.uint8)
    ends, at = np.cumsum([len(r) + 1 for r in raw]) - 1, np.arange(len(data))
    solid = np.maximum.accumulate(np.where(data != 92, at, -1))  # the last byte that is no backslash
    quote = (data == 34) & ((at - 1 - np.append(-1, solid[:-1])) % 2 == 0)
    inside = (np.cumsum(quote) + within) % 2 == 1
    step = ((data == 91) | (data == 123)).astype(np.int64) - ((data == 93) | (data == 125))
    return inside[ends], np.cumsum(np.where(inside, 0, step))[ends]


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """Key and pieces of each range in a partition, some at a time, and whether these are its first."""
    last = None
    for b in batches:
        files, starts, texts = (b.column(i).to_pylist() for i in range(3))
        i = 0
        while i < len(texts):
            key, j = (files[i], starts[i]), i
            while j < len(texts) and (files[j], starts[j]) == key:
                j += 1
            yield key, texts[i:j], key != last
            last, i = key, j


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and each way of entering it: whether it ends within a string, the change of depth, and how many commas
    outside of strings stand at each depth; and the first character that is no white space."""
    found: dict[tuple, tuple[list, list[str]]] = {}
    for key, texts, _ in _ranges(batches):
        ways, first = found.setdefault(key, ([[False, 0, {}], [True, 0, {}]], [""]))
        for way in ways:
            inside, depth = _piece_ends(texts, way[0])
            at, n = np.unique(depth[~inside] + way[1], return_counts=True)
            for d, c in zip(at.tolist(), n.tolist(), strict=True):
                way[2][d] = way[2].get(d, 0) + c
            way[0], way[1] = bool(inside[-1]), way[1] + int(depth[-1])
        first[0] = first[0] or next((x[0] for t in texts if (x := t.lstrip(_BLANK))), "")
    if found:
        rows = [(f, s, json.dumps(ways), first[0]) for (f, s), (ways, first) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], ["file", "start", "ways", "first"])


def _composed(rows: list) -> tuple[dict[tuple[str, int], tuple[bool, int, int, bool]], dict[str, int]]:
    """Where each range starts: within a string, at which depth, at the record of which number, in an array; and each file's last record."""
    state, lasts, file = {}, {}, None
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, within, depth, no, array = r.file, False, 0, 0, None
        if array is None and r.first:
            array = r.first == "["
        state[r.file, r.start] = within, depth, no, bool(array)
        ends, change, commas = json.loads(r.ways)[within]
        no += commas.get(str(1 - depth), 0) if array else 0
        within, depth = ends, depth + change
        lasts[file] = no if array else -1
    return state, lasts


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, value): the text of each record of the arrays in files of JSON, numbered from 0 in their order. A file that holds no array
    is one record; an empty array or file has none. Ranges follow spark.sql.files.maxPartitionBytes."""
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    state, lasts = _composed(pieces.mapInArrow(_steps, "file string, start long, ways string, first string").collect())  # a row a range
    sent = spark.sparkContext.broadcast((state, lasts))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records and parts of records: (file, start, no, whole, value)."""
        states, last = sent.value
        out: list[tuple] = []
        held: list[str] = []
        key, no, inside, deep, array, begun = None, 0, False, 0, True, 0

        def put(ends: bool) -> None:
            """What is held ends here, or goes on in the next range; the first record of a range may have begun before it."""
            if held:
                value, closes = ",".join(held), array and no == last[key[0]] and deep == 0 and not inside
                if array and no == 0 and key[1] == 0:
                    value = value.lstrip(_BLANK).removeprefix("[")
                if closes and not ends:
                    value = value.rstrip(_BLANK).removesuffix("]")
                out.append((*key, no, (ends or closes) and (no > begun or key[1] == 0), value))
                held.clear()

        for now, texts, new in _ranges(batches):
            if new:
                if key is not None:
                    put(False)
                key, (inside, deep, no, array) = now, states[now]
                begun = no
            ins, depths = _piece_ends(texts, inside)
            parts = (~ins & (depths + deep == 1)).tolist() if array else [False] * len(texts)
            for t, ends in zip(texts, parts, strict=True):
                held.append(t)
                if ends:
                    put(True)
                    no += 1
            inside, deep = bool(ins[-1]), deep + int(depths[-1])
            if len(out) >= 5_000:
                yield _batch(out)
                out.clear()
        if key is not None:
            put(False)
        if out:
            yield _batch(out)

    parts = pieces.mapInArrow(cut, "file string, start long, no long, whole boolean, value string")
    # only records that lie over borders of ranges meet again
    over = parts.filter("not whole").groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("x"))
    over = over.select("file", "no", F.array_join(F.transform("x", lambda x: x.value), ",").alias("value"))
    both = parts.filter("whole").select("file", "no", "value").unionByName(over)
    return both.select("file", "no", F.regexp_replace("value", f"^[{_BLANK}]+|[{_BLANK}]+$", "").alias("value")).filter("value <> ''")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "no", "whole", "value"])


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-05: the records of JSON arrays, with columns as given or else inferred, as one task a file would read them."""
    rows = records(spark, path).select("value")
    if schema is not None:
        return rows.select(F.from_json("value", schema).alias("x")).select("x.*")
    texts = getattr(rows._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(texts), spark)
