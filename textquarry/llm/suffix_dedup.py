"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every byte that a string of LENGTH bytes covers which also starts elsewhere, in any document or the same, is removed.

A suffix array here holds the starts of strings of LENGTH bytes, ordered by a 62-bit fingerprint of the string, so
that equal strings stand together whatever the texts; matches are compared byte by byte before they count, and where
different strings share a fingerprint all that have it are sorted by their bytes. New batches get an array of their own,
which is looked up in all levels of the family for matches and joins it as a level; two levels of similar size are
merged, so that there are only as many levels as the logarithm of the number of batches.

So that equal strings meet in one task, each string is assigned to an anchor: the position with the smallest hash of
GRAM bytes among the LENGTH - GRAM + 1 in it. Equal strings choose equal anchors. Anchors whose hash occurs once are
done with; a hash that very many have is dealt to many tasks. The others bring the bytes around them (up to
LENGTH - GRAM before, LENGTH after); equal surroundings are counted once. Surroundings that occur twice are repeated as
they stand, by their 128-bit digest; only those that differ at an anchor that others share go through a family. A family
ends with its groups: strings never match across them. An anchor with many different surroundings is split by ranges of
where strings start before it: within a range, strings can only match if the bytes that all of them share are equal, and
these choose the task.

Null text counts as empty; texts shorter than LENGTH lose nothing. Rows that repeat a document are copies like any other.
Null doc_ids are kept. Extra columns are not read. An empty table gives no row. A text is held whole by the task that
reads it, with some 40 bytes a byte for a text over CHUNK bytes; Spark's own limit of 2 GB a value holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import chunks, cut, free, join_hot, partitions, ready, utf8

LENGTH, GRAM = 400, 200
CHUNK = 1 << 20  # bytes of texts whose anchors are found at a time
ROOM = 1 << 22  # bytes of segments after which a family ends with the group
REACH = LENGTH - GRAM  # a string starts at most so far before its anchor
#: (different surroundings of an anchor, ranges of starts): the more there are, the finer they are split.
SPLITS = ((2_000, 1), (50_000, 8), (1 << 62, REACH + 1))
_TOP = np.iinfo(np.uint64).max


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every w values in a row, from running ones within blocks of w."""
    op, pad = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, pad, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the text and hash of every anchor."""
    w = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    at = np.arange(len(data) - gram + 1)
    h = hashing.spans(hashing.prefix(data), at, at + gram)
    h = np.clip(h, 1, _TOP - np.uint64(1))
    low = _sliding(h, w, True)
    doc = np.searchsorted(off, np.arange(len(low)), "right") - 1
    low[np.arange(len(low)) + length > off[doc + 1]] = 0  # strings that would run into the next text
    # a place is an anchor if it is the smallest of some string: of those that start up to w - 1 before it
    best = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, False)
    i = np.flatnonzero(best[: len(h)] == h)
    doc = np.searchsorted(off, i, "right") - 1
    return doc, i - off[doc], h[i]


class Family:
    """Levels of suffix arrays over the segments of one task.

    A segment is (bytes, anchor's place in it, first and last distance before the anchor at which strings start).
    low and high hold, for each segment, the first and last start of a string that was found elsewhere."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels = length, []
        self.data, self.filled = np.zeros(1 << 20, np.uint8), 0
        none = np.zeros(0, np.int64)
        self.base, self.low, self.high, self.group, self.anchor = none, none, none, none, none
        self.crossed: set[int] = set()  # fingerprints that different strings share

    def add(self, segs: list[bytes], group: np.ndarray, anchor: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        """A new batch. Strings match within a group, at the same distance before the anchor: the same place of a
        text, which several segments may hold, is then never taken for a second occurrence."""
        size = np.array([len(s) for s in segs], np.int64)
        first, n = len(self.base), int(size.sum())
        while self.filled + n > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(n, len(self.data) // 2), np.uint8)])
        batch = np.frombuffer(b"".join(segs), np.uint8)
        self.data[self.filled : self.filled + n] = batch
        own = np.cumsum(size) - size
        self.base = np.concatenate([self.base, self.filled + own])
        self.low = np.concatenate([self.low, np.full(len(segs), 1 << 40)])
        self.high = np.concatenate([self.high, np.full(len(segs), -1)])
        self.group, self.anchor = np.concatenate([self.group, group]), np.concatenate([self.anchor, anchor])
        a, b = np.maximum(anchor - far, 0), np.minimum(anchor - near, size - self.length)
        count = np.maximum(b - a + 1, 0)
        seg = np.repeat(np.arange(len(segs)), count)
        start = np.repeat(own + a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        away = (anchor[seg] - (start - own[seg])).astype(np.uint64)
        fp = hashing.mix(hashing.spans_mod(hashing.prefix_mod(batch), start, start + self.length) ^ hashing.mix(hashing.mix(group.view(np.uint64)[seg]) + away))
        order = np.argsort(fp, kind="stable")
        level = (fp[order], (seg[order] + first).astype(np.int64), start[order] + self.filled)
        self.filled += n
        self._neighbours(level)
        for old in self.levels:
            at = np.minimum(np.searchsorted(old[0], level[0]), max(len(old[0]) - 1, 0))
            hit = np.flatnonzero(old[0][at] == level[0]) if len(old[0]) else at[:0]
            self._match(level[0][hit], *(x[hit] for x in level[1:]), *(x[at[hit]] for x in old[1:]))
        self.levels.append(level)
        if self.crossed:
            self._sort_out()
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            x, y = self.levels.pop(), self.levels.pop()
            fp = np.concatenate([y[0], x[0]])
            order = np.argsort(fp, kind="stable")
            self.levels.append(tuple(np.concatenate([p, q])[order] for p, q in zip(y, x, strict=True)))

    def _neighbours(self, level: tuple) -> None:
        i = np.flatnonzero(level[0][1:] == level[0][:-1])
        self._match(level[0][i], level[1][i], level[2][i], level[1][i + 1], level[2][i + 1])

    def _match(self, fp: np.ndarray, seg: np.ndarray, start: np.ndarray, seg2: np.ndarray, start2: np.ndarray) -> None:
        """Strings at start and start2 have the same fingerprint. Only a segment's first and last match count, so
        only those are compared; where one differs, its fingerprint is noted and the next one is tried."""
        fp, seg, other_seg = np.concatenate([fp, fp]), np.concatenate([seg, seg2]), np.concatenate([seg2, seg])
        start, other = np.concatenate([start, start2]), np.concatenate([start2, start])
        rel = start - self.base[seg]
        for sign, best in ((1, self.low), (-1, self.high)):
            todo = np.flatnonzero(sign * rel < sign * best[seg])
            todo = todo[np.lexsort((sign * rel[todo], seg[todo]))]
            while len(todo):
                lead = np.flatnonzero(np.concatenate([[True], seg[todo][1:] != seg[todo][:-1]]))
                take = todo[lead]
                ok = np.concatenate([self._equal(seg[t], start[t], other_seg[t], other[t]) for t in np.array_split(take, len(take) // 20_000 + 1)])
                best[seg[take[ok]]] = rel[take[ok]]
                if ok.all():
                    break
                self.crossed.update(fp[take[~ok]].tolist())
                wrong = set(seg[take[~ok]].tolist())
                todo = np.delete(todo, lead)
                todo = todo[[s in wrong for s in seg[todo].tolist()]]

    def _equal(self, seg: np.ndarray, a: np.ndarray, seg2: np.ndarray, b: np.ndarray) -> np.ndarray:
        span = np.arange(self.length)
        alike = (self.group[seg] == self.group[seg2]) & (self.anchor[seg] - a + self.base[seg] == self.anchor[seg2] - b + self.base[seg2])
        return alike & (self.data[a[:, None] + span] == self.data[b[:, None] + span]).all(1)

    def _sort_out(self) -> None:
        """All strings of the noted fingerprints, by group, distance before the anchor and bytes."""
        found: dict[tuple, list] = {}
        noted = np.array(sorted(self.crossed), np.uint64)
        for fp, segs, starts in self.levels:
            for lo, hi in zip(np.searchsorted(fp, noted).tolist(), np.searchsorted(fp, noted, "right").tolist(), strict=True):
                for seg, start in zip(segs[lo:hi].tolist(), starts[lo:hi].tolist(), strict=True):
                    rel = start - int(self.base[seg])
                    key = (int(self.group[seg]), int(self.anchor[seg]) - rel, self.data[start : start + self.length].tobytes())
                    found.setdefault(key, []).append((seg, rel))
        for same in found.values():
            if len(same) > 1:
                for seg, rel in same:
                    self.low[seg], self.high[seg] = min(self.low[seg], rel), max(self.high[seg], rel)


def packed(rows: DataFrame) -> DataFrame:
    """rows with text (not null) as compressed bytes, column z, for the shuffles that carry whole texts."""
    at = rows.columns.index("text")
    rest = [c for c in rows.columns if c != "text"]

    def run(batches):
        small = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = pc.cast(b.column(at), pa.large_binary())
            z = pa.array([small.compress(memoryview(x.as_buffer())) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], z], [*rest, "z"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest]
    return rows.mapInArrow(run, ", ".join([*kinds, "z binary"]))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), and start and stop (bytes) of strings to remove; spans may overlap."""
    spark = ready(docs.sparkSession)
    kind, parts = docs.schema["doc_id"].dataType.simpleString(), partitions(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter(F.octet_length("text") >= LENGTH)

    def find(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in chunks(off, CHUNK):
                doc, at, h = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i])
                row = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(2).take(row), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "th", "at", "h"])

    found = cut(rows.mapInArrow(find, f"doc_id {kind}, th long, at int, h long"), "zstd")
    shared = cut(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "zstd", share=8)
    places = join_hot(found, shared, "h", "n").groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).agg(F.array_sort(F.array_distinct(F.collect_list("at"))).alias("places"))
    with_places = packed(rows).join(places, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "z", "places")

    def surroundings(batches):
        seen: set[bytes] = set()  # of this task; their bytes need not be sent again
        large = zstandard.ZstdDecompressor()
        for b in batches:
            for i, t, z, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw, out = large.decompress(z), []
                for p in at:
                    lo = max(0, p - REACH)
                    seg = raw[lo : p + LENGTH]
                    key = hashlib.blake2b(seg, digest_size=16, key=str(p - lo).encode()).digest()
                    out.append((i, t, lo, p - lo, len(seg), key, None if key in seen else seg))
                    seen.add(key)
                if len(seen) > 200_000:
                    seen.clear()
                cols = list(zip(*out, strict=True))
                types = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, types, strict=True)], names)

    names = ["doc_id", "th", "lo", "anchor", "size", "key", "seg"]
    around = cut(with_places.mapInArrow(surroundings, f"doc_id {kind}, th long, lo int, anchor int, size int, key binary, seg binary"), "zstd")
    free(found, shared)
    each = around.groupBy("key").agg(F.count("*").alias("n"), F.first("seg", ignorenulls=True).alias("seg"), F.first("anchor").alias("anchor"))
    each = cut(each.withColumn("h", F.xxhash64(F.substr("seg", F.col("anchor") + 1, F.lit(GRAM)))), "zstd")
    differ = each.groupBy("h").agg(F.count("*").alias("different"), F.min("n").alias("least")).filter("different > 1 AND least = 1").drop("least")
    differ = cut(differ, share=16)
    ranges = F.lit(SPLITS[-1][1])
    for most, n in reversed(SPLITS[:-1]):
        ranges = F.when(F.col("different") <= most, n).otherwise(ranges)
    edge = lambda r: F.floor(r * (REACH + 1) / F.col("ranges")).cast("int")
    asked = join_hot(each, differ, "h", "different").withColumn("ranges", ranges).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    asked = asked.withColumn("near", edge(F.col("r"))).withColumn("far", edge(F.col("r") + 1) - 1)
    # what all strings of the range share: `near` bytes before the anchor, LENGTH - far after it
    core = F.substr("seg", F.col("anchor") - F.col("near") + 1, F.col("near") + LENGTH - F.col("far"))
    asked = asked.filter((F.col("anchor") >= F.col("near")) & (F.octet_length("seg") - F.col("anchor") >= LENGTH - F.col("far")))
    asked = asked.select(F.when(F.col("ranges") == 1, F.col("h")).otherwise(F.xxhash64("h", "r", core)).alias("g"), "key", "n", "seg", "anchor", "near", "far")
    asked = asked.repartition(2 * parts, "g").sortWithinPartitions("g")  # a family takes many times the room of the segments in it

    def family(batches):
        levels, keys, need, last = Family(), [], [], None
        for whole in batches:
            group, lo = whole.column(0).to_numpy(), 0
            while lo < len(group):
                hi = min(lo + 1_000, len(group))
                if levels.filled > ROOM:
                    before = np.concatenate([[last], group[lo : hi - 1]])
                    border = np.flatnonzero(group[lo:hi] != before)
                    if len(border) and not border[0]:
                        yield told(levels, keys, need)
                        levels, keys, need = Family(), [], []
                    elif len(border):
                        hi = lo + int(border[0])
                b = whole.slice(lo, hi - lo)
                keys += b.column(1).to_pylist()
                need.append(b.column(2).to_numpy() == 1)
                levels.add(b.column(3).to_pylist(), group[lo:hi], *(b.column(i).to_numpy().astype(np.int64) for i in (4, 5, 6)))
                last, lo = group[hi - 1], hi
        if keys:
            yield told(levels, keys, need)

    def told(levels, keys, need):
        i = np.flatnonzero(np.concatenate(need) & (levels.high >= 0))
        return pa.RecordBatch.from_arrays([pa.array([keys[j] for j in i], pa.binary()), pa.array(levels.low[i].astype(np.int32)), pa.array((levels.high[i] + LENGTH).astype(np.int32))], ["key", "a", "b"])

    single = asked.mapInArrow(family, "key binary, a int, b int").groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.lit(1).cast("long").alias("n"))
    several = each.filter((F.col("n") > 1) & (F.octet_length("seg") >= LENGTH)).select("key", F.lit(0).alias("a"), F.octet_length("seg").alias("b"), "n")
    verdict = cut(single.unionByName(several), share=4)
    free(each, differ)
    told_rows = join_hot(around.select("doc_id", "th", "lo", "key"), verdict, "key", "n")
    return told_rows.select("doc_id", "th", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b")).alias("stop"))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, as flat starts and stops) and kept (binary) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated(docs).groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = spans.select("i", "t", F.transform(F.sort_array("spans"), lambda x: x.start).alias("starts"), F.transform(F.sort_array("spans"), lambda x: x.stop).alias("stops"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = packed(rows).join(spans, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").select("doc_id", "z", "starts", "stops")

    def apply(batches):
        large = zstandard.ZstdDecompressor()
        for b in batches:
            size, flat, kept = [], [], []
            for z, starts, stops in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw, runs = large.decompress(z), []
                for a, z in zip(starts or (), stops or (), strict=True):
                    if runs and a <= runs[-1]:
                        runs[-1] = max(runs[-1], z)
                    else:
                        runs += [a, z]
                edges = [0, *runs, len(raw)]
                size.append(len(raw))
                flat.append(runs)
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(apply, f"doc_id {kind}, n_bytes long, spans array<int>, kept binary")


def removals(docs: DataFrame) -> DataFrame:
    """op8."""
    return remove(docs).select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
