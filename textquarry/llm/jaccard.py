"""N-gram Jaccard join by chosen paths.

Texts are sets of shingles of five words (all words, if there are fewer); a link is a Jaccard similarity of the
threshold or more. Documents of equal sets are one class and enter the join once.

A set is embedded as TOKENS minhash values, of which the roots read the whole value and all else a byte. At each root
and node sets are split on sampled tokens: sets that share the value of a chosen position go to the same child. A node
chooses 1 / threshold positions on average, so that a linked pair meets in as many children as it would lose. Nodes of
at most SMALL sets are leaves; larger ones are split again, up to DEPTH times, and what is still large then is compared
in blocks of SMALL sets, so that no task holds a whole group. In a leaf all pairs are compared by their tokens; a pair
belongs to the first leaf, in a fixed order, that holds both its sets, and is counted there only. Pairs whose tokens
agree are then checked on their shingles, word by word. No pair is written out: a leaf gives the number of links of
each set and the components among its sets, which are joined to components over all leaves.

Repeated runs: the number of roots follows from the threshold, so that by theory a pair at the threshold is missed with
probability MISS (roots(): 16 at 0.8, 39 at 0.5). The recall is then estimated from the join itself: of the pairs
found, those that met under one root only and those that met under two tell how many met under none (Chao's estimator).
Below RECALL the join is done again with twice the roots. Besides, 3e-5 of the pairs at the threshold fail by tokens.

Classes and places are told apart by 128-bit digests of 64-bit SipHash digests of words, or of the words themselves in
texts of one shingle; similarities come from the words.

Null text, and text without words, has no shingles: it is a class of its own without links. Null doc_ids are kept;
repeated rows are copies of each other. An empty table gives no row. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import cut, free, join_hot, partitions, ready

WORDS, THRESHOLD, TOKENS, DEPTH, SMALL = 5, 0.8, 128, 3, 256
MISS, RECALL = 1e-6, 0.99
_MULT = hashing.mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_FLIP = _MULT[::-1].copy()


def most_children(threshold: float) -> int:
    """1 / threshold, rounded up: a node has so many children, or one fewer."""
    return math.ceil(1 / threshold - 1e-9)


def roots(threshold: float, miss: float = MISS) -> int:
    """How many roots it takes until a pair at the threshold, in nodes that are split to the full depth, is missed with
    at most this probability."""
    most = most_children(threshold)
    part = most - 1 / threshold  # the share of nodes with one child fewer
    meets = 1.0
    for _ in range(DEPTH - 1):
        lost = 1 - threshold * meets
        meets = 1 - part * lost ** (most - 1) - (1 - part) * lost**most
    return min(TOKENS, math.ceil(math.log(miss) / math.log(1 - threshold * meets)))


def slots(threshold: float, n_roots: int) -> int:
    return n_roots * most_children(threshold) ** (DEPTH - 1)


def shingle_set(text: str | None) -> np.ndarray:
    return _shingle_set((text or "").encode("utf-8", "replace"))


def _shingle_set(raw: bytes) -> np.ndarray:
    return hashing.distinct(hashing.shingles(hashing.sip_words(raw), WORDS))


def tokens(shingles: np.ndarray, n_roots: int) -> tuple[np.ndarray, np.ndarray]:
    """A byte of the minhash at each of TOKENS positions, and keys of the whole values that the roots split on."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 256):  # so many rows of TOKENS stay in the cache of a core
        part = shingles[lo : lo + 256, None] ^ _FLIP
        part *= _MULT
        np.minimum(low, part.min(0), out=low)
    at = np.arange(n_roots)
    keys = hashing.mix(low[at * 8 % TOKENS + at * 8 // TOKENS] + hashing.mix(at.astype(np.uint64) + np.uint64(1)))
    return (hashing.mix(low) & np.uint64(0xFF)).astype(np.uint8), keys.view(np.int64)


def least_tokens(threshold: float) -> int:
    """Of TOKENS, so many agree in a pair at the threshold but for one case in 30,000 (four standard deviations)."""
    return int(TOKENS * (threshold - 4 * (threshold * (1 - threshold) / TOKENS) ** 0.5))


def sets(docs: DataFrame, n_roots: int) -> DataFrame:
    """doc_id, th (hash of the text), set (digest of the shingles, null without any), tok (binary) and roots (keys of the
    first split) of every row."""

    def run(batches):
        for b in batches:
            keys, toks, first = [], [], []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode("utf-8", "replace")
                s = _shingle_set(raw)
                if not len(s):
                    key = tok = root = None
                else:
                    key = hashlib.blake2b(s.tobytes() if len(s) > 1 else b" ".join(raw.split()[:WORDS]), digest_size=16, person=b"many" if len(s) > 1 else b"one").digest()
                    tok, root = tokens(s, n_roots)
                    tok = tok.tobytes()
                keys.append(key)
                toks.append(tok)
                first.append(root)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(toks, pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "th", "set", "tok", "roots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, set binary, tok binary, roots array<bigint>")


def _byte(i):
    """The token at position i (a column) as a number."""
    return F.conv(F.hex(F.substr(F.col("tok"), (i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def leaves(classes: DataFrame, threshold: float) -> list[DataFrame]:
    """Written tables of set, leaf (its key), slot (place in the fixed order) and size for leaves of two sets or more.

    Keys are 64-bit hashes of the path: root, then position and value at each split."""
    most = most_children(threshold)
    fewer = F.pmod(F.xxhash64("leaf", F.lit(7)), F.lit(1 << 20)) < int((most - 1 / threshold) * (1 << 20))
    node = classes.select("set", F.posexplode("roots").alias("r", "leaf")).select("set", (F.col("r") * most ** (DEPTH - 1)).alias("slot"), "leaf")
    done = []
    for depth in range(1, DEPTH + 1):
        all_nodes = cut(node, share=4) if depth > 1 else node  # the roots are read from the written classes
        size = cut(all_nodes.groupBy("leaf").agg(F.count("*").alias("size")).filter("size > 1"), share=8)
        node = cut(join_hot(all_nodes, size, "leaf", "size"), share=4)
        free(all_nodes, size)
        done.append(node if depth == DEPTH else node.filter(F.col("size") <= SMALL))
        if depth == DEPTH:
            break
        large = node.filter(F.col("size") > SMALL)
        if large.isEmpty():
            break
        step = most ** (DEPTH - 1 - depth)
        large = large.join(classes.select("set", "tok"), "set")
        child = lambda j: F.struct((F.col("slot") + j * step).alias("slot"), F.xxhash64("leaf", F.lit(j), _byte(F.pmod(F.xxhash64("leaf", F.lit(100 + j)), F.lit(TOKENS)))).alias("leaf"))
        every = [child(j) for j in range(most - 1)] + [F.when(~fewer, child(most - 1))]
        node = large.select("set", F.explode(F.array_compact(F.array(*every))).alias("x")).select("set", "x.slot", "x.leaf")
    return done


def dealt(leaf: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows for the comparisons: group (a pair of blocks of a leaf), slot, side (0, 1, or 2 in a block with itself),
    set, n, tok, and at and leaves (slot and key of all leaves of the set)."""
    mine = leaf.groupBy("set").agg(F.collect_list(F.struct("leaf", "slot", "size")).alias("own"))
    mine = mine.join(classes.select("set", "n", "tok"), "set")
    rows = mine.select("set", "n", "tok", F.transform("own", lambda x: x.slot.cast("int")).alias("at"), F.col("own.leaf").alias("leaves"), F.explode("own").alias("x"))
    blocks = F.ceil(F.col("x.size") / SMALL).cast("int")
    block = F.pmod(F.xxhash64("set"), blocks).cast("int")
    rows = rows.select("set", "n", "tok", "at", "leaves", F.col("x.leaf").alias("leaf"), F.col("x.slot").cast("int").alias("slot"), block.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    side = F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    return rows.select(F.xxhash64("leaf", F.least("b", "o"), F.greatest("b", "o")).alias("g"), "slot", side.alias("side"), "set", "n", "tok", "at", "leaves")


def _whole_groups(batches, rows: int, most: int = 64 << 20):
    """Tables that hold whole groups (column g, sorted), of at most so many rows, or so many bytes, if those are fewer rows;
    a larger group stands alone. A batch may hold many tables."""
    held = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) < rows and sum(t.nbytes for t in held) < most:
            continue
        t = pa.concat_tables(held).combine_chunks()
        g = t.column("g").to_numpy()
        borders = np.flatnonzero(g[1:] != g[:-1]) + 1
        step, lo = min(rows, max(1, t.num_rows * most // max(t.nbytes, 1))), 0
        while (left := borders[np.searchsorted(borders, lo, "right") :]).size:
            hi = int(left[max(0, np.searchsorted(left, lo + step, "right") - 1)])
            yield t.slice(lo, hi - lo)
            lo = hi
        held = [t.slice(lo)]
    if held and sum(t.num_rows for t in held):
        yield pa.concat_tables(held).combine_chunks()


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def _agree(tok: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes agree in the rows a and b of tok, a matrix of 64-bit words (at most 255 words a row)."""
    x = tok[a] ^ tok[b]
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    same = ~(((x & low) + low) | x | low) >> np.uint64(7)  # 1 in each byte that is zero in x
    return ((same.sum(1) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def candidates(t: pa.Table, least: int, n_roots: int, n_slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose tokens agree and whose first common leaf this is, and under how many roots they
    meet."""
    n = t.num_rows
    g, side, slot = t.column("g").to_numpy(), t.column("side").to_numpy(), t.column("slot").to_numpy()
    tok = _matrix(t.column("tok")).view(np.uint64)
    some = np.ascontiguousarray(tok[:, :4])
    at, leaf = t.column("at").combine_chunks(), t.column("leaves").combine_chunks()
    count = pc.list_value_length(at).to_numpy()
    row = np.repeat(np.arange(n), count)
    # every row's own number stands for no leaf: it never agrees
    where = np.empty((n_slots, n), np.int64)
    where[:] = np.arange(n)
    where[at.flatten().to_numpy(), row] = leaf.flatten().to_numpy()
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(start, n))
    # each row with the rows after it in its group
    later = np.repeat(start + size, size) - np.arange(n) - 1
    ends = np.cumsum(later)
    left, right, met, lo = [], [], [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 6_000_000 // n_slots, "right")))
        c = later[lo:hi]
        a = np.repeat(np.arange(lo, hi), c)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        ok = (side[a] == 2) | (side[a] != side[b])
        a, b = a[ok], b[ok]
        if len(a):
            ok = _agree(some, a, b) >= max(0, least - 96)
            a, b = a[ok], b[ok]
        # in a group of near copies most pairs have met before: those go first, slot by slot
        own = slot[a]
        for k in range(int(own.max(initial=0))):
            before = (where[k][a] == where[k][b]) & (own > k)
            if before.any():
                a, b, own = a[~before], b[~before], own[~before]
        if len(a):
            ok = (where[own, a] == where[own, b]) & (_agree(tok, a, b) >= least)
            a, b = a[ok], b[ok]
            both = where[:, a] == where[:, b]
            left.append(a)
            right.append(b)
            met.append(both.reshape(n_roots, n_slots // n_roots, -1).any(1).sum(0))
        lo = hi
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (left, right, met))


def estimated_recall(pairs: int, once: int, twice: int) -> float:
    """The share of pairs that met under a root, of all, from how many met under one and under two (Chao, 1987)."""
    return pairs / (pairs + once * (once - 1) / (2 * (twice + 1))) if pairs else 1.0


def overlaps(own: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets, which hold small numbers."""
    left, at_a = np.unique(a, return_inverse=True)
    right, at_b = np.unique(b, return_inverse=True)
    if len(a) <= 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    # many pairs among few sets: products of 0/1 matrices, over the shingles that both sides have
    x, y = (np.concatenate([own[i] for i in rows]) for rows in (left, right))
    there = np.zeros((2, 1 + max(x.max(initial=0), y.max(initial=0))), bool)
    there[0, x] = there[1, y] = True
    col = np.where(there.all(0), np.cumsum(there.all(0)) - 1, -1)
    x, y = ((np.repeat(np.arange(len(rows)), [len(own[i]) for i in rows]), col[z]) for rows, z in ((left, x), (right, y)))
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(col.max(initial=-1)) + 1, 4096):
        wide, m = min(4096, int(col.max()) + 1 - lo), []
        for rows, (row, c) in ((left, x), (right, y)):
            here = (c >= lo) & (c < lo + wide)
            m.append(np.zeros((len(rows), wide), np.float32))
            m[-1][row[here], c[here] - lo] = 1
        both += m[0] @ m[1].T
    return both[at_a, at_b].astype(np.int64)


def overlaps_by_group(own: dict[int, np.ndarray], g: np.ndarray, side: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """overlaps() of pairs in ascending order of a, group by group, so that the matrices hold two blocks at most."""
    swap = side[a] == 1
    left, right = np.where(swap, b, a), np.where(swap, a, b)
    ends = np.flatnonzero(np.append(g[a[1:]] != g[a[:-1]], True)) + 1
    return np.concatenate([overlaps(own, left[lo:hi], right[lo:hi]) for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True)])


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _asked(classes: DataFrame, threshold: float, n_roots: int) -> tuple[DataFrame, float]:
    """The written rows of dealt() that have a partner whose tokens agree, and the estimated recall of their pairs."""
    least, n_slots = least_tokens(threshold), slots(threshold, n_roots)
    parts = leaves(classes, threshold)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    deal = dealt(every, classes).repartition(partitions(classes.sparkSession), "g").sortWithinPartitions("g", "set")

    def ask(batches):
        for t in _whole_groups(batches, min(20_000, 1_200_000 // n_slots)):
            a, b, met = candidates(t, least, n_roots, n_slots)
            took = t.take(np.unique(np.concatenate([a, b])))
            for name, number in (("pairs", len(a)), ("once", (met == 1).sum()), ("twice", (met == 2).sum())):
                took = took.append_column(name, pa.array(np.concatenate([[number], np.zeros(max(took.num_rows - 1, 0))])[: took.num_rows].astype(np.int64)))
            yield from took.to_batches(max_chunksize=5_000)

    out = cut(deal.mapInArrow(ask, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in deal.schema.fields) + ", pairs long, once long, twice long"))
    free(*parts)
    seen = out.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("pairs", "once", "twice")]).first()
    return out, estimated_recall(*seen)


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: every row's set (doc_id, th, set, tok, roots); classes (set, rep, n, tok, roots); and, for classes
    with a link: set, links (classes), weight (documents), root (a set of the same component; one row for each leaf)."""
    spark = ready(docs.sparkSession)
    least, n_roots = least_tokens(threshold), roots(threshold)
    place = F.struct("doc_id", "th")
    while True:
        all_sets = cut(sets(docs, n_roots))
        classes = cut(all_sets.filter("set IS NOT NULL").groupBy("set").agg(F.min(place).alias("rep"), F.count("*").alias("n"), F.first("tok").alias("tok"), F.first("roots").alias("roots")))
        asked, reached = _asked(classes, threshold, n_roots)
        if reached >= recall:
            break
        if n_roots >= TOKENS:
            raise ValueError(f"estimated recall {reached:.3f} of {recall} with all {TOKENS} roots: the threshold is too low for so few tokens")
        free(all_sets, classes, asked)
        n_roots = min(TOKENS, 2 * n_roots)
    n_slots = slots(threshold, n_roots)
    wanted = asked.select("set").distinct().join(classes.select("set", "rep"), "set").select("set", F.col("rep.doc_id").alias("i"), F.col("rep.th").alias("h"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("set", "text").dropDuplicates(["set"])
    check = asked.drop("pairs", "once", "twice").join(texts, "set").repartition(partitions(spark), "g").sortWithinPartitions("g", "set")

    def verify(batches):
        for t in _whole_groups(batches, 1_000):
            a, b, _ = candidates(t, least, n_roots, n_slots)
            if not len(a):
                continue
            text, key, n = t.column("text"), t.column("set").to_pylist(), t.column("n").to_numpy()
            used = np.unique(np.concatenate([a, b])).tolist()
            own = dict(zip(used, hashing.exact_shingles([text[i].as_py().encode("utf-8", "replace") for i in used], WORDS), strict=True))
            size = np.zeros(t.num_rows, np.int64)
            size[used] = [len(own[i]) for i in used]
            both = overlaps_by_group(own, t.column("g").to_numpy(), t.column("side").to_numpy(), a, b)
            ok = both >= threshold * (size[a] + size[b] - both)
            a, b = a[ok], b[ok]
            count = np.bincount(np.concatenate([a, b]), minlength=t.num_rows)
            weight = np.bincount(np.concatenate([a, b]), weights=np.concatenate([n[b], n[a]]), minlength=t.num_rows)
            root = _components(t.num_rows, a, b)
            i = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([key[j] for j in i], pa.binary()), pa.array(count[i].astype(np.int64)), pa.array(weight[i].astype(np.int64)), pa.array([key[j] for j in root[i]], pa.binary())], ["set", "links", "weight", "root"])

    found = cut(check.mapInArrow(verify, "set binary, links long, weight long, root binary"))
    free(asked)
    return all_sets, classes, found


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for edges (a, b), as a written table. Each round takes the
    smallest label among the neighbours and then that label's own label, so that rounds grow with the logarithm of a
    component's size; nodes with very many neighbours, and labels that very many nodes have, are dealt to many tasks."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), share=8)
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count("*").alias("degree")), share=8)
    while True:
        near = join_hot(both, label.select(F.col("node").alias("b"), "root", "degree"), "b", "degree").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = cut(label.select("node", "root", "degree").join(near, "node").select("node", F.least("root", "near").alias("root"), "degree", F.col("root").alias("old")), share=8)
        tops = cut(new.groupBy("root").agg(F.count("*").alias("n")).join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root"), share=16)
        up = cut(join_hot(new, tops, "root", "n", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "degree", "old"), share=8)
        free(label, new, tops)
        label = up
        if label.filter("root <> old").isEmpty():
            free(both)
            return label


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, th, root (a set that names the component, null for rows without links or copies),
    first (doc_id and th of the component's first row), class_id (the smallest doc_id that links lead to), copy_id (the smallest doc_id with the same shingles), n_links
    (other documents at the threshold or above, copies among them) and n_class_links (other sets of shingles)."""
    all_sets, classes, found = links(docs, threshold, recall)
    label = components(found.filter("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("set").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    own = classes.select("set", "rep", "n").join(linked, "set", "left").filter("n > 1 OR links IS NOT NULL").join(label.select("node", F.col("root").alias("top")), F.col("set") == F.col("node"), "left")
    own = cut(own.select("set", "n", "links", "weight", "rep", F.coalesce("top", "set").alias("root")), share=4)
    free(found, label, classes)
    # a component of one class has its own first row; of the others, one may hold a large part of all classes
    several = cut(own.groupBy("root").agg(F.min("rep").alias("first"), F.min("rep.doc_id").alias("lowest"), F.count("*").alias("classes")).filter("classes > 1"), share=16)
    known = join_hot(own, several, "root", "classes", "left")
    known = cut(known.select("set", "n", "links", "weight", "root", F.col("rep.doc_id").alias("copy"), F.coalesce("lowest", "rep.doc_id").alias("lowest"), F.coalesce("first", "rep").alias("first")), share=4)
    free(own, several)
    rows = all_sets.select("doc_id", "th", "set")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shape = [
        "doc_id", "th", "root", "first",
        F.coalesce("lowest", "doc_id").alias("class_id"),
        F.coalesce("copy", "doc_id").alias("copy_id"),
        (F.coalesce(F.col("n"), F.lit(1)) - 1 + zero("weight")).cast("long").alias("n_links"),
        zero("links").cast("long").alias("n_class_links"),
    ]
    # rows without a set, who knows how many, stay out of the join
    nothing = rows.filter("set IS NULL").select("doc_id", "th", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("n", "links", "weight", "copy", "root", "lowest", "first")])
    return join_hot(rows.filter("set IS NOT NULL"), known, "set", "n", "left").select(*shape).unionByName(nothing.select(*shape))


def linked_documents(docs: DataFrame) -> DataFrame:
    """op2."""
    return join(docs).drop("th", "root", "first")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each component: the smallest doc_id, and of its rows the smallest text hash. Components are
    told apart by root, as those of different texts may share their smallest doc_id, or have only null ones."""
    found = cut(join(docs.select("doc_id", "text"), threshold))
    gone = found.filter((F.col("n_links") > 0) & (F.struct("doc_id", "th") != F.col("first")))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_gone_th")), "left_anti")
    again = found.groupBy("doc_id", "th").count().filter("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
