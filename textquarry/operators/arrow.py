"""Operators that need Python: tokenising, masking, packing, chunking and syntax checks (PRJ-11..13, PIPE-11, PIPE-15)."""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.lineage import checkpointed
from ..sources import files
from .learning import hash_embedding, language_of_path
from .texts import free_names, settled

#: Tokens of a text at most, where nothing else is said.
MAX_LENGTH = 4096


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """All white space tokens of a text, neither cut nor padded."""
    return df.withColumn("tokens", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\\s+"), lambda w: w != ""))


def tokenize(df: DataFrame, most: int, text: str = "text", pad: str = "<pad>") -> DataFrame:
    """PRJ-13 with white space tokens: cut to `most` and padded; an attention mask goes along. Built-ins only."""
    t = F.slice(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\\s+"), lambda w: w != ""), 1, most)
    return df.withColumn("_t", t).withColumns({"tokens": F.concat("_t", F.array_repeat(F.lit(pad), F.lit(most) - F.size("_t"))), "attention": F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: (i <= F.size("_t")).cast("int"))}).drop("_t")


def mask_labels(df: DataFrame, tokens: str = "tokens", marker: str = "assistant", pad: str = "<pad>", tool: str = "tool", share: float = 0.7) -> DataFrame:
    """PRJ-11 over token strings: tokens up to the last marker, tool markers and padding are masked (null); without a
    marker, the first 70 % of the tokens, or with share 0.5 the first half."""
    place = F.size(tokens) - F.array_position(F.reverse(tokens), marker)
    upto = F.when(F.array_contains(tokens, marker), place.cast("int")).otherwise(F.floor(F.size(tokens) * F.lit(share)).cast("int") - 1)
    # cut at `upto`, not asked in a lambda, which would work it out again for every token
    d = df.withColumn("_upto", upto)
    rest = F.slice(tokens, F.col("_upto") + 2, F.size(tokens) - F.col("_upto") - 1)
    masked = F.array_repeat(F.lit(None).cast("string"), F.col("_upto") + 1)
    return d.withColumn("labels", F.concat(masked, F.transform(rest, lambda x: F.when(~x.isin(pad, tool), x)))).drop("_upto")


class _Fills:
    """What a run of sequences makes of the pack that is open before it: for every fill (and for none, the first entry) the fill
    after it and how many packs it opens. Fills that have come to be alike are carried on as one."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.fill, self.packs = np.append(most + 1, np.arange(most + 1)), np.zeros(most + 2, np.int64)
        self.of, self.more = np.arange(most + 2), np.zeros(most + 2, np.int64)

    def add(self, sizes: list[int]) -> None:
        for i, n in enumerate(sizes):
            fits = self.fill + 1 + n <= self.most
            self.fill, self.packs = np.where(fits, self.fill + 1 + n, n), self.packs + ~fits
            if len(self.fill) > 1 and i % 8 == 0:
                self._merge()
            if len(self.fill) == 1:  # alike, whatever came before
                fill, packs = int(self.fill[0]), int(self.packs[0])
                for n in sizes[i + 1 :]:
                    if fill + 1 + n <= self.most:
                        fill += 1 + n
                    else:
                        fill, packs = n, packs + 1
                self.fill[0], self.packs[0] = fill, packs
                return

    def _merge(self) -> None:
        fill, first, to = np.unique(self.fill, return_index=True, return_inverse=True)
        self.more += (self.packs - self.packs[first][to])[self.of]
        self.of, self.fill, self.packs = to[self.of], fill, self.packs[first]

    def runs(self) -> list[tuple[int, int, int]]:
        """(first entry, fill, packs) of runs of entries that end alike."""
        fill, packs = self.fill[self.of], self.packs[self.of] + self.more
        at = np.flatnonzero(np.append(True, (fill[1:] != fill[:-1]) | (packs[1:] != packs[:-1])))
        return [(int(i), int(fill[i]), int(packs[i])) for i in at]


def pack(df: DataFrame, most: int, key: str = "doc_id", length: str = "n") -> DataFrame:
    """PRJ-12: (key, pack): sequences join in order of their keys (then lengths) while they fit (a separator counts 1); longer ones are
    cut to `most`, null counts as 0. A pack depends on all before it, yet the result is that of one pass over the whole table,
    however it is partitioned: each partition of consecutive keys first works out what it makes of any pack that may be open
    before it; these steps are composed from partition to partition (some numbers each, `most` + 2 at the very most); then every
    partition is packed by itself, from the fill and pack number that reach it."""
    size = F.least(F.coalesce(F.col(length), F.lit(0)), F.lit(most)).cast("int")
    # the last column deals rows that are alike
    d = df.select(F.col(key).alias("k"), size.alias("n")).withColumn("u", F.rand(7)).repartitionByRange("k", "n", "u").sortWithinPartitions("k", "n")
    d = checkpointed(d.drop("u")).withColumn("part", F.spark_partition_id())

    def steps(batches):
        fills, part = _Fills(most), None
        for b in batches:
            if len(b):
                part = b.column(2)[0].as_py()
                fills.add(b.column(1).to_pylist())
        if part is not None:
            runs = fills.runs()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(runs), pa.int32()), *[pa.array(c, pa.int64()) for c in zip(*runs, strict=True)]], ["part", "entry", "fill", "packs"])

    by: dict[int, list] = {}
    for r in d.mapInArrow(steps, "part int, entry long, fill long, packs long").collect():
        by.setdefault(r.part, []).append((r.entry, r.fill, r.packs))
    starts, entry, packs = {}, 0, 0
    for part in sorted(by):
        starts[part] = entry - 1, packs - 1
        runs = sorted(by[part])
        _, fill, opened = runs[bisect.bisect_right(runs, (entry, float("inf"), 0)) - 1]
        entry, packs = fill + 1, packs + opened
    sent = df.sparkSession.sparkContext.broadcast(starts)

    def run(batches):
        used, no = None, 0
        for b in batches:
            if not len(b):
                continue
            if used is None:
                used, no = sent.value[b.column(2)[0].as_py()]
                used = most + 1 if used < 0 else used
            out = []
            for n in b.column(1).to_pylist():
                if used + 1 + n <= most:
                    used += 1 + n
                else:
                    used, no = n, no + 1
                out.append(no)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], [key, "pack"])

    return d.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, pack long")


_BORDER = re.compile(r"^\s*(?:def|class|function|export|async|public|private|interface|fn|func)\b")


def chunks_of(text: str | None, size: int = 2000, least: int = 4, border_after: int = 5) -> Iterator[tuple[int, int, str]]:
    """PIPE-11: (first line, last line, content) of a text's chunks; one ends when it exceeds `size` characters, or before a definition
    once it has more than `border_after` lines; chunks under `least` lines are dropped."""
    held, first, chars = [], 1, 0
    for no, line in enumerate([*(text or "").split("\n"), None], 1):
        if held and (line is None or chars + len(line) > size or (_BORDER.match(line) and len(held) > border_after)):
            if len(held) >= least:
                yield first, no - 1, "\n".join(held)
            held, first, chars = [], no, 0
        if line is not None:
            held.append(line)
            chars += len(line) + 1


def chunk_code(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2000, least: int = 4, border_after: int = 5) -> DataFrame:
    """PIPE-11: (key, start_line, end_line, content) of the chunks of every text."""
    def run(batches):
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in chunks_of(t, size, least, border_after)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string()], strict=True)], [key, "start_line", "end_line", "content"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, start_line int, end_line int, content string")


#: Fixed value: the extensions of code that is indexed.
CODE = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".scala", ".vue", ".svelte", ".json", ".yaml", ".yml", ".md", ".txt", ".sh", ".bash", ".zsh")


class CodeChunks:
    """The table function behind index_code()."""

    def eval(self, content: str) -> Iterator[tuple[int, int, str]]:
        yield from chunks_of(content)


def index_code(spark: SparkSession, path: str, extensions: tuple[str, ...] = CODE) -> DataFrame:
    """PIPE-11: (path, language, start_line, end_line, content) of all chunks of the code below a folder: a walk, and a table function
    called for each file by a lateral join."""
    found = files.code_files(spark, path, extensions)
    chunk = F.udtf(CodeChunks, returnType="start_line int, end_line int, content string")
    return found.alias("f").lateralJoin(chunk(F.col("f.content").outer()).alias("c")).select("f.path", language_of_path(F.col("f.path")).alias("language"), "c.start_line", "c.end_line", "c.content")


def find_code(spark: SparkSession, path: str, query: str, k: int = 10, extensions: tuple[str, ...] = CODE) -> DataFrame:
    """PIPE-11 as one query: walk, chunk, embed, and the k chunks nearest to what is asked."""
    return search_code(index_code(spark, path, extensions), query, k)


def search_code(chunks: DataFrame, query: str, k: int = 10, size: int = 256) -> DataFrame:
    """PIPE-11: the k chunks whose hash embedding has the largest cosine with the query's; ties by key and line. A scan
    with a top-k, no join. A chunk is embedded once, and the query before the scan."""
    digest = hashlib.sha256(query.encode()).digest()
    wanted = F.array(*[F.lit(digest[i % 32] / 255) for i in range(size)])
    (own,) = free_names(chunks, "_v")
    d = settled(chunks, *chunks.columns, **{own: hash_embedding(F.col("content"), size)})
    return d.select(*chunks.columns, F.round(S.cosine(F.col(own), wanted), 6).alias("score")).orderBy(F.desc("score"), *[c for c in chunks.columns if c != "content"]).limit(k)


def syntax(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """PIPE-15: whether a text parses as Python, bare excepts and mutable defaults. Nothing is executed."""
    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    nodes = list(ast.walk(ast.parse(t or "")))
                    rows.append((i, True, sum(isinstance(x, ast.ExceptHandler) and x.type is None for x in nodes), sum(isinstance(d, (ast.List, ast.Dict, ast.Set)) for x in nodes if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) for d in x.args.defaults)))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((i, False, 0, 0))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [b.schema.field(0).type, pa.bool_(), pa.int32(), pa.int32()], strict=True)], [key, "parses", "bare_excepts", "mutable_defaults"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, parses boolean, bare_excepts int, mutable_defaults int")
