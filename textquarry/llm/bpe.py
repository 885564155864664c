"""BPE encoding and decoding: the unique last token of every prefix, found with a suffix automaton.

Over one pre-token the encoder walks a suffix automaton of the vocabulary. At each byte the automaton
gives, longest first, the tokens that end there. Exactly one of them can stand last in the encoding of
that prefix: the one whose left neighbour (the stored last token of the prefix before it) is a pair that
the merges would not have joined otherwise. Back-pointers then give the ids. This takes linear time for
any text, while applying merges in rank order takes longer on long pre-tokens.

Null text encodes as the empty text. Repeated rows encode alike; extra columns stay as they are. Very long texts are encoded whole. An
empty table gives no row.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from . import hashing
from .common import fresh, ready

#: Pre-token pattern of byte-level BPE vocabularies (fixed value, as the public tokenizer files state it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the suffix automaton of a byte-level BPE file, as arrays that travel to executors."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: as_bytes(t) for t, i in model["vocab"].items() if t not in self.special}
        self.decoded = self.tokens | {i: t.encode() for t, i in self.special.items()}
        self.halves: dict[int, tuple[int, int, int]] = {}
        vocab = model["vocab"]
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            self.halves[vocab[a + b]] = (vocab[a], vocab[b], rank)
        self.classes = classes()
        self._automaton()

    def _automaton(self) -> None:
        step: dict[int, int] = {}
        link, length, out = [-1], [0], [dict()]
        token = [-1]

        def clone(p: int, q: int, b: int) -> int:
            new = len(link)
            link.append(link[q])
            length.append(length[p] + 1)
            out.append(dict(out[q]))
            token.append(-1)
            link[q] = new
            while p >= 0 and out[p].get(b) == q:
                out[p][b] = new
                p = link[p]
            return new

        for i, t in self.tokens.items():
            last = 0
            for b in t:
                q = out[last].get(b)
                if q is not None:  # another token has led here before
                    last = q if length[q] == length[last] + 1 else clone(last, q, b)
                    continue
                new = len(link)
                link.append(0)
                length.append(length[last] + 1)
                out.append({})
                token.append(-1)
                p = last
                while p >= 0 and b not in out[p]:
                    out[p][b] = new
                    p = link[p]
                if p >= 0:
                    q = out[p][b]
                    link[new] = q if length[q] == length[p] + 1 else clone(p, q, b)
                last = new
            token[last] = i
        for s, row in enumerate(out):
            for b, q in row.items():
                step[s << 8 | b] = q
        up = [-1] * len(link)
        for s in sorted(range(1, len(link)), key=length.__getitem__):
            up[s] = link[s] if token[link[s]] >= 0 else up[link[s]]
        self.arrays = [np.array(x, np.int64) for x in (list(step), list(step.values()), link, length, token, up)]

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("special", "decoded", "halves", "arrays", "classes")}


#: Code points with the White_Space property (fixed value).
BLANKS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANK, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library tells them apart. Its Unicode tables are
    asked only about code points that Python's tables do not know yet."""
    table = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            table[c] = LETTER
        elif k[0] == "N":
            table[c] = NUMBER
        elif k == "Cn":
            unknown.append(c)
    unknown = [c for c in unknown if regex.match(r"[\p{L}\p{N}]", chr(c))]
    begins = {at[0] for _, at in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"a{chr(c)}1" for c in unknown))}
    for i, c in enumerate(unknown):
        table[c] = LETTER if 3 * i + 1 not in begins else NUMBER if 3 * i + 2 not in begins else OTHER
    table[BLANKS] = BLANK
    return table


def pretokens(cp: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie one after another as code points; text i begins at off[i].

    The same borders as PATTERN gives: runs of one class take one space before them, a blank run before
    something else leaves its last blank out, and an apostrophe takes the letters of a contraction."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = table[cp]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = edge.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    begins[0] = begins[n] = True
    run = np.flatnonzero(begins)
    start, end = run[:-1], run[1:]
    blank = (kind[start] == BLANK) & ~edge[end]
    at = end[blank] - 1
    begins[at] = True
    begins[at[cp[at] == 0x20] + 1] = False
    # contractions: a lone apostrophe that starts a pre-token, then a run of letters
    i = np.flatnonzero((cp[start] == 39) & (end - start == 1) & begins[start] & ~edge[end])
    i = i[kind[start[i + 1]] == LETTER] if len(i) else i
    if len(i):
        a, stop = end[i], end[i + 1]
        one = cp[a]
        two = np.where(a + 1 < stop, cp[np.minimum(a + 1, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[a[short | long]] = False
        begins[a[short] + 1] = True
        begins[a[long] + 2] = True
    return np.flatnonzero(begins[:n])


def _alike(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of code points that stand for all of their kind, and which of them each range equals. Ranges are put
    together by hash, then compared; one that differs from its stand-in stands for itself."""
    _, first, back = np.unique(hashing.spans_mod(hashing.prefix_mod(cp), start, end), return_index=True, return_inverse=True)
    size, model = end - start, first[back]
    other = np.flatnonzero(model != np.arange(len(start)))
    wrong = size[other] != size[model[other]]
    same = other[~wrong]
    n = size[same]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differ = cp[np.repeat(start[same], n) + step] != cp[np.repeat(start[model[same]], n) + step]
    bad = np.concatenate([other[wrong], np.repeat(same, n)[differ]])
    if len(bad):
        bad = np.unique(bad)
        back[bad] = len(first) + np.arange(len(bad))
        first = np.concatenate([first, bad])
    return first, back


class Encoder:
    """Encodes batches of texts. Pre-tokens that were seen are kept, at most `most`, by their text; then all are forgotten.

    Up to LONG bytes, the prefixes of many pre-tokens are worked on together, byte by byte; longer
    pre-tokens go one at a time. Both do the same steps."""

    LONG, SLOTS = 40, 1 << 20

    def __init__(self, vocabulary: Vocabulary, most: int = 150_000):
        keys, to, self.link, self.length, self.token, self.up = vocabulary.arrays
        self.halves, self.special, self.most, self.classes = vocabulary.halves, vocabulary.special, most, vocabulary.classes
        # transitions: states with one way on, and a row of 256 for the others
        state, byte = keys >> 8, keys & 255
        ways = np.bincount(state, minlength=len(self.link))
        self.only = np.full(len(self.link), 256, np.int64)
        self.to = np.full(len(self.link), -1, np.int64)
        single = ways[state] == 1
        self.only[state[single]], self.to[state[single]] = byte[single], to[single]
        self.row = np.full(len(self.link), -1, np.int64)
        many = np.flatnonzero(ways > 1)
        self.row[many] = np.arange(len(many))
        self.wide = np.full((len(many), 256), -1, np.int32)
        self.wide[self.row[state[~single]], byte[~single]] = to[~single]
        # pairs: merges by key, and for each token the pieces at either end with the rank that absorbs them
        joins = sorted((a << 20 | b, rank) for a, b, rank in self.halves.values())
        self.join_key, self.join_rank = (np.array(x, np.int64) for x in zip(*joins, strict=True))
        self.edges = [self._edges(side) for side in (0, 1)]
        self.joins, self.spines = {a << 20 | b: rank for a, b, rank in self.halves.values()}, ({}, {})
        self.pair_key = np.full(self.SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(self.SLOTS, bool)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._forget()

    def _edges(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token, from large to small, the pieces that touch its end, and what absorbs each (NEVER: nothing)."""
        rows: dict[int, list] = {}
        for token in range(int(self.token.max()) + 1):
            got, absorbed, t = [], NEVER, token
            while True:
                got.append((t, absorbed))
                if t not in self.halves:
                    break
                absorbed, t = self.halves[t][2], self.halves[t][side]
            rows[token] = got
        deep = max(map(len, rows.values()))
        piece, gone = np.full((len(rows), deep), -1, np.int64), np.full((len(rows), deep), -1, np.int64)
        for t, got in rows.items():
            piece[t, : len(got)], gone[t, : len(got)] = zip(*got, strict=True)
        return piece, gone

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.store, self.store_off = np.zeros(1 << 16, np.int32), np.zeros(self.most + 2, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay apart: no merge across their border comes before the merges inside them.
        At equal ranks the merge further left comes first."""
        key = a << 20 | b
        slot = (key * 0x9E3779B1 >> 15) % self.SLOTS
        new = self.pair_key[slot] != key
        if not new.any():
            return self.pair_ok[slot]
        ask, back = np.unique(key[new], return_inverse=True)
        x, gone_x = (e[ask >> 20] for e in self.edges[1])
        y, gone_y = (e[ask & 0xFFFFF] for e in self.edges[0])
        # every piece at the end of a with every piece at the start of b, all pairs one after another
        wide = (y >= 0).sum(1)
        many = (x >= 0).sum(1) * wide
        pair = np.repeat(np.arange(len(ask)), many)
        i, j = np.divmod(np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many), wide[pair])
        k = x[pair, i] << 20 | y[pair, j]
        at = np.minimum(np.searchsorted(self.join_key, k), len(self.join_key) - 1)
        hit = np.flatnonzero(self.join_key[at] == k)
        pair, i, j, m = pair[hit], i[hit], j[hit], self.join_rank[at[hit]]
        ok = np.ones(len(ask), bool)
        ok[pair[(m < gone_x[pair, i]) & (m <= gone_y[pair, j])]] = False
        out = self.pair_ok[slot]
        out[new] = ok[back]
        put = (ask * 0x9E3779B1 >> 15) % self.SLOTS
        self.pair_key[put], self.pair_ok[put] = ask, ok
        # two keys of one slot: what stands there must belong together
        wrong = self.pair_key[put] != ask
        self.pair_key[put[wrong]] = -1
        return out

    def _next(self, s: np.ndarray, b: np.ndarray) -> np.ndarray:
        q = np.where(self.only[s] == b, self.to[s], -1)
        w = np.flatnonzero(self.row[s] >= 0)
        q[w] = self.wide[self.row[s[w]], b[w]]
        return q

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and how many each has."""
        sizes = np.array([len(w) for w in raw], np.int64)
        order = np.argsort(-sizes, kind="stable")
        m, most = len(raw), int(sizes.max(initial=0))
        text = np.zeros((m, most), np.uint8)
        size = sizes[order]
        text[np.arange(most) < size[:, None]] = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        last, width = np.full((m, most + 1), -1, np.int32), np.zeros((m, most + 1), np.int8)
        s, n = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for i in range(1, most + 1):
            m = int(np.searchsorted(-size, -i, "right"))
            s, n, b = s[:m], n[:m], text[:m, i - 1].astype(np.int64)
            q = self._next(s, b)
            lost = np.flatnonzero(q < 0)
            while len(lost):
                s[lost] = self.link[s[lost]]
                n[lost] = self.length[s[lost]]
                q[lost] = self._next(s[lost], b[lost])
                lost = lost[q[lost] < 0]
            s, n = q, n + 1
            c = np.where((self.token[s] >= 0) & (self.length[s] == n), s, self.up[s])
            left = np.arange(m)
            while len(left):
                t, k = self.token[c[left]], self.length[c[left]]
                before = last[left, i - k].astype(np.int64)
                ok = k == i
                inner = np.flatnonzero(~ok)
                ok[inner] = self.compatible(before[inner], t[inner])
                done = left[ok]
                last[done, i], width[done, i] = t[ok], k[ok]
                left = left[~ok]
                c[left] = self.up[c[left]]
        m = len(raw)
        ids, at, count = np.full((m, most), -1, np.int32), size.copy(), np.zeros(m, np.int64)
        for col in range(most - 1, -1, -1):
            r = np.flatnonzero(at > 0)
            if not len(r):
                break
            ids[r, col] = last[r, at[r]]
            count[r] += 1
            at[r] -= width[r, at[r]]
        back = np.argsort(order, kind="stable")
        ids, count = ids[back], count[back]
        return ids[ids >= 0], count

    def _apart(self, a: int, b: int) -> bool:
        """compatible() for one pair."""
        for x, gone in self._spine(1, a):
            for y, absorbed in self._spine(0, b):
                rank = self.joins.get(x << 20 | y)
                if rank is not None and rank < gone and rank <= absorbed:
                    return False
        return True

    def _spine(self, side: int, token: int) -> list[tuple[int, int]]:
        got = self.spines[side].get(token)
        if got is None:
            piece, gone = (e[token].tolist() for e in self.edges[side])
            got = self.spines[side][token] = [(p, g) for p, g in zip(piece, gone, strict=True) if p >= 0]
        return got

    def _ends(self, s: int, n: int) -> list[tuple[int, int]]:
        """Tokens (id, length) that end where state s was reached with n bytes matched, longest first."""
        c, out = s if self.token[s] >= 0 and self.length[s] == n else int(self.up[s]), []
        while c >= 0:
            out.append((int(self.token[c]), int(self.length[c])))
            c = int(self.up[c])
        return out

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token of any length, byte by byte; steps, ends of tokens and pairs are kept for its length."""
        last, width, s, n = [-1] * (len(raw) + 1), [0] * (len(raw) + 1), 0, 0
        steps: dict[int, tuple[int, int, bool]] = {}  # state and byte: next state, its match if it was shortened, whether it was
        ends: dict[tuple[int, int], list] = {}
        apart: dict[int, bool] = {}
        go = lambda s, b: int(self.wide[self.row[s], b]) if self.row[s] >= 0 else int(self.to[s]) if self.only[s] == b else -1
        for i, b in enumerate(raw, 1):
            step = steps.get(s << 8 | b)
            if step is None:
                at, m, cut = s, 0, False
                while (q := go(at, b)) < 0:
                    at = int(self.link[at])
                    m, cut = int(self.length[at]), True
                step = steps[s << 8 | b] = (q, m, cut)
            s, n = step[0], (step[1] if step[2] else n) + 1
            found = ends.get((s, n))
            if found is None:
                found = ends[s, n] = self._ends(s, n)
            for t, k in found:
                if k == i:
                    break
                pair = last[i - k] << 20 | t
                ok = apart.get(pair)
                if ok is None:
                    ok = apart[pair] = self._apart(last[i - k], t)
                if ok:
                    break
            last[i], width[i] = t, k
        ids, i = [], len(raw)
        while i:
            ids.append(last[i])
            i -= width[i]
        return ids[::-1]

    def _learn(self, keys: list[str], raw: list[bytes]) -> None:
        if not raw:
            return
        short = [w for w in raw if len(w) <= self.LONG]
        ids, count = self.words(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(short) < len(raw):
            parts, k = [], 0
            ends = np.concatenate([[0], np.cumsum(count)])
            for w in raw:
                if len(w) <= self.LONG:
                    parts.append(ids[ends[k] : ends[k + 1]])
                    k += 1
                else:
                    parts.append(np.array(self.word(w), np.int32))
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        have, k = int(self.store_off[len(self.known)]), len(self.known)
        while have + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[have : have + len(ids)] = ids
        self.store_off[k + 1 : k + 1 + len(raw)] = have + np.cumsum(count)
        self.known.update(zip(keys, range(k, k + len(raw)), strict=True))

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that hold no special token, one after another, and how many each text has."""
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start = pretokens(cp, off, self.classes)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        end = np.append(start[1:], len(cp))
        first, back = _alike(cp, start, end)
        if len(self.known) + len(first) > self.most:
            self._forget()
            if len(first) > self.most:
                self.store_off = np.zeros(len(first) + 2, np.int64)
        names = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        new = [k for k in dict.fromkeys(names) if k not in self.known]
        for i in range(0, len(new), 8_000):
            part = new[i : i + 8_000]
            self._learn(part, [k.encode("utf-8", "replace") for k in part])
        slot = np.array([self.known[k] for k in names], np.int64)[back]
        at, size = self.store_off[slot], self.store_off[slot + 1] - self.store_off[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.store[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, off)])

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has. Special tokens' strings become their ids."""
        if self.cut is None or not any(s in t for t in texts for s in self.special):
            return self.plain(texts)
        parts = [[p for p in self.cut.split(t) if p] if any(s in t for s in self.special) else [t] for t in texts]
        flat = [p for x in parts for p in x]
        ids, count = self.plain(["" if p in self.special else p for p in flat])
        extra = np.array([self.special.get(p, -1) for p in flat], np.int64)
        ends = np.cumsum(count)
        ids = np.insert(ids, ends[extra >= 0], extra[extra >= 0])
        count = count + (extra >= 0)
        total = np.concatenate([[0], np.cumsum(count)])
        return ids.astype(np.int32), np.diff(total[np.concatenate([[0], np.cumsum([len(x) for x in parts])])])


_vocabularies: dict[str, tuple] = {}


def _shipped(spark, path: str):
    """The vocabulary as a broadcast; its size is that of the file, whatever the corpus."""
    key = (path, spark.sparkContext.applicationId)
    if key not in _vocabularies:
        _vocabularies[key] = spark.sparkContext.broadcast(Vocabulary(path))
    return _vocabularies[key]


def _append(batch: pa.RecordBatch, name: str, col: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, col], [*batch.schema.names, name])


def _slices(batch: pa.RecordBatch, name: str, most: int):
    """Parts of a batch whose texts (or lists) hold at most so many bytes (or values), so that memory stays bounded."""
    col = batch.column(batch.schema.get_field_index(name))
    total, start = 0, 0
    size = pc.binary_length(col) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else pc.list_value_length(col)
    for i, n in enumerate(size.to_pylist()):
        total += n or 0
        if total >= most:
            yield batch.slice(start, i + 1 - start)
            total, start = 0, i + 1
    if start < batch.num_rows:
        yield batch.slice(start)


class Decoder:
    """Turns ids back into text. The bytes of all tokens lie in one Arrow array, from which a batch's ids are taken."""

    def __init__(self, vocabulary: Vocabulary):
        table = vocabulary.decoded
        self.tokens = pa.array([table.get(i) for i in range(max(table) + 1)], pa.large_binary())

    def batch(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids that lie one after another; text i has ids[ends[i]:ends[i + 1]]. Unknown ids are an error."""
        got = self.tokens.take(pa.array(ids))
        if got.null_count:
            raise ValueError("an id that the vocabulary does not have")
        _, offs, data = got.buffers()
        at = np.frombuffer(offs, np.int64)[ends]
        raw = memoryview(data) if data is not None else b""
        return [str(raw[a:b], "utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_tools: dict[tuple, Encoder | Decoder] = {}


def _tool(kind: type, vocabulary: Vocabulary):
    """The encoder or decoder of a Python worker, made once for a vocabulary."""
    key = (kind, id(vocabulary))
    if key not in _tools:
        for old in [k for k in _tools if k[0] is kind]:
            del _tools[old]
        _tools[key] = kind(vocabulary)
    return _tools[key]


def _add(docs: DataFrame, run, columns: dict[str, tuple[str, T.DataType]]) -> DataFrame:
    """Run over Arrow batches; new columns travel under free names and then replace any of the wanted name."""
    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(tmp, kind) for tmp, kind in columns.values()]]))
    return out.drop(*columns).withColumnsRenamed({tmp: name for name, (tmp, _) in columns.items()})


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _ends(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count)]).astype(np.int32)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add an array<int> column of token ids. `path`: a byte-level BPE file of the tokenizers library."""
    voc = _shipped(ready(docs.sparkSession), path)
    (tmp,) = fresh(docs, "ids")

    def run(batches):
        enc = _tool(Encoder, voc.value)
        for whole in batches:
            for batch in _slices(whole, text, 1 << 19):
                values, count = enc.batch(_texts(batch, text))
                yield _append(batch, tmp, pa.ListArray.from_arrays(pa.array(_ends(count)), pa.array(values)))

    return _add(docs, run, {ids: (tmp, T.ArrayType(T.IntegerType()))})


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for; bytes that are not UTF-8 become the replacement character. Null ids: empty."""
    voc = _shipped(ready(frame.sparkSession), path)
    (tmp,) = fresh(frame, "decoded")

    def run(batches):
        dec = _tool(Decoder, voc.value)
        for whole in batches:
            for batch in _slices(whole, ids, 1 << 18):
                col = batch.column(batch.schema.get_field_index(ids))
                count = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                yield _append(batch, tmp, pa.array(dec.batch(col.flatten().to_numpy(zero_copy_only=False), _ends(count)), pa.string()))

    return _add(frame, run, {text: (tmp, T.StringType())})


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and then decode() of those ids in one pass, so that neither ids nor texts travel twice."""
    voc = _shipped(ready(docs.sparkSession), path)
    tmp, back = fresh(docs, "ids", "decoded")

    def run(batches):
        enc, dec = _tool(Encoder, voc.value), _tool(Decoder, voc.value)
        for whole in batches:
            for batch in _slices(whole, text, 1 << 19):
                values, count = enc.batch(_texts(batch, text))
                ends = _ends(count)
                out = _append(batch, tmp, pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                yield _append(out, back, pa.array(dec.batch(values, ends), pa.string()))

    return _add(docs, run, {ids: (tmp, T.ArrayType(T.IntegerType())), decoded: (back, T.StringType())})


def digests(docs: DataFrame, path: str) -> DataFrame:
    """op5: per document the number of tokens and digests of its ids and of the text decoded from them."""
    out = round_trip(docs.select("doc_id", "text"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
