"""Vectorised hashing of words, windows and shingles over UTF-8 bytes."""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
from pandas.util import hash_array

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: A Mersenne prime, and two bases for it.
PRIME, BASES = (1 << 31) - 1, (1_234_567_891, 987_654_321)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 23:  # powers for a huge text are not kept
            _powers[name] = have
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes, modulo 2**64; one more entry than bytes. Different strings can be made to
    collide, so these hashes only choose places and deal work: no result may rest on them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow("up", _BASE, len(data)), out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: equal bytes, equal hash, wherever they stand."""
    down = _pow("down", _INV, len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def _pow_mod(base: int, n: int) -> np.ndarray:
    name = f"mod {base}"
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, _mod(have * np.uint64(pow(base, len(have), PRIME)))])
        if n <= 1 << 22:
            _powers[name] = have
    return have[:n]


def prefix_mod(data: np.ndarray) -> list[np.ndarray]:
    """Prefix sums of two polynomials over numbers below 2**32, modulo PRIME; the sums themselves are not reduced."""
    out = []
    for base in BASES:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_mod((data.astype(np.uint64) + np.uint64(1)) * _pow_mod(base, len(data))), out=sums[1:])
        out.append(sums)
    return out


def spans_mod(pre: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62-bit hashes of ranges. Whoever uses them compares the ranges themselves on a hit."""
    a, b = (_mod(_mod(sums[end] - sums[start]) * _pow_mod(pow(base, -1, PRIME), len(sums))[start]) for sums, base in zip(pre, BASES, strict=True))
    return mix((a << np.uint64(31) | b) ^ mix((end - start).astype(np.uint64)))


class _Words(dict):
    """Digests of words, kept for the words seen last; a long word is not kept."""

    MOST, LONG = 100_000, 64

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def words(raw: bytes) -> np.ndarray:
    """A 64-bit blake2b digest of every word; words are runs of bytes other than space, tab to carriage return."""
    return np.fromiter(map(_words.__getitem__, raw.split()), np.uint64)


def sip_words(raw: bytes) -> np.ndarray:
    """A 64-bit SipHash-2-4 of every word, by a fixed key, under a bijection. Where most words are rare, it takes a fifth of
    the time of words()."""
    word = raw.split()
    return hash_array(np.array(word, object), categorize=False) if word else np.zeros(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique() of numbers, with less work for each call."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row within one text; a shorter text is one shingle, an empty one has none."""
    n = len(word)
    if not n:
        return word
    m = max(1, n - k + 1)
    acc = np.zeros(m, np.uint64)
    for j in range(min(k, n)):
        acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + word[j : j + m])
    return acc


def text_shingles(raw: bytes, k: int) -> np.ndarray:
    return shingles(words(raw), k)


def exact_shingles(raws: list[bytes], k: int) -> list[np.ndarray]:
    """The set of shingles of each text as small numbers that stand for the same words in all of them. Hashes only bring
    shingles together: their words are compared, and numbered without a hash if two differ."""
    number: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
    ids = [np.fromiter(map(number.__getitem__, r.split()), np.int64) for r in raws]
    ids = [np.pad(x, (0, max(0, k - len(x)))) if len(x) else x for x in ids]  # 0 stands after the words of a short text
    if not ids:
        return []
    made = np.array([max(0, len(x) - k + 1) for x in ids])
    size = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    start = np.arange(made.sum()) + np.repeat(np.cumsum(size) - size - (np.cumsum(made) - made), made)
    word = [flat[start + j] for j in range(k)]
    key = place(word)
    _, first, acc = np.unique(key, return_index=True, return_inverse=True)
    if not all((w == w[first][acc]).all() for w in word):
        acc, width = word[0], len(number) + 1
        for w in word[1:]:
            acc = np.unique(acc * width + w, return_inverse=True)[1].astype(np.int64)  # below 2**31 each, so the product fits
    width = int(acc.max(initial=0)) + 1
    every = distinct(np.repeat(np.arange(len(made)), made) * width + acc)
    return np.split(every % width, np.searchsorted(every, np.arange(1, len(made)) * width))


def place(word: list[np.ndarray]) -> np.ndarray:
    """A hash of the numbers of words in a row."""
    acc = np.zeros(len(word[0]), np.uint64)
    for w in word:
        acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + w.astype(np.uint64))
    return acc
