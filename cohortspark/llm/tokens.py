"""Words and rolling hashes of many texts at once, as flat arrays."""

from functools import lru_cache

import numpy as np

from cohortspark.llm.common import utf8

BASE = 0x9E3779B97F4A7C13  # odd, so it has an inverse modulo 2**64
_MASK = 2**64 - 1
_BREAKS = np.zeros(256, bool)
_BREAKS[[32, 9, 10, 11, 12, 13]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x):
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=4)
def byte_values(seed):
    return np.random.default_rng(seed).integers(0, _MASK, 256, dtype=np.uint64, endpoint=True)


_powers = {}


def powers(n, base=BASE):
    """base**i modulo 2**64 for i < n, kept and grown by doubling."""
    held = _powers.get(base)
    if held is None:
        held = np.ones(1, np.uint64)
    while len(held) < n:
        held = np.r_[held, held * np.uint64(pow(base, len(held), 2**64))]
    _powers[base] = held
    return held[:n]


def inverse(base=BASE):
    return pow(base, -1, 2**64)


class Prefix:
    """Hashes of any stretch [s, e) of a sequence of 64-bit values, from prefix sums of value * base**place."""

    def __init__(self, values, base=BASE):
        self.base = base
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * powers(len(values), base), out=self.sums[1:])

    def of(self, start, end):
        return (self.sums[end] - self.sums[start]) * powers(len(self.sums), inverse(self.base))[start]

    def each(self, k):
        """Hashes of the stretches of k values at all places."""
        out = self.sums[k:] - self.sums[:-k]
        out *= powers(len(self.sums), inverse(self.base))[:len(out)]
        return out


def word_table(column, kind="plain", seed=7):
    """Hashes of all words of a string column: (hash of each word, first word of each row and the total at the end).

    kind: "plain" - runs without white space, unchanged; "lower" - the same with A-Z lower-cased; "alnum" - runs of
    digits, letters and characters beyond ASCII, lower-cased. Words never cross rows; nulls have none."""
    data, off = utf8(column)
    if kind != "plain":
        data = _LOWER[data]
    inside = _ALNUM[data] if kind == "alnum" else ~_BREAKS[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), data
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.r_[inside[1:], False]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    sums = Prefix(byte_values(seed)[data])
    hashes = mix(sums.of(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return hashes, np.searchsorted(starts, off), starts, ends, data


def runs(words, n, base=0xD1342543DE82EF95):
    """Hash of each run of n consecutive words (len(words) - n + 1 of them); the length is part of it."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    start = np.arange(count)
    return mix(Prefix(words, base).of(start, start + n) + np.uint64(n * 0x9FB21C651E98DF25 & _MASK))


def slide(x, n, pick):
    """pick (minimum or maximum) of each n consecutive values."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x = pick(x[:-step], x[step:])
        width += step
    return x


def winnowed(g, n):
    """Places whose value is the smallest in some run of n consecutive values (len(g) >= n); ties all count."""
    low = slide(g, n, np.minimum)
    pad = np.zeros(n - 1, g.dtype)
    return np.flatnonzero(slide(np.r_[pad, low, pad], n, np.maximum) == g)
