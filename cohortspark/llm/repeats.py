"""Where windows of a fixed length may repeat: anchors, candidate windows and their segments, over flat arrays.

A sequence holds the elements (words or bytes, as 64-bit values) of many rows, one after the other. Of the k-grams
inside a window of ``width`` elements the smallest hash is its anchor, so equal windows have equal anchors at equal
places. A window is a candidate while its anchors (one for each k) are repeated somewhere. Consecutive candidates with the same
smallest gram form a segment: equal stretches of text are cut into equal segments, except at their ends.
"""

import numpy as np

from cohortspark.llm.tokens import Prefix, mix, slide

LAST = np.uint64(2**64 - 1)
#: Windows in a segment at most; only periodic text reaches it.
SEGMENT = 4096
SECOND_BASE = 0xC6A4A7935BD1E995


class Rows:
    def __init__(self, values, off, width):
        self.values, self.off, self.width = values, off, width
        self.prefix = Prefix(values)
        self.low, self.gram = {}, (0, None)
        size = np.diff(off)
        self.row = np.repeat(np.arange(len(off) - 1), size)
        self.room = np.repeat(off[1:], size) - np.arange(len(values))  # elements from each place to its row's end

    def grams(self, k):
        """Hash of the k-gram at each place; those that would cross rows are never the smallest of a window."""
        n = len(self.values) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if self.gram[0] != k:
            g = self.prefix.each(k)
            g += np.uint64(k)
            g = mix(g)
            np.clip(g, np.uint64(1), LAST - np.uint64(1), out=g)
            g[self.room[:n] < k] = LAST
            self.gram = k, g
        return self.gram[1]

    def smallest(self, k):
        """The smallest k-gram of the window at each place: its anchor."""
        if k not in self.low:
            self.low[k] = slide(self.grams(k), self.width - k + 1, np.minimum) if len(self.values) >= self.width else np.zeros(0, np.uint64)
        return self.low[k]

    def candidates(self, levels):
        """Whether the window at each place has repeated anchors only. levels: (k, test of hashes as int64)."""
        n = max(0, len(self.values) - self.width + 1)
        ok = self.room[:n] >= self.width
        for k, repeated in levels:
            left = np.count_nonzero(ok)
            if not left:
                break
            if 2 * left > n:  # most places: whole runs of one anchor, without a list of places
                low = self.smallest(k)
                new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
                ok &= np.repeat(repeated(low[new].view(np.int64)), np.diff(np.r_[new, n]))
                continue
            at = np.flatnonzero(ok)
            low = self.smallest(k)[at]
            new = np.r_[True, low[1:] != low[:-1]]
            good = repeated(low[new].view(np.int64))
            ok[at] = good[np.cumsum(new) - 1]
        return ok

    def anchors(self, ok, k):
        """(anchor, row) of the windows in ``ok``, once for each stretch of windows that share it."""
        at = np.flatnonzero(ok)
        if not len(at):
            return np.zeros(0, np.uint64), at
        low, row = self.smallest(k)[at], self.row[at]
        new = np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])]
        return low[new], row[new]

    def segments(self, ok, k):
        """(first window, last window, anchor) of each segment of candidate windows."""
        at = np.flatnonzero(ok)
        if not len(at):
            return at, at, np.zeros(0, np.uint64)
        low = self.smallest(k)[at]
        new = np.r_[True, (np.diff(at) != 1) | (low[1:] != low[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= (np.arange(len(at)) - start) % SEGMENT == 0
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        return at[first], at[last], low[first]

    def names(self, first, last):
        """Two 64-bit hashes of the text a segment covers."""
        end = last + self.width
        if not hasattr(self, "second"):
            self.second = Prefix(mix(self.values), SECOND_BASE)
        size = (end - first).astype(np.uint64)
        return mix(self.prefix.of(first, end) + size).view(np.int64), mix(self.second.of(first, end) + size).view(np.int64)


def merge_spans(spans):
    """Disjoint sorted spans of an array of (start, end)."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.column_stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:], len(spans)] - 1]])
