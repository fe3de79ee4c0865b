"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into words that no vocabulary piece can span (before a run of the space mark that follows another
character, and around characters that no piece holds). All words a chunk of rows needs for the first time are encoded
together: one flat array of symbols, one round per merge step. A round looks up the piece of every adjacent pair,
takes the best (lowest) rank per word, merges its leftmost non-overlapping occurrences everywhere at once, and
compacts the array; words without a pair leave. This goes on until none remains. A word in which a merge at one place
makes a pair of better rank merges only its leftmost occurrence in that round, as one merge after the other would.

Runs of space marks have pieces of equal score, so their order is by position alone; such runs of two or more marks
are merged by position in ``_run_ids``.

Nulls and empty texts give no ids and an empty decoded text. Rows are independent: repeated rows, repeated or missing
ids and extra columns do not matter; long texts are taken whole.
"""

import gc
import hashlib
import re
from functools import lru_cache

import numpy as np

from cohortspark.llm.common import arrow_map

SPACE = "▁"
CACHE_WORDS = 200_000


def default_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces, scores and types of a model file (BPE, identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, path):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.is_byte[i]}
        self.unk = sp.unk_id()
        self.unused = np.array([sp.is_unused(i) for i in range(n)])
        normal = [i for i in range(n) if not special[i]]
        self.id_of = {self.pieces[i]: i for i in normal}
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, 2**31 - 1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.alphabet = sorted({c for p in self.id_of for c in p})
        # symbols: a piece has its id; a character that is in pieces but is none itself gets a number above
        self.extra = {c: n + k for k, c in enumerate(c for c in self.alphabet if c not in self.id_of)}
        self.width = n + len(self.extra) + 1
        self.other = self.width - 1
        keys, made = [], []
        number = {**self.id_of, **self.extra}
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                a, b = number.get(p[:cut]), number.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    made.append(i)
        keys, made = np.array(keys, np.int64), np.array(made, np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[by], made[by]
        self.number = number
        outside = "".join(re.escape(c) for c in self.alphabet)
        self.cut = re.compile(f"{SPACE}*[{outside.replace(SPACE, '')}]+|{SPACE}+|[^{outside}]", re.S)
        self.runs = {len(p) for p in self.id_of if set(p) == {SPACE}}
        codes = np.array([ord(c) for c in self.alphabet])
        self.table = np.full(0x110000, self.other, np.int32)
        self.table[codes] = [number[c] for c in self.alphabet]
        if self.unused.any():
            raise ValueError("models with unused pieces are not supported")
        self.id_text = [str(i) for i in range(n)]
        # what a piece decodes to; bytes have none of their own, neighbours are read together
        self.plain = [None if self.is_byte[i] else " ⁇ " if i == self.unk else self.pieces[i].replace(SPACE, " ") for i in range(n)]

    # -- merge rounds ------------------------------------------------------------------------------------------------

    def _made_of(self, left, right):
        """Piece that two symbols make, -1 if none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def _pairs(self, sym, word):
        """Piece made by each symbol and its right neighbour in the same word, -1 if none."""
        made = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            inside = np.flatnonzero(word[:-1] == word[1:])
            made[inside] = self._made_of(sym[inside], sym[inside + 1])
        return made

    def _rank_of(self, left, right):
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[self.made[at]], 2**31 - 1)

    def merge(self, words):
        """Ids of each word (lists), for words without runs of two or more space marks."""
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym, word = self.table[codes].astype(np.int64), np.repeat(np.arange(len(words)), sizes)
        char = codes.astype(np.int64)  # code point while the symbol is one character
        done = []
        made = self._pairs(sym, word)
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], 2**31 - 1)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(word)])
            ended = np.repeat(best == 2**31 - 1, sizes)
            if ended.any():
                done.append((word[ended], sym[ended], char[ended]))
                live = ~ended
                sym, word, char, made, rank = sym[live], word[live], char[live], made[live], rank[live]
                keep = best < 2**31 - 1
                best, sizes = best[keep], sizes[keep]
                if not len(sym):
                    break
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            hit = rank == np.repeat(best, sizes)
            hit = self._leftmost(hit)
            many = np.add.reduceat(hit, starts) > 1
            if many.any():
                hit = self._one_by_one(hit, many, sizes, sym, word, made, best)
            sym = np.where(hit, made, sym)
            stay = ~np.r_[False, hit[:-1]]
            at = (np.cumsum(stay) - 1)[hit]
            sym, word, char, made = sym[stay], word[stay], char[stay], made[stay]
            # only pairs that a merged symbol is in are new
            for place in (at, at[at > 0] - 1):
                right = np.minimum(place + 1, len(sym) - 1)
                made[place] = np.where((right > place) & (word[place] == word[right]), self._made_of(sym[place], sym[right]), -1)
        word = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        by = np.argsort(word, kind="stable")
        sym = np.concatenate([d[1] for d in done])[by] if done else word
        char = np.concatenate([d[2] for d in done])[by] if done else word
        ends = np.searchsorted(word[by], np.arange(len(words)), side="right").tolist()
        plain, sym, char = (sym < len(self.pieces)).tolist(), sym.tolist(), char.tolist()
        out, start = [], 0
        for end in ends:
            if all(plain[start:end]):
                out.append(sym[start:end])
            else:
                out.append([i for k in range(start, end) for i in ([sym[k]] if plain[k] else self._bytes(chr(char[k])))])
            start = end
        return out

    @staticmethod
    def _leftmost(hit):
        """Of overlapping occurrences (runs of neighbours) every second one, from the left."""
        both = hit.copy()
        both[1:] &= hit[:-1]
        if not both[1:].any():
            return hit
        at = np.arange(len(hit))
        begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, -1))
        return hit & ((at - begin) % 2 == 0)

    def _one_by_one(self, hit, many, sizes, sym, word, made, best):
        """Words with several merges where one of them would make a better pair: only the leftmost is merged."""
        at = np.flatnonzero(hit & np.repeat(many, sizes))
        n = len(sym)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ab = made[at]
        left = np.where((at > 0) & (word[at - 1] == word[at]), sym[at - 1], -1)
        far = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 < n) & (word[far] == word[at]), sym[far], -1)
        worst = np.minimum(np.minimum(self._rank_of(left, ab), self._rank_of(ab, right)), self._rank_of(ab, ab))
        unsafe = np.zeros(len(sizes), bool)
        unsafe[owner[at[worst < best[owner[at]]]]] = True
        if unsafe.any():
            hits = np.flatnonzero(hit & unsafe[owner])
            hit[hits[np.r_[False, owner[hits[1:]] == owner[hits[:-1]]]]] = False
        return hit

    def _bytes(self, char):
        return [self.byte_id[b] for b in char.encode("utf-8")] if self.byte_id else [self.unk]

    @lru_cache(maxsize=4096)
    def _run_ids(self, n):
        """A run of n space marks: all pieces score alike, so the leftmost pair merges first, again and again."""
        parts = []
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                parts[-2:] = [parts[-2] + parts[-1]]
        return tuple(self.id_of[SPACE * k] for k in parts)

    def words(self, text):
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_words(self, words):
        """Ids of each word. Its last space mark may merge with what follows; if it does not, it ends the run of marks."""
        body, runs = [], []
        for w in words:
            n = len(w) - len(w.lstrip(SPACE))
            runs.append(max(n - 1, 0))
            body.append(w[runs[-1]:])
        mark = self.id_of[SPACE]
        return [ids if not r else list(self._run_ids(r + 1)) + ids[1:] if ids[0] == mark else list(self._run_ids(r)) + ids
                for r, ids in zip(runs, self.merge(body))]

    # -- decoding ----------------------------------------------------------------------------------------------------

    def surface(self, ids):
        """Text of ids: pieces with spaces for space marks; neighbouring byte pieces are read as UTF-8 together."""
        plain = [self.plain[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out, raw = [], bytearray()
        for i, text in zip(ids, plain):
            if text is None:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_read_bytes(raw))
                raw = bytearray()
            out.append(text)
        if raw:
            out.append(_read_bytes(raw))
        return "".join(out)

    def decode(self, ids):
        text = self.surface(ids)
        return text[1:] if ids and not self.is_byte[ids[0]] and text[:1] == " " else text


def _read_bytes(raw):
    """UTF-8, with one replacement character for each byte that is no part of a character."""
    raw = bytes(raw)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[i:i + size].decode("utf-8"))
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load_model(path):
    return PieceModel(path)


class WordCache:
    """Words encoded so far in this worker: ids, their comma-joined text, decoded text. When full, the words become the
    older half, from which those still in use move on; the rest goes with the next change."""

    def __init__(self, model):
        self.model, self.known, self.older = model, {}, {}

    def need(self, lists):
        wanted = set().union(*lists)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.older = {}, self.known
            new = wanted
        held = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in held)
        new = list(new.difference(held))
        for start in range(0, len(new), 100_000):
            part = new[start:start + 100_000]
            text, surface = self.model.id_text, self.model.surface
            for w, ids in zip(part, self.model.encode_words(part)):
                self.known[w] = (len(ids), ",".join([text[i] for i in ids]), surface(ids), ids)


_CACHES = {}


def _cache(path):
    if path not in _CACHES:
        _CACHES[path] = WordCache(load_model(path))
    return _CACHES[path]


def encode_decode(docs, text_col="text", model_path=None, with_ids=False):
    """Adds n_tokens, ids_sha256, decoded_sha256 (and with ``with_ids`` token_ids, decoded_text) to every row."""
    path = model_path or default_model()
    from pyspark.sql import types as T

    fields = [f for f in docs.schema.fields if f.name not in ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded_text")]
    kept = [f.name for f in fields]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        added += [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_text", T.StringType())]
    place = kept.index(text_col)

    def run(batch):
        # words and ids hold no cycles: looking for some in a full cache takes a seventh of the time
        gc.disable()
        try:
            yield from encoded(batch)
        finally:
            gc.enable()

    def encoded(batch):
        cache = _cache(path)
        texts = batch.column(place)
        start = 0
        while start < batch.num_rows:
            lists, size, end = [], 0, start
            while end < batch.num_rows and (end == start or size < 1_000_000):
                words = cache.model.words(texts[end].as_py() or "")
                size += len(texts[end].as_py() or "")
                lists.append(words)
                end += 1
            cache.need(lists)
            known = cache.known
            cols = {name: batch.column(i).slice(start, end - start) for i, name in enumerate(kept)}
            n, ids, decoded, all_ids, all_text = [], [], [], [], []
            for words in lists:
                got = [known[w] for w in words]
                text = "".join([g[2] for g in got])
                if got and text[:1] == " ":  # the mark put before every text
                    text = text[1:]
                n.append(sum([g[0] for g in got]))
                ids.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append([i for g in got for i in g[3]])
                    all_text.append(text)
            cols |= {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}
            if with_ids:
                cols |= {"token_ids": all_ids, "decoded_text": all_text}
            yield cols
            start = end

    return arrow_map(docs.select(*kept), run, T.StructType(fields + added))
