"""Language-model scoring with a log-frequency Bloom filter.

Training counts n-grams (words and the end of the text; lower-cased A-Z) over all training documents and keeps them in
a Bloom filter: an n-gram that occurs c times has level ``1 + floor(log2 c)``, and is put in once for each level up to
its own, so a lookup probes level 1, 2, ... until the first miss. A level stands for the middle of its counts. A false
positive (about ``2 ** -HASHES`` per probe) raises a count by a level; no count is ever too low. Probabilities are
smoothed from the probed counts, order by order:

    P(w | h) = (c(h w) + k * P(w | shorter h)) / (c(h) + k),    P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

Counts of single words are exact; they also give ``base_score``. Before the first word stands a start mark.

The filter grows with the corpus, so it is cut by the n-gram's hash into shards of a bounded number of entries
(``SHARD_BYTES`` of training text each); every worker that holds probes of a shard gets that shard, and neither a worker
nor the driver ever holds the whole. The exact counts of the shard's words travel with it. Documents are read in blocks:
each asks for an n-gram or word once, however often it occurs there, and what all documents share costs one entry per
block. Keys have as many bits as the corpus asks for (``key_bits``), so that an n-gram shares its key with
another in about one of 1,000 cases at any size.

Nulls and empty texts are one end mark. Repeated rows are scored and counted each for itself, ids play no part; long
texts are taken whole; extra columns stay. Without training documents every count is 0.
"""

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from cohortspark.llm.blocks import block_ids, distinct, map_groups, map_rows, pack, pack_many, release, squeeze, text_bytes, unpack, unpack_many, unsqueeze
from cohortspark.llm.common import row_chunks, stored
from cohortspark.llm.tokens import mix

#: text of one block
BLOCK_BYTES = 8_000_000
#: training text behind one shard of the filter
SHARD_BYTES = 4_000_000
#: hash functions of the filter; bits per entry follow
HASHES = 8
#: n-grams probed at once
PROBES = 500_000
#: prior rows behind a bigram's and a trigram's history
STRENGTH = (300.0, 100.0)
#: stand for the start and the end of a text; no word is empty or holds white space
START, END = b"\t", b""
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass
class Model:
    """shards: (shard, bits, data, words, counts): filter, and the shard's training words with their exact counts.
    tokens, distinct, documents: training tokens, distinct ones, documents."""

    shards: DataFrame
    n_shards: int
    key_bits: int
    tokens: int
    distinct: int
    documents: int
    strength: tuple = STRENGTH
    text_bytes: int = 0


def key_bits(size):
    """A text of ``size`` bytes has about a quarter as many n-grams; with 8 bits more than ``size`` has, another one has
    the same key in one of 1,000 cases."""
    return min(60, max(32, int(size + 1).bit_length() + 8))


# -- blocks ----------------------------------------------------------------------------------------------------------


def word_hashes(words):
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


class Block:
    """Words of a block of texts as places in its own dictionary; the end mark closes every text."""

    def __init__(self, texts):
        known, flat = defaultdict(count().__next__), []
        known[END]  # place 0
        self.sizes = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            # on bytes, lower() is A-Z and split() is at white space of ASCII only
            words = text.encode().lower().split() if text else []
            words.append(END)
            flat.extend(map(known.__getitem__, words))
            self.sizes[i] = len(words)
        self.words, self.places = list(known), np.array(flat, np.int32)
        self.hashes = word_hashes(self.words)

    def dump(self):
        return pack_many(self.places, self.sizes), pack_words(self.words)

    @classmethod
    def load(cls, data, words):
        self = cls.__new__(cls)
        self.places, self.sizes = unpack_many(data)
        self.words = unpack_words(words)
        self.hashes = word_hashes(self.words)
        return self

    def gram_keys(self):
        """(bigram key of every token, trigram key of every token, whether it is its text's first); keys of 64 bits."""
        token = self.hashes[self.places]
        first = np.zeros(len(token), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        start = np.uint64(xxhash.xxh3_64_intdigest(START))
        two = _join(np.where(first, start, np.concatenate([[start], token[:-1]])), token)
        return two, _join(np.concatenate([[start], two[:-1]]) + _C[2], token), first

    def grams(self, bits):
        """Keys of all n-grams: bigrams of every token, then trigrams of all but each text's first."""
        two, three, first = self.gram_keys()
        return np.concatenate([two, three[~first]]) >> np.uint64(64 - bits), first


def pack_words(words):
    return squeeze(b"\n".join(words))


def unpack_words(data):
    return unsqueeze(data).split(b"\n")


def _join(left, right):
    with np.errstate(over="ignore"):
        return mix(left * _C[0] + mix(right + _C[1]))


def _cuts(keys, bits, shards):
    """First place of every shard (and the end) in sorted keys of so many bits."""
    edges = [-(-(s << bits) // shards) for s in range(shards)]
    return np.searchsorted(keys, np.array(edges, np.uint64)).tolist() + [len(keys)]


def _blocks(batches):
    for whole in batches:
        for batch in row_chunks(whole, BLOCK_BYTES, "text"):
            yield batch, Block(batch.column(batch.schema.names.index("text")).to_pylist())


def _by_shard(block, keys, bits, shards):
    """(shard, place of its first key, of its last, places of its words in the block's dictionary)."""
    order = np.argsort(block.hashes, kind="stable")
    at, words = _cuts(keys, bits, shards), _cuts(block.hashes[order], 64, shards)
    for s in range(shards):
        if at[s] < at[s + 1] or words[s] < words[s + 1]:
            yield s, at[s], at[s + 1], order[words[s]:words[s + 1]]


# -- training --------------------------------------------------------------------------------------------------------


def levels_of(counts):
    """1 + floor(log2 count), exactly."""
    return np.frexp(counts.astype(np.float64))[1]


def counts_of(levels):
    """The middle of each level's counts; level 0 is none."""
    return np.where(levels > 0, (3.0 * np.exp2(levels - 1.0) - 1) / 2, 0.0)


def _seeds(keys, level):
    """Start and step of a key's places at a level."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(level) * _C[0])
        return h, h * _C[1] | np.uint64(1)


def _place(start, step, i, bits):
    with np.errstate(over="ignore"):
        return (start + np.uint64(i) * step >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)


def fill(keys, counts):
    """(bits, packed filter) that holds every key at all levels up to its count's."""
    levels = levels_of(counts)
    bits = max(64, int(np.ceil(levels.sum() * HASHES / np.log(2))))
    if bits >= 1 << 32:
        raise ValueError("too many entries for one shard")
    on = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        start, step = _seeds(keys[levels >= level], level)
        for i in range(HASHES):
            on[_place(start, step, i, bits)] = True
    return bits, np.packbits(on).tobytes()


def probe(keys, bits, data):
    """Level of every key: probes go on until the first miss."""
    table = np.frombuffer(data, np.uint8)
    found = np.zeros(len(keys), np.uint8)
    alive, level = np.arange(len(keys)), 0
    while len(alive):
        level += 1
        start, step = _seeds(keys[alive], level)
        for i in range(HASHES):
            at = _place(start, step, i, bits)
            hit = table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1 == 1
            alive, start, step = alive[hit], start[hit], step[hit]
        found[alive] = level
    return found


def _sum_equal(keys, counts):
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def train(docs, text_col="text", strength=STRENGTH):
    """Count the n-grams of all ``docs`` and put them into a filter of as many shards as the text asks for."""
    docs = docs.select(F.col(text_col).cast("string").alias("text"))
    size = text_bytes(docs)
    shards, bits = max(1, -(-size // SHARD_BYTES)), key_bits(size)

    def counted(batches):
        for _, block in _blocks(batches):
            keys, counts = np.unique(block.grams(bits)[0], return_counts=True)
            used = np.bincount(block.places, minlength=len(block.words))
            for s, a, b, at in _by_shard(block, keys, bits, shards):
                yield {"shard": [s], "data": [pack_many(keys[a:b], counts[a:b].astype(np.int32), ascending=1)],
                       "words": [pack_words([block.words[k] for k in at.tolist()]) if len(at) else None], "counts": [pack(used[at])]}

    def shard(key, rows):
        parts, words = [], {}
        for r in rows:
            parts.append(unpack_many(r["data"]))
            if r["words"] is not None:
                for w, n in zip(unpack_words(r["words"]), unpack(r["counts"]).tolist()):
                    words[w] = words.get(w, 0) + n
        size_, data = fill(*_sum_equal(*(np.concatenate([p[i] for p in parts]).astype(t) for i, t in ((0, np.uint64), (1, np.int64)))))
        yield {"shard": [key[0]], "bits": [size_], "data": [data], "words": [pack_words(list(words)) if words else None],
               "counts": [pack(np.array(list(words.values()), np.int64))], "tokens": [sum(words.values())], "distinct": [len(words)], "documents": [words.get(END, 0)]}

    parts = map_rows(docs, counted, "shard int, data binary, words binary, counts binary")
    built = map_groups(parts, ["shard"], [], shard, "shard int, bits long, data binary, words binary, counts binary, tokens long, distinct long, documents long")
    built = stored(built, "lm-shards")
    release(built.sparkSession)
    total = built.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "documents")]).first()
    return Model(built.select("shard", "bits", "data", "words", "counts"), shards, bits, total["tokens"], total["distinct"], total["documents"], tuple(strength), size)


# -- scoring ---------------------------------------------------------------------------------------------------------


def _answers(parts, model, salts):
    """For every block and shard: levels of the n-grams and training counts of the words, in the order of their hashes."""
    shards, bits = model.n_shards, model.key_bits

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                block = Block.load(r["data"], r["words"])
                keys = distinct(block.grams(bits)[0])
                for s, a, b, at in _by_shard(block, keys, bits, shards):
                    yield {"block": [r["block"]], "shard": [s], "data": [pack(keys[a:b], True)], "words": [pack_words([block.words[k] for k in at.tolist()]) if len(at) else None]}

    def answer(key, rows):
        size = data = None
        known, held = {}, []

        def told():
            keys = np.concatenate([k for _, k, _ in held])
            levels = probe(keys, size, data) if data else np.zeros(len(keys), np.uint8)
            ends = np.cumsum([len(k) for _, k, _ in held])
            yield {"block": [b for b, _, _ in held], "part": [key[0]] * len(held), "data": [pack_many(levels[e - len(k):e], c) for (_, k, c), e in zip(held, ends)]}
            held.clear()

        for r in rows:
            if r["bits"] is not None:
                size, data = r["bits"], bytes(r["data"])
                known = dict(zip(unpack_words(r["words"]), unpack(r["counts"]).tolist())) if r["words"] is not None else {}
                continue
            counts = [known.get(w, 0) for w in unpack_words(r["words"])] if r["words"] is not None else []
            held.append((r["block"], unpack(r["data"]), np.array(counts, np.int64)))
            if sum(len(k) for _, k, _ in held) > PROBES:
                yield from told()
        if held:
            yield from told()

    none = F.lit(None)
    asked = map_rows(parts.select("block", "data", "words"), ask, "block long, shard int, data binary, words binary")
    asked = asked.select("shard", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", none.cast("long").alias("bits"), "data", "words", none.cast("binary").alias("counts"))
    sent = model.shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none.cast("long").alias("block"), "bits", "data", "words", "counts")
    return map_groups(sent.unionByName(asked), ["shard", "salt"], [F.col("block").asc_nulls_first()], answer, "block long, part int, data binary")


def block_scores(block, counts, levels, model):
    """(known, base score, score) of every text of a block; counts of its words by hash order, levels of its n-grams."""
    grams, first = block.grams(model["key_bits"])
    _, at = np.unique(grams, return_inverse=True)
    seen = counts_of(levels.astype(np.float64))[at]
    n = len(block.places)
    two, three = seen[:n], np.zeros(n)
    three[~first] = seen[n:]
    by_word = np.empty(len(counts), np.int64)
    by_word[np.argsort(block.hashes, kind="stable")] = counts
    c = by_word[block.places]
    p1 = (c + 0.5) / (model["tokens"] + 0.5 * (model["distinct"] + 1))
    k2, k3 = model["strength"]
    history = np.where(first, model["documents"], np.concatenate([[0], c[:-1]]))
    p2 = (np.minimum(two, history) + k2 * p1) / (history + k2)
    history = np.where(first, 0, np.concatenate([[0], two[:-1]]))
    p3 = (np.minimum(three, history) + k3 * p2) / (history + k3)
    starts = np.cumsum(block.sizes) - block.sizes
    return np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10(p1), starts), np.add.reduceat(np.log10(np.minimum(p3, 1.0)), starts)


def score(docs, model, text_col="text"):
    """Every row without its text, with n_tokens, n_known, train_tokens, base_score and score (log10)."""
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [f for f in docs.schema.fields if f.name not in (text_col, *added)]
    docs = docs.select(*[F.col(f.name).alias(f"c{i}") for i, f in enumerate(kept)], F.col(text_col).cast("string").alias("text"))
    facts = {k: getattr(model, k) for k in ("tokens", "distinct", "documents", "strength", "key_bits")}

    def cut(batches):
        ids = block_ids()
        for batch, block in _blocks(batches):
            data, words = block.dump()
            yield {"block": [next(ids)], "data": [data], "words": [words], **{f"c{i}": [batch.column(i).to_pylist()] for i in range(len(kept))}}

    lists = [T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(kept)]
    struct = T.StructType([T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("words", T.BinaryType()), *lists])
    size = text_bytes(docs)
    parts = stored(map_rows(docs, cut, struct), "lm-blocks")
    answers = stored(_answers(parts, model, max(1, round(size / max(1, model.text_bytes)))), "lm-answers")
    release(docs.sparkSession)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in struct.fields[2:]]
    rows = parts.withColumn("part", F.lit(-1)).unionByName(answers.select("block", "part", "data", *blank))

    def total(key, found):
        whole = next(found)
        block = Block.load(whole["data"], whole["words"])
        got = [unpack_many(r["data"]) for r in found]
        levels, counts = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        n_known, base, full = block_scores(block, counts, levels, facts)
        yield {**{f"c{i}": whole[f"c{i}"] for i in range(len(kept))}, "n_tokens": block.sizes, "n_known": n_known,
               "train_tokens": [facts["tokens"]] * len(block.sizes), "base_score": base, "score": full}

    out = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField(c, T.LongType()) for c in added[:3]] + [T.StructField(c, T.DoubleType()) for c in added[3:]])
    done = map_groups(rows, ["block"], ["part"], total, out)
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], *added)
