"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, counted over the corpus.

Both tokenizers encode every text; tokens whose byte ranges overlap are linked, and places where tokens of both end cut
them into groups. How many documents hold an id pair is counted by external merging:

1. A block of documents sorts its (A id, B id, document) records once, A side first. Equal neighbours fold into one
   record with its number of links. The records stay with the block as a zstd frame; its distinct pairs with their
   document counts go out as sorted zstd runs, one for each radix partition of the A ids.
2. Runs of a radix partition are merged k ways: a heap holds the frames that are open, by their next key, and what lies
   below the next frame's first key is summed and sent on. Over ``FAN_IN`` blocks, groups of runs are merged first and
   their merged runs again. Keys leave in A-major order, so an A id's largest count is known as soon as its last pair
   has passed, and its pairs leave with their count and a mark where they reach it.
3. Each block's runs meet the merged counts of their partition and stream the answers back to the block, whose records
   turn them into sums per document.

No task holds more than a block, ``FAN_IN`` open frames, or one partition's pairs (at most A ids * B ids / RADIX, about
12 million here, whatever the corpus); a pair that every document holds is one entry per block.

Nulls, empty texts, and texts that a tokenizer does not reproduce have no tokens: zeros and an empty string. Rows are
documents: repeated rows and repeated or missing ids count each for itself. Ties for the largest count all count. Long
texts are taken whole; extra columns stay.
"""

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F, types as T

from cohortspark.llm.blocks import BLOCK_BYTES, block_ids, concat_ranges, kinds_stored, map_groups, map_rows, pack_many, unpack_many
from cohortspark.llm.common import row_chunks, stored

RADIX = 128
FAN_IN = 256
#: pairs in one frame of a merged run
FRAME = 1 << 17
#: bits for a B id, and for a document within its block
B_BITS, DOC_BITS = 20, 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def default_tokenizers():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


# -- the two tokenizers ----------------------------------------------------------------------------------------------


def byte_alphabet():
    """Character of the byte-level alphabet -> byte: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Byte-level BPE of a tokenizer file whose ids are in merge order (checked), special tokens left out."""

    def __init__(self, path, pattern):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(b <= a for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(ranks):
            raise ValueError("a byte-level vocabulary whose ids follow its merges is needed")
        self.encoding = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.length = np.zeros(self.size, np.int64)
        for t, i in ranks.items():
            self.length[i] = len(t)

    def encode(self, text):
        return self.encoding.encode_ordinary(" " + text)

    def joined(self, ids):
        return self.encoding.decode_bytes(ids)


class PieceTokens:
    def __init__(self, path):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.sp.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = self.sp.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace("▁", " ").encode())
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text):
        return self.sp.encode(text)

    def joined(self, ids):
        return b"".join([self.bytes[i] for i in ids])


@lru_cache(maxsize=2)
def load(byte_path, piece_path, pattern):
    a, b = ByteTokens(byte_path, pattern), PieceTokens(piece_path)
    if b.size >= 1 << B_BITS or a.size >= 1 << 22:
        raise ValueError("the vocabulary is too large")
    names = [f"{i}{end}" for end in ",|" for i in range(a.size)] + [f"{i}{end}" for end in ",;" for i in range(b.size)]
    return a, b, np.array(names, object)


# -- one block of texts ----------------------------------------------------------------------------------------------


def radix_major(ids, size):
    """A ids numbered so that those of one radix partition are neighbours, in order within it."""
    return ids % RADIX * (size // RADIX + 1) + ids // RADIX


def radix_of(keys, size):
    return (keys >> B_BITS) // (size // RADIX + 1)


class Aligned:
    """Tokens, groups and links of a block of texts.

    a, b: ids of all documents in turn; a_of, b_of: tokens of each document; a_ends, b_ends: tokens that end a group;
    left, right: token places of every link."""

    def __init__(self, texts, a, b):
        lists_a, lists_b = [], []
        for text in texts:
            ids_a = ids_b = []
            if text:
                raw = b" " + text.encode()
                ids_a, ids_b = a.encode(text), b.encode(text)
                if a.joined(ids_a) != raw or b.joined(ids_b) != raw:
                    ids_a = ids_b = []
            lists_a.append(np.array(ids_a, np.int64))
            lists_b.append(np.array(ids_b, np.int64))
        self.a_of, self.b_of = np.array([len(x) for x in lists_a], np.int64), np.array([len(x) for x in lists_b], np.int64)
        none = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate(none + lists_a), np.concatenate(none + lists_b)
        # both sides cover the same bytes of each document, so places in the whole block agree
        end_a, end_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        at = np.searchsorted(end_b, end_a)  # the B token in which an A token ends
        self.a_ends = end_b[at] == end_a if len(at) else np.zeros(0, bool)
        self.b_ends = np.zeros(len(self.b), bool)
        self.b_ends[at[self.a_ends]] = True
        first = np.concatenate([[0], at + self.a_ends])[:len(at)]
        sizes = at - first + 1
        self.left, self.right = np.repeat(np.arange(len(at)), sizes), concat_ranges(first, sizes)

    def documents(self):
        """Document of each A token."""
        return np.repeat(np.arange(len(self.a_of)), self.a_of)

    def per_document(self, marks, sizes):
        sums = np.concatenate([[0], np.cumsum(marks)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def counts(self):
        """n_a, n_b, n_groups, n_links of every document."""
        links = np.bincount(self.left, minlength=len(self.a))
        return self.a_of, self.b_of, self.per_document(self.a_ends, self.a_of), self.per_document(links, self.a_of)

    def group_texts(self, names, a_size, b_size):
        """Groups of every document as text: ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = np.cumsum(self.a_ends) - self.a_ends, np.cumsum(self.b_ends) - self.b_ends
        last_a, last_b = np.flatnonzero(self.a_ends), np.flatnonzero(self.b_ends)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        before = np.concatenate([[0], last_b + 1])
        codes[np.arange(len(self.a)) + before[group_a]] = self.a + a_size * self.a_ends
        codes[np.arange(len(self.b)) + (last_a + 1)[group_b]] = 2 * a_size + self.b + b_size * self.b_ends
        words, out, start = names[codes].tolist(), [], 0
        for end in np.cumsum(self.a_of + self.b_of).tolist():
            out.append("".join(words[start:end])[:-1])
            start = end
        return out

    def records(self, a_size):
        """(pair keys in radix and A-major order, documents of each, their document, links there)."""
        pair = radix_major(self.a[self.left], a_size) << B_BITS | self.b[self.right]
        folded = np.sort(pair << DOC_BITS | self.documents()[self.left])
        new = np.concatenate([[True], folded[1:] != folded[:-1]])[:len(folded)]
        at = np.flatnonzero(new)
        links = np.diff(np.append(at, len(folded)))
        folded = folded[at]
        pair, doc = folded >> DOC_BITS, folded & (1 << DOC_BITS) - 1
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[:len(pair)])
        return pair[first], np.diff(np.append(first, len(pair))), doc, links


def _cut_blocks(docs, text_col, kept, paths, with_groups):
    names = [f.name for f in kept]

    def run(batches):
        a, b, words = load(*paths)
        ids = block_ids()
        for whole in batches:
            for batch in row_chunks(whole, BLOCK_BYTES, text_col):
                column = {n: batch.column(batch.schema.names.index(n)) for n in (*names, text_col)}
                found = Aligned(column[text_col].to_pylist(), a, b)
                groups = found.group_texts(words, a.size, b.size)
                keys, sizes, doc, links = found.records(a.size)
                block = next(ids)
                blank = {"counts": [None], "groups": [None], **{f"c{i}": [None] for i in range(len(kept))}}
                shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield {"kind": ["documents"], "block": [block], "radix": [-1], "first": [0],
                       "data": [pack_many(sizes.astype(np.int32), doc.astype(np.uint16 if len(groups) < 1 << 16 else np.int32), links.astype(np.int32))],
                       "counts": [[list(map(int, x)) for x in found.counts()]], "groups": [[shas, groups] if with_groups else [shas]],
                       **{f"c{i}": [column[n].to_pylist()] for i, n in enumerate(names)}}
                radix = radix_of(keys, a.size)
                starts = np.flatnonzero(np.concatenate([[True], radix[1:] != radix[:-1]])[:len(radix)])
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(radix)]):
                    yield {"kind": ["runs"], "block": [block], "radix": [int(radix[s])], "first": [int(keys[s])], "data": [pack_many(keys[s:e], sizes[s:e].astype(np.int32), ascending=1)], **blank}

    fields = [T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("radix", T.IntegerType()),
              T.StructField("first", T.LongType()), T.StructField("data", T.BinaryType()),
              T.StructField("counts", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("groups", T.ArrayType(T.ArrayType(T.StringType())))]
    return map_rows(docs, run, T.StructType(fields + [T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(kept)]))


# -- counting by merging ---------------------------------------------------------------------------------------------


def merge_runs(frames):
    """(keys, counts) in order, equal keys summed, from (keys, counts) frames that come by their first key.

    The heap holds the frames read so far by their next key. What lies below the A id of the frame that comes next is
    complete and leaves; the rest of a frame goes back with its new next key. Pairs of one A id leave together."""
    heap, held, order = [], 0, 0

    def push(keys, counts):
        nonlocal order
        order += 1
        heapq.heappush(heap, (int(keys[0]), order, keys, counts))

    def below(limit):
        nonlocal held
        parts = []
        while heap and (limit is None or heap[0][0] < limit):
            _, _, keys, counts = heapq.heappop(heap)
            cut = len(keys) if limit is None else int(np.searchsorted(keys, limit))
            parts.append((keys[:cut], counts[:cut]))
            held -= cut
            if cut < len(keys):
                push(keys[cut:], counts[cut:])
        if not parts:
            return None
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    for keys, counts in frames:
        if held > 4 * FRAME:
            out = below(int(keys[0]) >> B_BITS << B_BITS)
            if out is not None:
                yield out
        held += len(keys)
        push(keys, counts)
    out = below(None)
    if out is not None:
        yield out


def _frames(rows):
    for r in rows:
        yield unpack_many(r["data"])


def _merge_level(runs, groups):
    """Merge the runs of each radix partition in so many groups; each merged run comes as frames."""
    def merge(key, rows):
        for keys, counts in merge_runs(_frames(rows)):
            for s in range(0, len(keys), FRAME):
                yield {"radix": [key[0]], "block": [key[1]], "first": [int(keys[s])], "data": [pack_many(keys[s:s + FRAME], counts[s:s + FRAME], ascending=1)]}

    dealt = runs.select("radix", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), "first", "data")
    return map_groups(dealt, ["radix", "group"], ["first"], merge, "radix int, block long, first long, data binary")


def count_pairs(runs, blocks):
    """Documents of every pair of the corpus: (radix, first, data) frames of keys and 2 * count + (1 if the A id's largest)."""
    while blocks > FAN_IN:
        blocks = -(-blocks // FAN_IN)
        runs = stored(_merge_level(runs, blocks), "merged-runs")

    def merge(key, rows):
        for keys, counts in merge_runs(_frames(rows)):
            side = keys >> B_BITS
            first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
            best = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
            marked = 2 * counts + (counts == best)
            for s in range(0, len(keys), FRAME):
                yield {"radix": [key[0]], "first": [int(keys[s])], "data": [pack_many(keys[s:s + FRAME], marked[s:s + FRAME], ascending=1)]}

    return map_groups(runs.select("radix", "first", "data"), ["radix"], ["first"], merge, "radix int, first long, data binary")


def _answers(runs, merged, blocks):
    """For every run, the marked counts of its pairs, in its order."""
    salts = max(1, -(-blocks // FAN_IN))

    def answer(key, rows):
        known, keys, marked = [], None, None
        for r in rows:
            if r["block"] is None:
                known.append(unpack_many(r["data"]))
                continue
            if keys is None:
                keys, marked = (np.concatenate([k[i] for k in known]) for i in (0, 1))
            asked = unpack_many(r["data"])[0]
            yield {"block": [r["block"]], "radix": [key[0]], "data": [pack_many(marked[np.searchsorted(keys, asked)])]}

    asked = runs.select("radix", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "first", "data")
    told = merged.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("block"), "first", "data")
    return map_groups(told.unionByName(asked), ["radix", "salt"], [F.col("block").asc_nulls_first(), "first"], answer, "block long, radix int, data binary")


def align(docs, text_col="text", tokenizers=None, with_groups=False):
    """Every row without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and ``groups``)."""
    paths = tokenizers or default_tokenizers()
    added = [*COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    kept = [f for f in docs.schema.fields if f.name not in (text_col, *added)]
    docs = docs.select(*[f.name for f in kept], F.col(text_col).cast("string").alias(text_col))
    read = kinds_stored(_cut_blocks(docs, text_col, kept, paths, with_groups), "aligned")
    parts, runs = read("documents"), read("runs").select("radix", "block", "first", "data")
    blocks = parts.select("block").count()
    merged = stored(count_pairs(runs, blocks), "pair-counts")
    answers = _answers(runs, merged, blocks)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in parts.schema.fields if f.name not in ("block", "radix", "data", "first")]
    names = [f.name for f in parts.drop("first").schema.fields]

    def total(key, rows):
        whole = next(rows)
        marked = [unpack_many(r["data"])[0] for r in rows]
        sizes, doc, links = unpack_many(whole["data"])
        marked = np.repeat(np.concatenate([np.zeros(0, np.int64), *marked]), sizes)
        n = len(whole["groups"][0])
        best, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(best, doc, links * (marked & 1))
        np.add.at(sums, doc, links * (marked >> 1))
        out = {**{f"c{i}": whole[f"c{i}"] for i in range(len(kept))}, **dict(zip(COUNTS, whole["counts"])),
               "n_best": best, "count_sum": sums, "groups_sha256": whole["groups"][0]}
        yield out | ({"groups": whole["groups"][1]} if with_groups else {})

    struct = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")]
                          + [T.StructField(c, T.StringType()) for c in added[6:]])
    joined = parts.select(*names).unionByName(answers.select("block", "radix", "data", *blank).select(*names))
    done = map_groups(joined, ["block"], ["radix"], total, struct)
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], *added)
