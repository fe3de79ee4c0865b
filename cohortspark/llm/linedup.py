"""Line dedup by a sharded minimal perfect hash.

1. Every document yields the 128-bit hashes of its distinct line keys (stripped, A-Z lower-cased, long enough). They are
   counted per batch first, then by Spark with map-side combining, so a line that a third of all documents hold is a few
   rows by the time it is shuffled. Lines found in too few documents end here.
2. The frequent hashes are dealt into shards of about ``SHARD_KEYS``. Each shard becomes a minimal perfect hash (level
   bitmaps with ranks) over its keys, with arrays of fingerprints, document counts and largest document ids. The shards
   are a table in the shared folder.
3. Documents send their hashes to the shards, packed per document and shard. A shard's probes are spread over
   several tasks (its arrays go along), so hot lines do not meet in one task. The fingerprint tells a member from a
   stranger; what is found and must go returns to its document, packed again.

Defined cases: each row is a document, also rows that repeat an id; the line stays in every row with the largest id that
holds it. A missing id is smaller than any other. Null and empty texts are one empty line. Lines compare by 128-bit hash
(xxh3); long texts are taken whole; other columns stay as they are in ``drop_common_lines``.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from cohortspark.llm.common import TEXT_KEY, arrow_map, keyed, shuffle_parts, stored

STRIP = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 500_000
LOWEST = -(2**63)


def line_hash(key):
    d = xxhash.xxh3_128_intdigest(key)
    return (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63


def line_key(line, min_chars):
    """The key of a raw UTF-8 line, or None if it has fewer than ``min_chars`` code points."""
    key = line.strip(STRIP)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars):
        return None
    return key.lower()  # bytes.lower() changes A-Z only


def keys_of(text, min_chars):
    return [line_key(x, min_chars) for x in (text or "").encode("utf-8").split(b"\n")]


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level, keys that have a slot to themselves stay there."""

    GAMMA = 2

    def __init__(self, bits, starts, sizes):
        self.bits, self.starts, self.sizes = bits, starts, sizes
        self.rank = np.r_[0, np.cumsum(bits, dtype=np.int64)]

    @staticmethod
    def _slot(keys, level, size):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys):
        parts, left, level = [], keys, 0
        while len(left):
            size = cls.GAMMA * len(left) + 1
            slot = cls._slot(left, level, size)
            used = np.bincount(slot, minlength=size)
            parts.append(used == 1)
            left, level = left[used[slot] > 1], level + 1
        sizes = np.array([len(p) for p in parts], np.int64)
        return cls(np.concatenate(parts) if parts else np.zeros(0, bool), np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), sizes)

    def index(self, keys):
        """0 to n-1 for members, each once; some number or -1 for strangers."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes)):
            if not len(todo):
                break
            at = start + self._slot(keys[todo], level, int(size))
            here = self.bits[at]
            out[todo[here]] = self.rank[at[here]]
            todo = todo[~here]
        return out

    def dump(self):
        return np.r_[len(self.sizes), self.sizes].astype("<i8").tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, raw):
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", n, 8).astype(np.int64)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 * (n + 1)), count=int(sizes.sum())).astype(bool)
        return cls(bits, np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), sizes)


def line_counts(docs, min_chars, min_docs):
    """(lo, hi, n_docs, last_id) of the line keys that at least ``min_docs`` documents hold."""

    def count(batch):
        seen = {}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            doc = LOWEST if doc is None else doc
            for key in set(keys_of(text.as_py(), min_chars)):
                if key is not None:
                    n, last = seen.get(key, (0, LOWEST))
                    seen[key] = (n + 1, max(last, doc))
        hashes = [line_hash(k) for k in seen]
        return {"lo": [h[0] for h in hashes], "hi": [h[1] for h in hashes], "n": [v[0] for v in seen.values()], "last": [v[1] for v in seen.values()]}

    rows = arrow_map(docs.select("doc_id", "text"), count, "lo long, hi long, n long, last long")
    return rows.groupBy("lo", "hi").agg(F.sum("n").alias("n_docs"), F.max("last").alias("last_id")).where(F.col("n_docs") >= min_docs)


def build_shards(counts, n_shards):
    """One row per shard: the perfect hash and its fingerprint, count and last-id arrays, packed."""
    import pandas as pd

    def build(pdf):
        lo = pdf["lo"].to_numpy(np.int64).view(np.uint64)
        # keys are distinct in 128 bits; one of two with equal lower halves would never get a slot, so they are told apart first
        keys = lo ^ (pdf["hi"].to_numpy(np.int64).view(np.uint64) >> np.uint64(7))
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two line hashes collide in 64 bits; use another hash seed")
        mph = PerfectHash.build(keys)
        at = mph.index(keys)
        prints, n, last = (np.empty(len(keys), "<i8") for _ in range(3))
        prints[at], n[at], last[at] = pdf["hi"], pdf["n_docs"], pdf["last_id"]
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "mph": [mph.dump()], "prints": [prints.tobytes()], "n_docs": [n.tobytes()], "last_ids": [last.tobytes()]})

    dealt = counts.withColumn("shard", F.pmod(F.col("lo"), F.lit(n_shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, mph binary, prints binary, n_docs binary, last_ids binary")


def probes(docs, min_chars, n_shards, n_salts):
    """Per document and shard, the distinct line hashes packed as (lo, hi) pairs."""

    def pack(batch):
        out = {k: [] for k in ("shard", "salt", "doc_id", TEXT_KEY, "pairs")}
        for doc, text_key, text in zip(batch.column("doc_id").to_pylist(), batch.column(TEXT_KEY).to_pylist(), batch.column("text")):
            keys = set(keys_of(text.as_py(), min_chars)) - {None}
            if not keys:
                continue
            pairs = np.array([line_hash(k) for k in keys], np.int64)
            shard = pairs[:, 0] % n_shards
            for s in np.unique(shard).tolist():
                out["shard"].append(s)
                out["salt"].append(text_key % n_salts)
                out["doc_id"].append(doc)
                out[TEXT_KEY].append(text_key)
                out["pairs"].append(pairs[shard == s].tobytes())
        return out

    return arrow_map(docs, pack, f"shard int, salt int, doc_id long, {TEXT_KEY} long, pairs binary")


def look_up(shards, asked, n_salts, parts):
    """(doc_id, text key, pairs) of the asked lines that must leave their document."""
    names = ["mph", "prints", "last_ids"]
    nothing = [F.lit(None).cast("binary").alias(c) for c in names]
    arrays = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias(TEXT_KEY), F.lit(None).cast("binary").alias("pairs"), *names)
    both = arrays.unionByName(asked.select("shard", "salt", F.lit(1).alias("kind"), "doc_id", TEXT_KEY, "pairs", *nothing))
    dealt = both.repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches):
        held, place = None, None
        for batch in batches:
            rows = batch.select(["shard", "salt", "kind"]).to_pydict()
            where = list(zip(rows["shard"], rows["salt"]))
            start = 0
            while start < batch.num_rows:
                if rows["kind"][start] == 0:
                    mph, prints, last = (batch.column(c)[start].as_py() for c in names)
                    held, place = (PerfectHash.load(mph), np.frombuffer(prints, "<i8"), np.frombuffer(last, "<i8")), where[start]
                    start += 1
                    continue
                end = start
                while end < batch.num_rows and where[end] == where[start] and rows["kind"][end] == 1:
                    end += 1
                if held is not None and place == where[start]:
                    yield from answer(batch.slice(start, end - start), *held)
                start = end

    def answer(batch, mph, prints, last):
        blobs = batch.column("pairs").to_pylist()
        size = np.array([len(b) // 16 for b in blobs])
        pairs = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
        lo, hi = pairs[:, 0].copy().view(np.uint64), pairs[:, 1].copy()
        at = mph.index(lo ^ (hi.view(np.uint64) >> np.uint64(7)))
        docs = batch.column("doc_id").fill_null(LOWEST).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(size)), size)
        known = np.maximum(at, 0)
        gone = (at >= 0) & (prints[known] == hi) & (last[known] > docs[owner])
        rows = np.unique(owner[gone])
        if len(rows):
            cut = np.searchsorted(owner[gone], rows)
            parts_ = np.split(pairs[gone], cut[1:])
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([picked.column("doc_id"), picked.column(TEXT_KEY), pa.array([p.tobytes() for p in parts_], pa.binary())], names=["doc_id", TEXT_KEY, "pairs"])

    return dealt.mapInArrow(run, f"doc_id long, {TEXT_KEY} long, pairs binary")


def lines_to_drop(docs, min_chars=20, min_docs=3):
    """(doc_id, text key, packed line hashes to drop), one row per distinct document that loses lines."""
    spark = docs.sparkSession
    rows = keyed(docs)
    counts = stored(line_counts(rows, min_chars, min_docs), "line-counts")
    n_shards = max(1, -(-counts.count() // SHARD_KEYS))
    parts = shuffle_parts(spark)
    n_salts = max(1, 2 * parts // n_shards)
    shards = stored(build_shards(counts, n_shards), "line-shards")
    found = look_up(shards, probes(rows, min_chars, n_shards, n_salts), n_salts, max(parts, n_shards))
    # repeated rows ask the same question and get the same answer
    return found.groupBy("doc_id", TEXT_KEY).agg(F.collect_set("pairs").alias("pairs"))


def _kept(text, blobs, min_chars):
    """(kept text, lines before, lines dropped)"""
    lines = (text or "").encode("utf-8").split(b"\n")
    if not blobs:
        return text or "", len(lines), 0
    gone = set(map(tuple, np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2).tolist()))
    keys = [line_key(x, min_chars) for x in lines]
    stay = [x for x, k in zip(lines, keys) if k is None or line_hash(k) not in gone]
    return b"\n".join(stay).decode("utf-8"), len(lines), len(lines) - len(stay)


def drop_common_lines(docs, min_chars=20, min_docs=3):
    """``docs`` with every text cleared of its common lines, plus n_lines, n_dropped and kept_sha256."""
    from pyspark.sql import types as T

    gone = lines_to_drop(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "_gone_id", TEXT_KEY: "_gone_key", "pairs": "_pairs"})
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    text_key = F.xxhash64(F.col("text").cast("string"))
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & (text_key == F.col("_gone_key")), "left").drop("_gone_id", "_gone_key")

    names = docs.columns

    def run(batch):
        texts, pairs = batch.column("text").cast(pa.string()), batch.column("_pairs")
        done = [_kept(t.as_py(), p.as_py(), min_chars) for t, p in zip(texts, pairs)]
        cols = {name: batch.column(i) for i, name in enumerate(names)}
        return cols | {"text": [d[0] for d in done], "n_lines": [d[1] for d in done], "n_dropped": [d[2] for d in done], "kept_sha256": [hashlib.sha256(d[0].encode()).hexdigest() for d in done]}

    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    return arrow_map(joined, run, T.StructType(fields + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
