"""Benchmark decontamination by winnowing.

Words are hashed to 64 bits. Of every ``window`` consecutive words the smallest hash of its k-word grams is a
fingerprint, so each sufficiently long passage that a document shares with a benchmark item yields a common fingerprint
at the same place. Fingerprints of documents pass a bitmap of fixed size made from the benchmark's (false passes only
cost a row), are joined with the benchmark's on the fingerprint, and extended word by word to both sides; what covers a
whole window is a hit. Items shorter than a window are one window of their own length and have the hash of all
their words as fingerprint.

The benchmark side of the join is repeated over ``SALTS`` and document rows are dealt over them, so a passage that a
third of all documents hold does not meet in one task. Nothing is paired within a document group.

Defined cases: null and empty texts have no words; items without words have no window; documents are known by id and
text, so repeated rows get equal results and a missing id is a value of its own; ties between equal grams keep all of
them; repeated items each count; texts are read whole; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortspark.llm.common import TEXT_KEY, arrow_map, keyed, row_chunks, stored
from cohortspark.llm.tokens import runs, winnowed, word_table

WINDOW, GRAM = 10, 5
SALTS = 16
#: Bits of the bitmap, the same at every size (4 MB).
FILTER_BITS = 2**25


def _context(words, at, row_start, row_end, before, after):
    """Rows of word hashes around each place, 0 beyond the text."""
    place = at[:, None] + np.arange(-before, after)
    inside = (place >= row_start[:, None]) & (place < row_end[:, None])
    return np.where(inside, words[np.where(inside, place, 0)], np.uint64(0))


def fingerprints(words, off, short, window=WINDOW, k=GRAM):
    """Of all rows at once: (fingerprints, their words' places, rows, lengths). Winnowed grams have length 0; whole
    windows of the lengths in ``short`` have theirs."""
    prints, at, row, length = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ends = off[1:][owner] if len(owner) else owner
    size = np.diff(off)

    def put(g, places, n):
        prints.append(g[places])
        at.append(places)
        row.append(owner[places])
        length.append(np.full(len(places), n))

    if len(words) >= window:
        g = runs(words, k)
        inside = np.arange(len(g)) + k <= ends[:len(g)]
        g = np.where(inside, g, np.uint64(2**64 - 1))  # grams across rows are never the smallest of a window within a row
        places = winnowed(g, window - k + 1)
        put(g, places[inside[places] & (size[owner[places]] >= window)], 0)
    for n in short:
        g = runs(words, n) ^ np.uint64(1)
        put(g, np.flatnonzero(np.arange(len(g)) + n <= ends[:len(g)]), n)
    return tuple(np.concatenate(x) for x in (prints, at, row, length))


def benchmark_prints(benchmark, window=WINDOW, k=GRAM):
    """(print, item_id, length, context): one row per fingerprint of an item."""

    def run(batch):
        words, off, *_ = word_table(batch.column("text"), "alnum")
        size = np.diff(off)
        short = sorted(set(size[(size > 0) & (size < window)].tolist()))
        g, at, row, n = fingerprints(words, off, short, window, k)
        mine = np.flatnonzero((n == 0) | (n == size[row]))
        g, at, row, n = g[mine], at[mine], row[mine], n[mine]
        ctx = _context(words, at, off[row], off[row + 1], window - k, window)
        return {"print": g.view(np.int64), "item_id": batch.column("item_id").take(pa.array(row)), "length": n, "context": [c.tobytes() for c in ctx]}

    return arrow_map(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), run, "print long, item_id long, length int, context binary")


def print_filter(prints):
    """The bitmap as bytes: at most FILTER_BITS bits reach the driver, whatever the benchmark's size."""
    bit = F.pmod(F.col("print"), F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    rows = prints.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        start = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[start:start + len(part)] = part
    return out


def document_prints(rows, bits, short, window=WINDOW, k=GRAM):
    """Per document one row with its number of words (length -1), and one per fingerprint that passes the filter."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(bits)

    def run(batch):
        held = sent.value
        for part in row_chunks(batch, 1_000_000):
            words, off, *_ = word_table(part.column("text"), "alnum")
            size = np.diff(off)
            rows_ = np.arange(part.num_rows)
            none = np.zeros(part.num_rows, np.int64)
            yield {"doc_id": part.column("doc_id"), TEXT_KEY: part.column(TEXT_KEY), "n_words": size, "print": none, "at": none, "length": none - 1, "context": pa.nulls(len(rows_), pa.binary())}
            g, at, row, n = fingerprints(words, off, short, window, k)
            bit = np.mod(g.view(np.int64), FILTER_BITS)
            ok = np.flatnonzero((held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            if len(ok):
                g, at, row, n = g[ok], at[ok], row[ok], n[ok]
                ctx = _context(words, at, off[row], off[row + 1], window - k, window)
                take = pa.array(row)
                yield {"doc_id": part.column("doc_id").take(take), TEXT_KEY: part.column(TEXT_KEY).take(take), "n_words": size[row], "print": g.view(np.int64), "at": at - off[row], "length": n, "context": [c.tobytes() for c in ctx]}

    return arrow_map(rows, run, f"doc_id long, {TEXT_KEY} long, n_words long, print long, at int, length int, context binary")


def extended(joined, window=WINDOW, k=GRAM):
    """(doc_id, text key, item_id, lo, hi): the words [lo, hi) of the document that windows of the item cover."""
    reach = window - k

    def run(batch):
        n = batch.num_rows
        mine, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(n, reach + window) for c in ("context", "item_context"))
        at, length = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "length"))
        same = (mine == theirs) & (mine != 0)
        left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
        right = np.cumprod(same[:, reach:], axis=1).sum(axis=1)
        short = length > 0
        left[short] = 0
        right = np.where(short, np.minimum(right, length), right)
        hit = np.where(short, right == length, left + right >= window)
        keep = np.flatnonzero(hit)
        picked = batch.take(pa.array(keep))
        return {"doc_id": picked.column("doc_id"), TEXT_KEY: picked.column(TEXT_KEY), "item_id": picked.column("item_id"), "lo": (at - left)[keep], "hi": (at + right)[keep]}

    return arrow_map(joined, run, f"doc_id long, {TEXT_KEY} long, item_id long, lo long, hi long")


def contamination(docs, benchmark, window=WINDOW, k=GRAM):
    """One row per document row: doc_id, text key, n_words, n_hit, items (sorted ids as text), contaminated."""
    items = stored(benchmark_prints(benchmark, window, k), "benchmark-prints")
    short = sorted(r[0] for r in items.where("length > 0").select("length").distinct().collect())  # at most window - 1 lengths
    found = stored(document_prints(keyed(docs), print_filter(items), short, window, k), "document-prints")
    base = found.where("length = -1").select("doc_id", TEXT_KEY, "n_words")
    mine = found.where("length >= 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", TEXT_KEY), F.lit(SALTS)).cast("int"))
    theirs = items.select("print", "item_id", "length", F.col("context").alias("item_context"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = mine.join(theirs, ["print", "length", "salt"]).select("doc_id", TEXT_KEY, "item_id", "at", "length", "context", "item_context")
    hits = extended(joined, window, k)
    per_doc = hits.groupBy(F.col("doc_id").alias("_hit_id"), F.col(TEXT_KEY).alias("_hit_key")).agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("_spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                          lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(a["end"], s["lo"]))).alias("n"), F.greatest(a["end"], s["hi"]).alias("end")))["n"]
    per_doc = per_doc.withColumn("n_hit", covered).drop("_spans")
    joined = base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["_hit_id"]) & (base[TEXT_KEY] == per_doc["_hit_key"]), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return joined.select("doc_id", TEXT_KEY, "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs, benchmark, window=WINDOW, k=GRAM):
    """The documents without any window of the benchmark, with their columns as they are."""
    hit = contamination(docs, benchmark, window, k).where("contaminated").select(F.col("doc_id").alias("_hit_id"), F.col(TEXT_KEY).alias("_hit_key")).distinct()
    text_key = F.xxhash64(F.col("text").cast("string"))
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(F.col("_hit_id")) & (text_key == F.col("_hit_key")), "left_anti")
