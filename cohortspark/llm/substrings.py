"""Substring dedup by level-wise doubling.

Windows of 50 words go through the levels 13, 25 and 50 (each twice the one before, less the odd word). At a level only
windows count that repeated at the level below; one that does not repeat ends there. Below 50 words, the smallest
gram of every window is the one that is counted, the same in equal windows; counts are combined on the map side, so hot passages
are a few rows. What repeated comes back to the scan as a bitmap of limited size, whose false passes the next level
sorts out. At 50 words, consecutive surviving windows form segments. A segment whose whole text occurs in a smaller
doc_id is decided at once (copies and shared passages end here); only the first holders of segments that share an
anchor with another segment go on window by window. Windows and segments compare by 128-bit hashes.

Defined cases: null and empty texts have no words; a missing doc_id is smaller than any other; rows that repeat a
doc_id are judged each for itself, and do not count as earlier than one another; texts shorter than a window keep all;
long texts are read whole; extra columns stay in ``drop_repeats``.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortspark.llm.blocks import release
from cohortspark.llm.common import TEXT_KEY, arrow_map, keyed, row_chunks, stored
from cohortspark.llm.jaccard import bitmap, in_bitmap
from cohortspark.llm.repeats import Rows, merge_spans
from cohortspark.llm.tokens import word_table

WIDTH = 50
LOWEST = -(2**63)


def levels_of(width):
    """Lengths below the width, each half of the next, down to about 12; at least one."""
    out = []
    while width > 24 or not out:
        width = -(-width // 2)
        out.append(width)
    return out[::-1]


def _rows(part, width):
    words, off, *_ = word_table(part.column("text"), "plain")
    return Rows(words, off, width)


def _tests(sent):
    return [(k, lambda h, held=b, bits=bits: in_bitmap((held.value, bits), h)) for k, b, bits in sent]


def level_counts(rows, width, sent, k):
    """(hash) of the candidate windows' smallest k-grams that occur in two documents or more."""

    def run(batch):
        tests = _tests(sent)
        for part in row_chunks(batch, 1_000_000):
            seq = _rows(part, width)
            anchor, row = seq.anchors(seq.candidates(tests), k)
            docs = part.column("doc_id").fill_null(LOWEST).to_numpy(zero_copy_only=False)
            yield {"hash": anchor.view(np.int64), "doc": docs[row]}

    found = arrow_map(rows, run, "hash long, doc long")
    return found.groupBy("hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least != most").select("hash")


def segment_rows(rows, width, sent):
    """Segments of surviving windows: doc_id, text key, first, last, s1, s2 (name), anchor, windows (packed hashes)."""

    def run(batch):
        tests = _tests(sent)
        for part in row_chunks(batch, 1_000_000):
            seq = _rows(part, width)
            first, last, anchor = seq.segments(seq.candidates(tests), tests[-1][0])
            if not len(first):
                continue
            s1, s2 = seq.names(first, last)
            size = last - first + 1
            at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            w1, w2 = seq.names(at, at)
            both = np.column_stack([w1, w2])
            cuts = np.r_[0, np.cumsum(size)]
            row = seq.row[first]
            base = seq.off[row]
            take = pa.array(row)
            yield {"doc_id": part.column("doc_id").take(take), TEXT_KEY: part.column(TEXT_KEY).take(take), "first": first - base, "last": last - base,
                   "s1": s1, "s2": s2, "anchor": anchor.view(np.int64), "windows": [both[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]}

    return arrow_map(rows, run, f"doc_id long, {TEXT_KEY} long, first long, last long, s1 long, s2 long, anchor long, windows binary")


def repeated_spans(docs, width=WIDTH):
    """(doc_id, text key, spans): per document the word spans [start, end) that earlier documents hold, packed."""
    rows = keyed(docs)
    context = docs.sparkSession.sparkContext
    sent = []
    for k in levels_of(width):
        again = stored(level_counts(rows, width, sent, k), f"repeated-{k}")
        held, bits = bitmap(again, "hash", again.count())
        sent.append((k, context.broadcast(held), bits))
    doc = F.coalesce("doc_id", F.lit(LOWEST))
    segments = stored(segment_rows(rows, width, sent), "segments")
    release(docs.sparkSession)
    first_of = segments.groupBy("s1", "s2").agg(F.min(doc).alias("holder"), F.min("anchor").alias("anchor"))
    first_of = stored(first_of, "segment-holders")
    release(docs.sparkSession)
    # anchors that several different segments share; the rest has nothing to be compared with
    shared = first_of.groupBy("anchor").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x != y").select("anchor", F.lit(True).alias("shared"))
    named = first_of.join(shared, "anchor", "left").select("s1", "s2", "holder", F.coalesce("shared", F.lit(False)).alias("shared"))
    judged = stored(segments.join(named, ["s1", "s2"]), "segments-judged")
    release(docs.sparkSession)
    whole = judged.where(doc > F.col("holder")).select("doc_id", TEXT_KEY, "first", "last")

    def open_windows(batch):
        blobs = batch.column("windows").to_pylist()
        size = np.array([len(b) // 16 for b in blobs])
        names = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
        take = pa.array(np.repeat(np.arange(len(size)), size))
        start = np.r_[0, np.cumsum(size)[:-1]]
        first = batch.column("first").to_numpy(zero_copy_only=False)
        return {"doc_id": batch.column("doc_id").take(take), TEXT_KEY: batch.column(TEXT_KEY).take(take), "at": np.arange(len(names)) + np.repeat(first - start, size), "w1": names[:, 0], "w2": names[:, 1]}

    left = judged.where((doc == F.col("holder")) & F.col("shared")).select("doc_id", TEXT_KEY, "first", "windows")
    windows = arrow_map(left, open_windows, f"doc_id long, {TEXT_KEY} long, at long, w1 long, w2 long")
    first_window = windows.groupBy("w1", "w2").agg(F.min(doc).alias("holder"), F.max(doc).alias("most")).where("holder != most").drop("most")
    single = windows.join(first_window, ["w1", "w2"]).where(doc > F.col("holder")).select("doc_id", TEXT_KEY, F.col("at").alias("first"), F.col("at").alias("last"))
    spans = whole.unionByName(single)
    return spans.groupBy("doc_id", TEXT_KEY).agg(F.collect_list(F.struct("first", F.expr(f"last + {width}").alias("end"))).alias("spans"))


def drop_repeats(docs, width=WIDTH):
    """``docs`` with the repeated words removed from every text (kept words joined by one space), plus n_words,
    n_removed and kept_sha256."""
    from pyspark.sql import types as T

    found = repeated_spans(docs, width).withColumnsRenamed({"doc_id": "_span_id", TEXT_KEY: "_span_key", "spans": "_spans"})
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    text_key = F.xxhash64(F.col("text").cast("string"))
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_span_id")) & (text_key == F.col("_span_key")), "left").drop("_span_id", "_span_key")
    names = docs.columns

    def run(batch):
        cols = {name: batch.column(i) for i, name in enumerate(names)}
        for name in ("text", "n_words", "n_removed", "kept_sha256"):
            cols[name] = []
        for text, spans in zip(batch.column("text").cast(pa.string()), batch.column("_spans")):
            words = (text.as_py() or "").encode("utf-8").split()  # of bytes: exactly the six white-space characters
            gone = np.zeros(len(words) + 1, bool)
            if spans.is_valid:
                flat = spans.values.flatten()
                for a, b in merge_spans(np.column_stack([x.to_numpy(zero_copy_only=False) for x in flat])).tolist():
                    gone[a:b] = True
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if spans.is_valid else b" ".join(words)
            cols["text"].append(kept.decode("utf-8"))
            cols["n_words"].append(len(words))
            cols["n_removed"].append(int(gone.sum()))
            cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return cols

    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    return arrow_map(joined, run, T.StructType(fields + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
