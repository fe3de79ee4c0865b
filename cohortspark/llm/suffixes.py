"""Suffix-array dedup: hash-compared suffix sort of the texts' repeated parts.

A 100-byte string can only repeat if the smallest 32-gram in it does. A map-side combined count finds these anchors; a
bitmap of limited size takes them back to the scan, where consecutive windows with repeated anchors form segments. A
segment whose whole text stands earlier (smaller doc_id, or the same document earlier) is decided at once. The suffixes
of the other segments that share an anchor with a different segment, or overlap themselves, are sorted:

* ``sort_suffixes`` is a mergesort whose comparisons find the common extension of two suffixes by binary search over
  prefix polynomial hashes (logarithmic in the length); all comparisons of a merge level run at once in numpy.
* Neighbours that share 100 bytes by hash are compared byte by byte (collision verification) and form classes.

Equal strings share their anchor, so segments are dealt by anchor and a class of one block is final: what it removes
leaves the block as runs of places, not window by window. An anchor with more than ``CROWD`` open windows is dealt over several blocks; its classes meet again by the 128-bit hash of their 100
bytes, one row per block and class, so a string that a third of all documents hold is a row per block. Their strings
with one place in a block leave it as runs with packed hashes; only those travel whose hash a count finds in several blocks (a bitmap tells). The earliest
holder of a class keeps it, all others lose it.

Defined cases: null and empty texts have no bytes; a missing doc_id is smaller than any other; rows that repeat a
doc_id with another text are ordered by the hash of the text, equal rows are one; texts shorter than a window keep all;
long texts are read whole; extra columns stay in ``drop_repeated_bytes``. Removing bytes may cut a character: the text
column leaves broken characters out, the digest is of the bytes themselves.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

from cohortspark.llm.blocks import release
from cohortspark.llm.common import TEXT_KEY, arrow_map, keyed, row_chunks, stored, utf8
from cohortspark.llm.jaccard import bitmap, in_bitmap
from cohortspark.llm.repeats import Rows, merge_spans
from cohortspark.llm.tokens import Prefix, byte_values, inverse, powers, slide

WIDTH, GRAM = 100, 32
LEVELS = (GRAM,)
LOWEST = -(2**63)
PLACE = ("doc", TEXT_KEY, "at")
#: Suffixes sorted together (a block ends with the anchor in which it reaches them), and those of one anchor in a block.
BLOCK, CROWD = 150_000, 120_000


# -- the sort --------------------------------------------------------------------------------------------------------


def common_extension(prefix, a, b, limit):
    """Length of the common prefix of the suffixes at a and b, up to ``limit``: binary search over hash equality."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    sums, scale = prefix.sums, powers(len(prefix.sums), inverse(prefix.base))
    sum_a, sum_b, scale_a, scale_b = sums[a], sums[b], scale[a], scale[b]
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = (sums[a + mid] - sum_a) * scale_a == (sums[b + mid] - sum_b) * scale_b
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def less(data, prefix, a, b, limit):
    """Whether suffix a comes before suffix b, which differs from it within ``limit`` bytes."""
    ext = common_extension(prefix, a, b, limit)
    return data[a + ext] < data[b + ext]


def sort_suffixes(data, starts, limit):
    """(starts in the order of their first ``limit`` bytes, whether each equals the one before it).

    Runs begin with the order of the first eight bytes; groups of equal beginnings are merged bottom-up, where suffixes
    that agree in ``limit`` bytes by hash are compared and moved as one. At each level every suffix finds its rank in the
    sibling run by binary search. ``data`` holds ``limit`` bytes after each start."""
    if not len(starts):
        return starts, np.zeros(0, bool)
    prefix = Prefix(byte_values(11)[data])
    head = sliding_window_view(data, 8)[starts].view(">u8").ravel().astype(np.uint64)
    whole = prefix.of(starts, starts + limit)
    by = np.lexsort((whole, head))
    order, head, whole = starts[by], head[by], whole[by]
    opens = np.ones(len(order), bool)  # the first of each group of equal beginnings
    opens[1:] = head[1:] != head[:-1]
    apart = opens.copy()
    apart[1:] |= whole[1:] != whole[:-1]
    lead = np.flatnonzero(apart)  # the first of each set of suffixes that move as one
    alone, copies = order[lead], np.diff(np.r_[lead, len(order)])
    group = np.cumsum(opens[lead]) - 1
    begin = np.flatnonzero(opens[lead])
    size = np.diff(np.r_[begin, len(group)])
    turn = np.arange(len(lead))  # the order of the sets
    width = 1
    while (size > width).any():
        at = np.flatnonzero(np.repeat(size > width, size))  # groups that are one run stay as they are
        base, end = begin[group[at]], begin[group[at]] + size[group[at]]
        run = (at - base) // width
        other = base + (run ^ 1) * width
        low = np.minimum(other, end)
        high = np.minimum(other + width, end)
        first = low.copy()
        now = alone[turn]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            before = less(data, prefix, now[mid], now[at[open_]], limit)
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        own = at - (base + run * width)
        target = base + (run & ~1) * width + own + (low - first)
        merged = turn.copy()
        merged[target] = turn[at]
        turn = merged
        width *= 2
    copies, lead = copies[turn], lead[turn]
    shift = np.arange(len(order)) - np.repeat(np.r_[0, np.cumsum(copies)[:-1]], copies)
    order = order[np.repeat(lead, copies) + shift]
    same = shift > 0
    alike, view = np.flatnonzero(same), sliding_window_view(data, limit)
    for cut in range(0, len(alike), 20_000):  # collision verification, byte by byte
        some = alike[cut:cut + 20_000]
        if (view[order[some - 1]] != view[order[some]]).any():
            raise ValueError("prefix hashes collide; sort this block with another seed")
    return order, same


# -- Spark steps -----------------------------------------------------------------------------------------------------


def _rows(part):
    data, off = utf8(part.column("text"))
    return Rows(byte_values(5)[data], off, WIDTH), data


def _places(seq, ok, k):
    """Places of the smallest k-grams of the windows in ``ok``, each once, with all ties."""
    g = seq.grams(k)
    if not ok.any():
        return g, np.zeros(0, np.int64)
    low = np.where(ok, seq.smallest(k), np.uint64(0))
    pad = np.zeros(WIDTH - k, np.uint64)
    return g, np.flatnonzero(slide(np.r_[pad, low, pad], WIDTH - k + 1, np.maximum) == g)


def _tests(sent):
    return [(k, lambda h, held=held, bits=bits: in_bitmap((held.value, bits), h)) for k, held, bits in sent]


def repeated_anchors(rows, sent, k):
    """(hash) of the smallest k-grams of candidate windows that stand in two places or more."""

    def run(batch):
        tests = _tests(sent)
        for part in row_chunks(batch, 120_000):
            seq, _ = _rows(part)
            g, places = _places(seq, seq.candidates(tests), k)
            yield {"hash": g[places].view(np.int64)}

    return arrow_map(rows, run, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")


def segment_rows(rows, sent, wanted=None):
    """doc_id, text key, first, last, anchor and name (two hashes of 64 bits that tell its text), loops (it overlaps itself); with ``wanted`` (bitmaps of
    anchors and of places) only those segments, with the bytes they cover."""
    pick = wanted and [(rows.sparkSession.sparkContext.broadcast(held), bits) for held, bits in wanted]

    def run(batch):
        tests = _tests(sent)
        for part in row_chunks(batch, 120_000):
            seq, data = _rows(part)
            ok = seq.candidates(tests)
            first, last, anchor = seq.segments(ok, GRAM)
            if pick is not None and len(first):
                (anchors, a_bits), (places, p_bits) = [(held.value, bits) for held, bits in pick]
                mine = np.flatnonzero(in_bitmap((anchors, a_bits), anchor.view(np.int64)))
                row = seq.row[first[mine]]
                doc = part.column("doc_id").fill_null(LOWEST).to_numpy()[row]
                at = part.column(TEXT_KEY).to_numpy()[row] ^ (first[mine] - seq.off[row]) ^ (doc << 12)  # as in repeated_spans
                mine = mine[in_bitmap((places, p_bits), at)]
                first, last, anchor = first[mine], last[mine], anchor[mine]
            if not len(first):
                continue
            name = seq.names(first, last)[0]
            g, places = _places(seq, ok, GRAM)
            a, b = np.searchsorted(places, first), np.searchsorted(places, last + WIDTH - GRAM, side="right")
            size = b - a
            owner = np.repeat(np.arange(len(first)), size)
            inside = places[np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            loops = np.bincount(owner, weights=g[inside] == anchor[owner], minlength=len(first)) > 1
            row = seq.row[first]
            take, base = pa.array(row), seq.off[row]
            out = {"doc_id": part.column("doc_id").take(take), TEXT_KEY: part.column(TEXT_KEY).take(take), "first": first - base, "last": last - base, "name": name, "anchor": anchor.view(np.int64), "loops": loops}
            if pick is not None:
                raw = data.tobytes()
                out["bytes"] = [raw[x:y] for x, y in zip(first.tolist(), (last + WIDTH).tolist())]
            yield out

    return arrow_map(rows, run, f"doc_id long, {TEXT_KEY} long, first long, last long, name long, anchor long, loops boolean" + (", bytes binary" if wanted else ""))


def _runs(doc, key, at):
    """(doc, text key, first, last) of each run of places that follow one another; the places ascend."""
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (np.diff(at) > 1)
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(at)][:len(start)] - 1
    return doc[start], key[start], at[start], at[end]


def suffix_classes(stretches):
    """What the classes of equal windows of each block tell. Those of an anchor in one block are final: runs of the windows
    that stand earlier too (doc, text key, at, last; ``split`` is false). Those of a split anchor are a row each: w1, w2,
    doc, text key, at (the earliest place), members (packed places); where they have one place in the block, each run of
    such places is a row: doc, text key, at, last, members (packed hashes w1, w2), w1 and w2 are null."""

    def blocks(batches):
        held, n, last = [], 0, None
        for batch in batches:
            group = np.column_stack([batch.column("anchor").to_numpy(), batch.column("salt").to_numpy()])
            sizes = batch.column("last").to_numpy() - batch.column("first").to_numpy() + 1
            new = np.ones(len(group), bool)
            new[1:] = (group[1:] != group[:-1]).any(axis=1)
            new[0] = last is not None and tuple(group[0]) != last
            last = tuple(group[-1])
            start = 0
            for cut in np.r_[np.flatnonzero(new), len(group)].tolist():
                if cut < len(group) and n + int(sizes[start:cut].sum()) < BLOCK:
                    continue
                held.append(batch.slice(start, cut - start))
                n += int(sizes[start:cut].sum())
                start = cut
                if cut < len(group):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if held and sum(h.num_rows for h in held):
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        for table in blocks(batches):
            if not table.num_rows:
                continue
            crowded = table.column("salts").to_numpy() > 1
            doc = table.column("doc").to_numpy()
            key = table.column(TEXT_KEY).to_numpy()
            first, last = table.column("first").to_numpy(), table.column("last").to_numpy()
            blobs = table.column("bytes").to_pylist()
            data = np.frombuffer(b"".join(blobs), np.uint8)
            begin = np.r_[0, np.cumsum([len(b) for b in blobs])[:-1]]
            size = last - first + 1
            shift = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
            starts = np.repeat(begin, size) + shift
            owner = np.repeat(np.arange(len(size)), size)
            order, same = sort_suffixes(data, starts, WIDTH)
            where = np.searchsorted(starts, order)  # starts ascend
            doc_, key_, at_ = doc[owner[where]], key[owner[where]], (first[owner] + shift)[where]
            heads = np.flatnonzero(~same)
            ends = np.r_[heads[1:], len(order)]
            split = crowded[owner[where[heads]]]
            rank = np.empty(len(order), np.int64)
            by = np.lexsort((at_, key_, doc_))
            rank[by] = np.arange(len(by))
            least = by[np.minimum.reduceat(rank, heads)]
            lead, final = np.repeat(least, ends - heads), np.repeat(~split, ends - heads)
            later = final & ((doc_ != doc_[lead]) | (key_ != key_[lead]) | (at_ != at_[lead]))
            gone = by[later[by]]
            yield told(*_runs(doc_[gone], key_[gone], at_[gone]), False)
            one = np.repeat(split & (ends - heads == 1), ends - heads)
            one = by[one[by]]
            runs = _runs(doc_[one], key_[one], at_[one])
            hashes = np.column_stack([Prefix(byte_values(seed)[data]).of(order[one], order[one] + WIDTH) for seed in (21, 22)])
            yield told(*runs, True, packed(hashes, np.r_[0, np.cumsum(runs[3] - runs[2] + 1)]))
            many = split & (ends - heads > 1)
            heads, ends, least = heads[many], ends[many], least[many]
            w1 = Prefix(byte_values(21)[data]).of(order[heads], order[heads] + WIDTH).view(np.int64)
            w2 = Prefix(byte_values(22)[data]).of(order[heads], order[heads] + WIDTH).view(np.int64)
            places = np.column_stack([doc_, key_, at_]).astype("<i8")
            yield told(doc_[least], key_[least], at_[least], None, True, [places[a:b].tobytes() for a, b in zip(heads.tolist(), ends.tolist())], w1, w2)

    def packed(values, cuts):
        return [values[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def told(doc, key, at, last, split, members=None, w1=None, w2=None):
        none = pa.nulls(len(doc), pa.int64())
        w1, w2, last = [none if x is None else pa.array(x) for x in (w1, w2, last)]
        members = pa.nulls(len(doc), pa.binary()) if members is None else pa.array(members, pa.binary())
        return pa.RecordBatch.from_arrays([w1, w2, pa.array(doc), pa.array(key), pa.array(at), last, members, pa.array(np.full(len(doc), split))], names=names)

    names = ["w1", "w2", "doc", TEXT_KEY, "at", "last", "members", "split"]
    dealt = stretches.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(run, f"w1 long, w2 long, doc long, {TEXT_KEY} long, at long, last long, members binary, split boolean")


def split_strings(split, several=None):
    """w1 of every string of the split classes, once for each block. With ``several`` (a bitmap of w1) the classes: w1, w2,
    doc, text key, at, members of those with several places, and of those with one place whose hash it holds."""
    held, bits = (split.sparkSession.sparkContext.broadcast(several[0]), several[1]) if several else (None, 0)

    def run(batch):
        alone = batch.column("w1").is_null()
        sets, runs = batch.filter(pc.invert(alone)), batch.filter(alone)
        hashes = np.frombuffer(b"".join(runs.column("members").to_pylist()), np.int64).reshape(-1, 2)
        if held is None:
            return {"w1": np.r_[sets.column("w1").to_numpy(zero_copy_only=False).astype(np.int64), hashes[:, 0]]}
        first, last = runs.column("at").to_numpy(), runs.column("last").to_numpy(zero_copy_only=False).astype(np.int64)
        size = last - first + 1
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]][:len(size)], size)
        mine = np.flatnonzero(in_bitmap((held.value, bits), hashes[:, 0]))
        row, at, hashes = pa.array(row[mine]), at[mine], hashes[mine]
        cols = {"w1": hashes[:, 0], "w2": hashes[:, 1], "doc": runs.column("doc").take(row), TEXT_KEY: runs.column(TEXT_KEY).take(row), "at": at, "members": pa.nulls(len(at), pa.binary())}
        return {c: pa.concat_arrays([sets.column(c), x if isinstance(x, pa.Array) else pa.array(x)]) for c, x in cols.items()}

    return arrow_map(split, run, "w1 long" + (f", w2 long, doc long, {TEXT_KEY} long, at long, members binary" if several else ""))


def repeated_spans(docs):
    """(doc_id, text key, spans): per document the byte spans [first, end) that also stand earlier."""
    rows = keyed(docs)
    context, sent = docs.sparkSession.sparkContext, []
    for k in LEVELS:
        again = stored(repeated_anchors(rows, sent, k), f"repeated-{k}")
        held, bits = bitmap(again, "hash", again.count())
        sent.append((k, context.broadcast(held), bits))
    doc = F.coalesce("doc_id", F.lit(LOWEST))
    segments = stored(segment_rows(rows, sent), "byte-segments")
    place = F.struct(doc.alias("doc"), TEXT_KEY, "first")
    first_of = segments.groupBy("anchor", "name").agg(F.min(place).alias("holder"), F.max("loops").alias("loops"), F.max(F.expr("last - first + 1")).alias("windows"))
    shared = first_of.groupBy("anchor").agg(F.min("name").alias("x"), F.max("name").alias("y")).where("x != y").select("anchor", F.lit(True).alias("shared"))
    named = first_of.join(shared, "anchor", "left").select("anchor", "name", "holder", "windows", (F.coalesce("shared", F.lit(False)) | F.col("loops")).alias("open"))
    named = stored(named, "segments-named")
    whole = segments.join(named.select("anchor", "name", "holder"), ["anchor", "name"]).where(place > F.col("holder")).select("doc_id", TEXT_KEY, "first", "last")
    crowds = named.where("open").groupBy("anchor").agg(F.ceil(F.sum("windows") / CROWD).cast("int").alias("salts"))
    open_ = stored(named.where("open").join(crowds, "anchor").select("anchor", "name", "holder", "salts"), "open-segments")
    anchors = open_.select("anchor").distinct()
    holders = open_.select(F.col(f"holder.{TEXT_KEY}").bitwiseXOR(F.col("holder.first")).bitwiseXOR(F.shiftleft("holder.doc", 12)).alias("at"))
    wanted = [bitmap(anchors, "anchor", anchors.count()), bitmap(holders, "at", holders.count())]
    texts = segment_rows(rows, sent, wanted).join(open_, ["anchor", "name"]).where(place == F.col("holder"))
    stretches = texts.select("anchor", "name", doc.alias("doc"), TEXT_KEY, "first", "last", "bytes", "salts", F.pmod(F.xxhash64("name"), "salts").cast("int").alias("salt"))
    # one anchor and name to a place: rows that come twice are dropped where the join has put them
    stretches = stretches.dropDuplicates(["anchor", "name", "doc", TEXT_KEY, "first", "last"]).drop("name")
    classes = stored(suffix_classes(stretches), "suffix-classes")
    least = [F.col(f"least.{c}").alias(x) for c, x in zip(PLACE, "dkp")]
    several = stored(split_strings(classes.where("split")).groupBy("w1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1"), "split-strings")
    meeting = stored(split_strings(classes.where("split"), bitmap(several, "w1", several.count())), "split-classes")
    met = meeting.groupBy("w1", "w2").agg(F.min(F.struct(*PLACE)).alias("least"), F.count(F.lit(1)).alias("blocks"))
    split = meeting.join(met, ["w1", "w2"]).where(F.col("members").isNotNull() | (F.col("blocks") > 1)).select("members", *PLACE, *least)
    final = classes.where(~F.col("split")).select(F.nullif("doc", F.lit(LOWEST)).alias("doc_id"), TEXT_KEY, F.col("at").alias("first"), "last")

    def later(batch):
        alone = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in PLACE]).astype("<i8")
        blobs = [b if b is not None else one.tobytes() for b, one in zip(batch.column("members").to_pylist(), alone)]
        size = [len(b) // 24 for b in blobs]
        m = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 3)
        least = np.column_stack([np.repeat(batch.column(c).to_numpy(zero_copy_only=False), size) for c in ("d", "k", "p")])
        gone = m[(m != least).any(axis=1)]
        docs_, key, first, last = _runs(*gone[np.lexsort((gone[:, 2], gone[:, 1], gone[:, 0]))].T)
        return {"doc_id": pa.array(docs_, mask=docs_ == LOWEST), TEXT_KEY: key, "first": first, "last": last}

    spans = whole.unionByName(final).unionByName(arrow_map(split, later, f"doc_id long, {TEXT_KEY} long, first long, last long"))
    return stored(spans.groupBy("doc_id", TEXT_KEY).agg(F.collect_list(F.struct("first", F.expr(f"last + {WIDTH}").alias("end"))).alias("spans")), "repeated-spans")


def drop_repeated_bytes(docs):
    """``docs`` with the repeated bytes removed from every text, plus n_bytes, n_removed, n_spans and kept_sha256."""
    from pyspark.sql import types as T

    found = repeated_spans(docs).withColumnsRenamed({"doc_id": "_span_id", TEXT_KEY: "_span_key", "spans": "_spans"})
    release(docs.sparkSession)  # else those of the spans lie beside the texts' shuffle
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    text_key = F.xxhash64(F.col("text").cast("string"))
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_span_id")) & (text_key == F.col("_span_key")), "left").drop("_span_id", "_span_key")
    names = docs.columns

    def run(batch):
        cols = {name: batch.column(i) for i, name in enumerate(names)} | {name: [] for name in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, spans in zip(batch.column("text").cast(pa.string()), batch.column("_spans")):
            raw = (text.as_py() or "").encode("utf-8")
            kept, removed, n = [], 0, 0
            if spans.is_valid:
                at = 0
                for a, b in merge_spans(np.column_stack([x.to_numpy(zero_copy_only=False) for x in spans.values.flatten()])).tolist():
                    kept.append(raw[at:a])
                    at, removed, n = b, removed + b - a, n + 1
                kept.append(raw[at:])
                left = b"".join(kept)
            else:
                left = raw
            cols["text"].append(left.decode("utf-8", "ignore"))
            cols["n_bytes"].append(len(raw))
            cols["n_removed"].append(removed)
            cols["n_spans"].append(n)
            cols["kept_sha256"].append(hashlib.sha256(left).hexdigest())
        return cols

    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    added = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    return arrow_map(joined, run, T.StructType(fields + added))
