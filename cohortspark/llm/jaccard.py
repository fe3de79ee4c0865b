"""N-gram Jaccard join: R-trees over count vectors, inside blocks that no link can escape.

A document is the set of hashes of its shingles; equal sets are one point. Two sets link when
100 |A and B| >= 90 |A or B|, which means 19 |A and B| >= 9 (|A| + |B|): they differ in at most (|A| + |B|)/19 shingles.

1. *Blocks.* Sizes form classes; within a class the hash range is cut into one group more than two linked sets can
   differ in, so linked sets agree in a whole group. A block is the sets of one class with the same shingles in one
   group. (A set also joins the next class if a larger partner may be there.) Blocks of one set end at once; their
   signatures never leave the first, map-side combined count: a bitmap of the repeated ones stops them at the source.
2. *R-tree.* The points of a block are count vectors: shingles dealt to ``DIMS`` groups by hash. Leaves are packed by
   size and coordinates and keep the largest coordinates of their points; the sum of coordinate minima bounds the
   overlap, first with a leaf, then with its points. Blocks beyond ``BLOCK`` points are cut, and every pair of cuts is
   joined, so that no task holds an unbounded block.
3. *Verification.* The first round walks each block from point to surviving point and asks only for the pairs it walks
   along (a spanning forest, fewer pairs than points). These are compared exactly. The second round asks for all
   surviving pairs that still join different components. Every surviving pair is then in one component or compared.

Components come from repeated contraction of edges to the smallest neighbour; set ids are hashes, so chains halve.
Nothing is collected but two bitmaps of limited size and counts.

Defined cases: null or empty texts have no shingles and are alone; with fewer words than a shingle has, all words are
one shingle; equal sets share a component; a missing doc_id never is the smallest unless all are missing (then the
component is null); repeated rows are equal sets; extra columns are ignored. Sets are known by 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortspark.llm.common import TEXT_KEY, arrow_map, keyed, row_chunks, stored
from cohortspark.llm.tokens import mix, runs, word_table

DIMS = 64
BLOCK = 4096
LEAF = 32
SHINGLE = 3
#: Bits of a bitmap: 16 for each value it holds, within these bounds (the largest is 32 MB).
BITMAP_BITS = (2**16, 2**28)


def class_starts(limit=2**40):
    """Smallest size of each class; sizes below 10 (class 0) link only with equal sets."""
    lo = [1, 10]
    while lo[-1] < limit:
        lo.append(max(lo[-1] + 1, lo[-1] * 5 // 4))
    return np.array(lo)


CLASSES = class_starts()
#: Groups of a class: linked sets of it differ in at most 2 * largest size / 19 shingles.
GROUPS = 2 * (CLASSES[1:] - 1) // 19 + 1


def shingle_sets(column, width=SHINGLE):
    """(hashes sorted within each row and without repeats, first place of each row)."""
    words, off, *_ = word_table(column, "lower")
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    g = runs(words, width)
    inside = np.arange(len(g)) + width <= off[1:][owner[:len(g)]]
    g, rows = g[inside], owner[:len(g)][inside]
    for n in range(1, width):
        few = np.flatnonzero(size == n)
        if len(few):
            whole = runs(words, n)[off[few]]
            g, rows = np.r_[g, whole], np.r_[rows, few]
    by = np.argsort(rows, kind="stable")
    g, rows = g[by], rows[by]
    first = np.searchsorted(rows, np.arange(len(size) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    g, rows = g[new], rows[new]
    return g, np.searchsorted(rows, np.arange(len(size) + 1))


def set_ids(g, first):
    sums = np.r_[np.uint64(0), np.cumsum(mix(g ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def count_vectors(g, first, dims=DIMS):
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = rows * dims + (mix(g) >> np.uint64(40)).astype(np.int64) % dims
    return np.minimum(np.bincount(at, minlength=(len(first) - 1) * dims), 65535).astype(np.uint16).reshape(-1, dims)


def signatures(g, first):
    """(signature, row) for every group of every class a row takes part in; empty groups have signatures too."""
    n = np.diff(first)
    cls = np.searchsorted(CLASSES, n, side="right") - 1
    row = np.arange(len(n))
    takes = [(row[cls >= 1], cls[cls >= 1])]
    up = (n > 0) & (n * 10 // 9 >= CLASSES[cls + 1])
    takes.append((row[up], cls[up] + 1))
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sums = np.r_[np.uint64(0), np.cumsum(mix(g ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)]
    for rows, c in takes:
        if not len(rows):
            continue
        groups = GROUPS[c]
        start = np.r_[0, np.cumsum(groups)]
        size = n[rows]
        place = np.repeat(first[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        mine = np.repeat(np.arange(len(rows)), size)
        grp = ((g[place] >> np.uint64(32)) * groups[mine].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        # groups follow the order of the hashes, so each is a stretch of its row
        counts = np.bincount(start[mine] + grp, minlength=int(start[-1]))
        owner = np.repeat(np.arange(len(rows)), groups)
        ends = np.cumsum(counts)
        shift = (first[rows] - np.r_[0, np.cumsum(size)[:-1]])[owner]
        total = sums[ends + shift] - sums[ends - counts + shift]
        label = (np.arange(int(start[-1])) - start[owner]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c[owner].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        sigs.append(mix(total + mix(label + counts.astype(np.uint64))))
        owners.append(rows[owner])
    return np.concatenate(sigs), np.concatenate(owners)


# -- R-tree of one block ---------------------------------------------------------------------------------------------


class CountTree:
    """Leaves of about LEAF points with the largest coordinates and the smallest size of their points."""

    def __init__(self, vectors, sizes):
        self.v, self.n = vectors.astype(np.int32), sizes
        top = np.argsort(-self.v.var(axis=0), kind="stable")[:2] if len(sizes) > LEAF else np.zeros(2, np.int64)
        slab = max(1, int(np.sqrt(-(-len(sizes) // LEAF)))) * LEAF
        order = np.argsort(sizes, kind="stable")
        order = np.concatenate([s[np.lexsort((self.v[s, top[1]], self.v[s, top[0]]))] for s in np.split(order, np.arange(slab, len(order), slab))]) if len(order) else order
        self.leaves = np.split(order, np.arange(LEAF, len(order), LEAF)) if len(order) else []
        self.high = np.array([self.v[leaf].max(axis=0) for leaf in self.leaves]).reshape(-1, vectors.shape[1])
        self.least = np.array([sizes[leaf].min() for leaf in self.leaves], np.int64)

    def partners(self, vector, size, open_):
        """Open points whose overlap with the vector may reach a link."""
        bound = np.minimum(self.high, vector).sum(axis=1)
        hits = np.flatnonzero(19 * bound >= 9 * (size + self.least))
        if not len(hits):
            return hits
        points = np.concatenate([self.leaves[i] for i in hits])
        points = points[open_[points]]
        bound = np.minimum(self.v[points], vector).sum(axis=1)
        return points[19 * bound >= 9 * (size + self.n[points])]


def walk(ids, vectors, sizes, side):
    """Pairs (i, j) of a spanning forest over the surviving pairs; with two sides, over pairs across them."""
    if len(ids) == 2:
        ok = 19 * np.minimum(vectors[0].astype(np.int64), vectors[1]).sum() >= 9 * (sizes[0] + sizes[1])
        return [(0, 1)] if ok and (side is None or side[0] != side[1]) else []
    tree = CountTree(vectors, sizes)
    open_ = np.ones(len(ids), bool)
    pairs = []
    for root in np.argsort(ids, kind="stable").tolist():
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            found = tree.partners(tree.v[at], sizes[at], open_ if side is None else open_ & (side != side[at]))
            open_[found] = False
            pairs += [(at, j) for j in found.tolist()]
            queue += found.tolist()
    return pairs


def crossing(ids, vectors, sizes, side, component):
    """All surviving pairs between different components (and sides)."""
    tree = CountTree(vectors, sizes)
    pairs = []
    for at in range(len(ids)):
        open_ = (component != component[at]) & (ids > ids[at])
        if side is not None:
            open_ = open_ & (side != side[at])
        if open_.any():
            pairs += [(at, j) for j in tree.partners(tree.v[at], sizes[at], open_).tolist()]
    return pairs


def block_pairs(members, spanning):
    """(a, b) candidate pairs of the blocks in ``members`` (sig, set_id, n, vector, component, n_members)."""
    cuts = F.ceil(F.col("n_members") / BLOCK).cast("int")
    cut = F.pmod(F.xxhash64("set_id"), cuts).cast("int")
    dealt = (members.withColumn("cut", cut).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
             .withColumn("c1", F.least("cut", "other")).withColumn("c2", F.greatest("cut", "other"))
             .select("sig", "c1", "c2", "cut", "set_id", "n", "vector", "component"))
    ordered = dealt.repartition("sig", "c1", "c2").sortWithinPartitions("sig", "c1", "c2", "set_id")

    def solve(t):
        ids, sizes = t["set_id"], t["n"]
        vectors = np.frombuffer(b"".join(t["vector"]), np.uint16).reshape(-1, DIMS)
        side = None if t["c1"][0] == t["c2"][0] else t["cut"]
        pairs = walk(ids, vectors, sizes, side) if spanning else crossing(ids, vectors, sizes, side, t["component"])
        return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in pairs]

    def run(batches):
        held = None
        names = ["sig", "c1", "c2", "cut", "set_id", "n", "component"]

        def emit(pairs):
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            t["vector"] = np.array(batch.column("vector").to_pylist(), object)
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            key = np.flatnonzero(np.r_[True, (t["sig"][1:] != t["sig"][:-1]) | (t["c1"][1:] != t["c1"][:-1]) | (t["c2"][1:] != t["c2"][:-1])])
            pairs = []
            for a, b in zip(key[:-1].tolist(), key[1:].tolist()):
                if b - a > 1:
                    pairs += solve({c: x[a:b] for c, x in t.items()})
            held = {c: x[key[-1]:] for c, x in t.items()}
            yield from emit(pairs)
        if held is not None and len(held["sig"]) > 1:
            yield from emit(solve(held))

    return ordered.mapInArrow(run, "a long, b long").distinct()


# -- Spark steps -----------------------------------------------------------------------------------------------------


def bitmap(values, column, count):
    """(bytes, bits) of the hashes in ``column``."""
    bits = BITMAP_BITS[0]
    while bits < min(16 * count, BITMAP_BITS[1]):
        bits *= 2
    bit = F.pmod(F.col(column), F.lit(bits)) + 1
    rows = values.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[:len(out)]
        out[(r["bucket"] - 1) * 4096:][:len(part)] = part
    return out, bits


def in_bitmap(held, values):
    data, bits = held
    bit = values & (bits - 1)
    return (data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def base_rows(rows):
    """(doc_id, text key, n_shingles, set_id) of every row; set_id is null for empty sets."""

    def run(batch):
        for part in row_chunks(batch, 1_000_000):
            g, first = shingle_sets(part.column("text"))
            n = np.diff(first)
            yield {"doc_id": part.column("doc_id"), TEXT_KEY: part.column(TEXT_KEY), "n": n, "set_id": pa.array(set_ids(g, first), mask=n == 0)}

    return arrow_map(rows, run, f"doc_id long, {TEXT_KEY} long, n long, set_id long")


def signature_rows(rows, known=None):
    """(sig, set_id) of every row; with a bitmap only the signatures in it, with sizes and count vectors."""
    sent = known and (rows.sparkSession.sparkContext.broadcast(known[0]), known[1])

    def run(batch):
        for part in row_chunks(batch, 1_000_000):
            g, first = shingle_sets(part.column("text"))
            sig, row = signatures(g, first)
            ids = set_ids(g, first)
            if sent is None:
                # equal sets of a chunk have equal signatures: one is enough to count
                lone = np.zeros(len(ids), bool)
                lone[np.unique(ids, return_index=True)[1]] = True
                sig, row = sig[lone[row]], row[lone[row]]
                yield {"sig": sig.view(np.int64), "set_id": ids[row]}
                continue
            ok = in_bitmap((sent[0].value, sent[1]), sig.view(np.int64))
            sig, row = sig[ok], row[ok]
            vectors = count_vectors(g, first)
            raw = [v.tobytes() for v in vectors]
            yield {"sig": sig.view(np.int64), "set_id": ids[row], "n": np.diff(first)[row], "vector": [raw[i] for i in row.tolist()]}

    return arrow_map(rows, run, "sig long, set_id long" + (", n long, vector binary" if known else ""))


def set_rows(rows, known):
    """(set_id, shingles) of the sets in the bitmap."""
    sent = (rows.sparkSession.sparkContext.broadcast(known[0]), known[1])

    def run(batch):
        for part in row_chunks(batch, 1_000_000):
            g, first = shingle_sets(part.column("text"))
            ids = set_ids(g, first)
            wanted = np.flatnonzero(in_bitmap((sent[0].value, sent[1]), ids) & (np.diff(first) > 0))
            yield {"set_id": ids[wanted], "shingles": [g[first[i]:first[i + 1]].tobytes() for i in wanted.tolist()]}

    return arrow_map(rows, run, "set_id long, shingles binary")


def verified(pairs, sets):
    """The pairs that link."""
    left = pairs.join(sets.withColumnsRenamed({"set_id": "a", "shingles": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"set_id": "b", "shingles": "sb"}), "b")

    def run(batch):
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            if 19 * int((y[at] == x).sum()) >= 9 * (len(x) + len(y)):
                keep.append(i)
        got = batch.take(pa.array(keep, pa.int64()))
        return {"a": got.column("a"), "b": got.column("b")}

    return arrow_map(both, run, "a long, b long")


def components(edges):
    """(v, root) for every vertex of the edges; root is the smallest vertex a contraction reached."""
    spark = edges.sparkSession
    labels = None
    edges = stored(edges.select("a", "b").where("a != b"), "edges")
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        parent = stored(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p")), "parents")
        if labels is None:
            labels = parent.select("v", F.col("p").alias("root"))
        else:
            moved = parent.withColumnsRenamed({"v": "root"})
            labels = stored(labels.join(moved, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
        a, b = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = stored(edges.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a != b").distinct(), "edges")
    if labels is None:
        labels = spark.createDataFrame([], "v long, root long")
    return labels


def near_classes(docs):
    """One row per document row: doc_id, text key, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows = keyed(docs)
    base = stored(base_rows(rows), "jaccard-base")
    counted = signature_rows(rows).groupBy("sig").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most"))
    repeated = stored(counted.where("least != most").select("sig"), "repeated-signatures")
    held = bitmap(repeated, "sig", repeated.count())
    members = signature_rows(rows, held).dropDuplicates(["sig", "set_id"])
    members = stored(members, "block-members")
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    members = stored(members.join(sizes, "sig").withColumn("component", F.col("set_id")), "blocks")
    involved = stored(members.select("set_id").distinct(), "involved-sets")
    sets = stored(set_rows(rows, bitmap(involved, "set_id", involved.count())).join(involved, "set_id", "left_semi").dropDuplicates(["set_id"]), "shingle-sets")
    asked = stored(block_pairs(members, spanning=True), "walked-pairs")
    links = stored(verified(asked, sets), "links")
    labels = components(links)
    named = labels.withColumnsRenamed({"v": "set_id", "root": "r"})
    # blocks that still hold several components
    now = members.drop("component").join(named, "set_id", "left").withColumn("component", F.coalesce("r", "set_id")).drop("r")
    now = stored(now, "blocks-labelled")
    open_ = now.groupBy("sig").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("sig")
    rest = block_pairs(now.join(open_, "sig", "left_semi"), spanning=False).join(asked, ["a", "b"], "left_anti")
    more = stored(verified(stored(rest, "crossing-pairs"), sets), "links")
    labels = components(links.unionByName(more)).withColumnsRenamed({"v": "set_id", "root": "r"})
    placed = base.join(labels, "set_id", "left").withColumn("component", F.coalesce("r", "set_id"))
    placed = stored(placed.select("doc_id", TEXT_KEY, "n", "component"), "placed")
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "component", "left")
    return out.select("doc_id", TEXT_KEY, F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs):
    """The documents without their near duplicates: of each component the smallest doc_id stays (repeated rows of it
    too, unless they are copies of one another: then one row). Empty texts and ids that are missing all stay."""
    classes = near_classes(docs).where("component_id IS NOT NULL AND (doc_id IS NULL OR doc_id != component_id)")
    gone = classes.select(F.col("doc_id").alias("_gone_id"), F.col(TEXT_KEY).alias("_gone_key")).distinct()
    text_key = F.xxhash64(F.col("text").cast("string"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & (text_key == F.col("_gone_key")), "left_anti")
