"""Vector code compression: product codes whose distances come from per-dimension value dictionaries.

Components become integers, ``floor(256 * x)``. Vectors are kept as blocks: for each dimension the distinct integers
of the block (its dictionary) and, per vector, the place of its integer in that dictionary. To assign the parts of a
block, the squared differences of every distinct integer to that dimension's component of all codebook entries are
tabulated; a part's distance to every entry is then a sum of table rows, gathered by the dictionary codes. No
difference is taken per vector. Sums for the next codebook come from counts of (entry, dictionary code) times the
dictionary's integers, so they are exact. Blocks are written once and read in every round; only sums of at most
parts * entries * dimensions integers reach the driver.

Dictionaries are per block, so their size is bounded by the block's rows whatever the values are.

Results for the unusual: rows whose vector is null or holds a null or non-finite component are left out. Vectors of
different lengths, or of a length that the number of parts does not divide, raise ValueError. Fewer kept rows than
entries give smaller codebooks; without kept rows the result is empty. Repeated rows are rows of their own; rows with
equal ids seed the codebooks in the order of their vectors, null ids after all others. Equal distances go to the lower
index. Arithmetic is exact: integers beyond 2**20 are computed as Python integers, and an ``error`` or ``label_error``
beyond a long is null. Null labels form one group. Extra columns stay.
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F, types as T

from cohortspark.llm.blocks import map_rows, pack_many, unpack_many
from cohortspark.llm.common import shuffle_parts, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: vectors of one block, at most (an Arrow batch may hold fewer)
BLOCK_ROWS = 8192
_LONG = 2**63 - 1


def usable(vectors, vec_col):
    """Rows whose vector is there and has only finite components."""
    whole = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(vec_col).isNotNull() & whole)


def _integers(flat, scale):
    """floor(scale * x): int64 where squares and sums stay far from its limits, Python integers beyond."""
    scaled = np.floor(np.asarray(flat, np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() <= 2**20:
        return scaled.astype(np.int64)
    return np.array([_floor(x, scale) for x in np.asarray(flat, np.float64).tolist()], object)


def _floor(x, scale):
    from fractions import Fraction

    return Fraction(x) * scale // 1


def _blocks(vectors, vec_col, dim, scale, kept):
    """One row per block: dictionaries, dictionary codes, and the other columns of its rows as lists."""
    names = [f.name for f in kept]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                column = batch.column(batch.schema.names.index(vec_col))
                if (np.diff(column.offsets.to_numpy()) != dim).any():
                    raise ValueError(f"vectors of other lengths than {dim}")
                values = _integers(column.flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dim)
                dictionaries, codes = [], []
                for j in range(dim):
                    known, code = np.unique(values[:, j], return_inverse=True)
                    dictionaries.append([str(v) for v in known.tolist()])
                    codes.append(code.astype(np.uint16))
                yield {"dictionaries": [dictionaries], "codes": [pack_many(*codes)],
                       **{f"c{i}": [batch.column(batch.schema.names.index(n)).to_pylist()] for i, n in enumerate(names)}}

    fields = [T.StructField("dictionaries", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("codes", T.BinaryType())]
    fields += [T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(kept)]
    return map_rows(vectors, run, T.StructType(fields))


def _read_block(dictionaries, codes):
    values = [[int(v) for v in d] for d in dictionaries]
    large = any(v and max(abs(v[0]), abs(v[-1])) > 2**20 for v in values)
    return [np.array(v, object if large else np.int64) for v in values], unpack_many(codes)


def assign(dictionaries, codes, books):
    """(entry of each vector and part, its squared distance), by tables over the dictionaries.

    books: for each part a list of entries, each a list of integers."""
    best, distance, width = [], [], len(books[0][0])
    large = any(abs(x) > 2**20 for book in books for entry in book for x in entry) or any(d.dtype == object for d in dictionaries)
    for p, book in enumerate(books):
        total = None
        for j in range(width):
            values = dictionaries[p * width + j]
            entries = np.array([entry[j] for entry in book], object if large else np.int64)
            table = (values[:, None] - entries[None, :]) ** 2
            part = table[codes[p * width + j]]
            total = part if total is None else total + part
        at = total.argmin(axis=1)
        best.append(at)
        distance.append(total[np.arange(len(at)), at])
    return best, distance


def _sums(blocks, books):
    """Rows and sums of every codebook entry and dimension, over all blocks."""
    width, size = len(books[0][0]), len(books[0])

    def run(batches):
        rows = np.zeros((len(books), size), np.int64)
        sums = np.zeros((len(books), width, size), object)
        for batch in batches:
            for r in batch.to_pylist():
                dictionaries, codes = _read_block(r["dictionaries"], r["codes"])
                best, _ = assign(dictionaries, codes, books)
                for p, at in enumerate(best):
                    rows[p] += np.bincount(at, minlength=size)
                    for j in range(width):
                        values = dictionaries[p * width + j]
                        held = np.bincount(at * len(values) + codes[p * width + j], minlength=size * len(values)).reshape(size, len(values))
                        sums[p, j] += (held @ values).astype(object)
        n = len(books) * width * size
        p, j, e = (a.ravel() for a in np.indices((len(books), width, size)))
        yield {"part": p, "place": j, "entry": e, "n": rows[p, e], "s": [int(x) for x in sums.reshape(n)]}

    wide = F.col("s").cast("decimal(38,0)")
    cells = map_rows(blocks.select("dictionaries", "codes"), run, "part int, place int, entry int, n long, s decimal(38,0)")
    return cells.groupBy("part", "place", "entry").agg(F.sum("n").alias("n"), F.sum(wide).cast("decimal(38,0)").alias("s")).collect()


def _first(vectors, id_col, vec_col, entries, parts, scale):
    """The parts of the vectors with the smallest ids, as the first codebooks."""
    rows = vectors.orderBy(F.col(id_col).asc_nulls_last(), F.col(vec_col)).select(vec_col).limit(entries).collect()
    if not rows:
        return None
    dim = len(rows[0][0])
    if not dim or dim % parts or any(len(r[0]) != dim for r in rows):
        raise ValueError(f"vectors of equal length are needed, and a length that {parts} divides")
    whole = [[int(v) for v in _integers(np.array(r[0], np.float64), scale)] for r in rows]
    width = dim // parts
    return [[v[p * width:(p + 1) * width] for v in whole] for p in range(parts)]


def _refined(blocks, books):
    new = [[list(entry) for entry in book] for book in books]
    for r in _sums(blocks, books):
        if r["n"]:
            new[r["part"]][r["entry"]][r["place"]] = int(r["s"]) // r["n"]
    return new


def digest(books):
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def reconstruct(code, books, scale=SCALE):
    """The vector that a code stands for (the lower corner of its integers), as floats."""
    return [x / scale for p, book in enumerate(books) for x in book[int(code[2 * p:2 * p + 2], 16)]]


def compress(vectors, id_col="vec_id", vec_col="embedding", label_col="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE):
    """(frame, codebooks): every usable row without its vector, with ``code``, ``error`` and ``label_error``.

    ``entries`` is at most 256. ``codebooks`` is None where no row is usable."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    good = usable(vectors, vec_col)
    kept = [f for f in vectors.schema.fields if f.name not in (vec_col, "code", "error", "label_error")]
    struct = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    named = [F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)] + ["code", "error", "label_error"]
    spark = vectors.sparkSession
    books = _first(good, id_col, vec_col, entries, parts, scale)
    if books is None:
        return spark.createDataFrame([], struct).withColumn("label_error", F.lit(None).cast("long")).select(*named), None
    dim = parts * len(books[0][0])
    blocks = stored(_blocks(good, vec_col, dim, scale, kept), "vector-blocks")
    for _ in range(rounds):
        books = _refined(blocks, books)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                best, distance = assign(*_read_block(r["dictionaries"], r["codes"]), books)
                pairs = np.stack(best, axis=1).astype(np.uint8)
                error = [int(x) for x in sum(distance)]
                yield {**{f"c{i}": r[f"c{i}"] for i in range(len(kept))},
                       "code": [v.tobytes().hex() for v in np.ascontiguousarray(pairs)], "error": [x if x <= _LONG else None for x in error]}

    coded = stored(map_rows(blocks, run, struct), "vector-codes")
    return _label_errors(coded, f"c{[f.name for f in kept].index(label_col)}").select(*named), books


def _label_errors(coded, label_col):
    """Adds ``label_error``. Labels with more rows than a task's share are at most as many as there are tasks; their sums
    are sent to all, the others meet their rows in a join that no large label takes part in."""
    parts = shuffle_parts(coded.sparkSession)
    spare = F.when(F.count("error") < F.count(F.lit(1)), F.lit(None)).otherwise(F.sum(F.col("error").cast("decimal(38,0)")))
    sums = stored(coded.groupBy(F.col(label_col).alias("_label")).agg(F.when(spare <= _LONG, spare).cast("long").alias("_sum"), F.count(F.lit(1)).alias("_n")), "label-errors")
    share = (sums.agg(F.sum("_n").alias("n")).first()["n"] or 0) / parts
    large, small = F.col("_n") > share, F.col("_n") <= share
    hot = F.broadcast(sums.filter(large).select(F.col("_label").alias("_hot"), F.struct("_sum").alias("_hot_sum")))
    rest = sums.filter(small).select(F.coalesce(F.xxhash64("_label"), F.lit(0)).alias("_h"), F.lit(-1).alias("_salt"), "_label", "_sum")
    rows = coded.join(hot, F.col(label_col).eqNullSafe(F.col("_hot")), "left")
    rows = rows.withColumns({"_rh": F.xxhash64(F.col(label_col)), "_rs": F.when(F.col("_hot_sum").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("code", "error"), F.lit(1 << 20)).cast("int"))})
    on = (F.col("_rh") == F.col("_h")) & (F.col("_rs") == F.col("_salt")) & F.col(label_col).eqNullSafe(F.col("_label"))
    total = F.when(F.col("_hot_sum").isNotNull(), F.col("_hot_sum")["_sum"]).otherwise(F.col("_sum"))
    return rows.join(rest, on, "left").select(*coded.columns, total.alias("label_error"))
