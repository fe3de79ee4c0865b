"""Blocks of rows with local dictionaries: packed arrays, block ids, and groups read as streams.

A block is what one task reads at a time (a bounded stretch of rows). What the corpus has to count is sent per block
and part as one packed array instead of one row per value, and answers come back the same way."""

import gc
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from cohortspark.llm.common import shared_path, shuffle_parts

#: bytes of text one block takes in (a longer text is a block of its own)
BLOCK_BYTES = 4_000_000


_HEAD = struct.Struct("<3s3s?QQ")


@lru_cache(maxsize=None)
def _zstd():
    """One compressor and decompressor per process: making them costs more than a small frame."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data):
    return _zstd()[0].compress(data)


def unsqueeze(data):
    return _zstd()[1].decompress(bytes(data))


def pack(values, ascending=False):
    """Zstandard frame of an array of integers, byte planes apart. ``ascending``: they are in order, so their differences
    are stored, in as few bytes as the largest of them needs."""
    values = np.ascontiguousarray(values)
    kind, n, first = values.dtype, len(values), 0
    if ascending and n:
        first = int(values[0]) % 2**64
        values = np.diff(values.astype(np.uint64))
        width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) >> 8 * w == 0)
        values = values.astype(f"<u{width}")
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return _HEAD.pack(kind.str.encode(), values.dtype.str.encode(), ascending, n, first) + squeeze(planes.tobytes())


def unpack(data):
    data = bytes(data)
    kind, held, ascending, n, first = _HEAD.unpack_from(data)
    kind, held = np.dtype(kind.decode()), np.dtype(held.decode())
    raw = unsqueeze(data[_HEAD.size:])
    planes = np.frombuffer(raw, np.uint8).reshape(held.itemsize, len(raw) // held.itemsize)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(held)
    if not ascending or not n:
        return values.astype(kind, copy=False)
    out = np.empty(n, np.uint64)
    out[0] = first
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    out[1:] += np.uint64(first)
    return out.astype(kind)


def pack_many(*arrays, ascending=0):
    """Several arrays in one value, the first so many of them ascending."""
    parts = [pack(a, i < ascending) for i, a in enumerate(arrays)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_many(data):
    data, at, out = bytes(data), 0, []
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        out.append(unpack(data[at + 8:at + 8 + size]))
        at += 8 + size
    return out


def distinct(values):
    """Sorted distinct values, by sorting (``np.unique`` without counts hashes, which takes many times as long here)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[:len(values)]]


def concat_ranges(starts, sizes):
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then the same for the next."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(np.asarray(starts, np.int64) - before, sizes) + np.arange(total)


def block_ids():
    """Ids of the blocks of the running task: its partition number above, a counter below. A task that runs again gives
    the same rows other ids at most, and only one run's output is kept."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def map_rows(df, fn, schema):
    """``fn(iterator of Arrow batches) -> iterator of column dicts`` for each partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    target = to_arrow_schema(struct, prefers_large_types=False)

    def run(batches):
        for cols in fn(batch for batch in batches if batch.num_rows):
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if isinstance(cols[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(cols[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, struct)


def runs_of(batches, key):
    """Stretches of rows with equal ``key`` columns, as (key tuple, iterator of row dicts), over sorted batches. The
    rows come one at a time, so a group is never held whole here; a reader that stops early loses nothing."""
    import itertools

    def rows():
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield from batch.slice(i, 64).to_pylist()

    return itertools.groupby(rows(), key=lambda r: tuple(r[k] for k in key))


def map_groups(df, keys, order, fn, schema, parts=None):
    """``fn(key, iterator of row dicts) -> iterator of column dicts`` for each group, its rows in the given order."""
    spread = df.repartition(parts or shuffle_parts(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        for key, rows in runs_of(batches, keys):
            yield from fn(key, rows)

    return map_rows(spread, run, schema)


def text_bytes(docs, text_col="text"):
    """Bytes of all texts, by one aggregate."""
    return docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("b")).first()["b"] or 0


def release(spark):
    """Drop the shuffle files of steps whose results are written: their frames are garbage by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kinds_stored(df, label, kind="kind"):
    """Write a frame with a text column ``kind`` to the shared folder, one folder for each kind; returns a function that
    reads the rows of one kind."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, label)
    df.write.partitionBy(kind).parquet(path)
    return lambda value: spark.read.schema(schema).parquet(path).filter(F.col(kind) == value).drop(kind)
