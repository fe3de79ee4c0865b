"""Helpers the operators of this subpackage share: row keys, Arrow plumbing, scratch tables."""

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

TEXT_KEY = "_text_key"


def shared_path(spark, label):
    """A new path in the folder all executors share (``spark.checkpoint.dir``). Only a local session may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cohortspark-llm-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df, label):
    """Write the frame to the shared folder and read it back: cuts lineage, and survives lost executors.

    Spark drops the shuffle files of finished steps when the driver collects its garbage; asking for that here keeps a
    job of many steps from holding all of them until its end."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, label)
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def keyed(docs, id_col="doc_id", text_col="text"):
    """(doc_id long, text, hash of the text): with the hash, rows with a missing or repeated id stay apart unless they are equal."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias(TEXT_KEY))


def same_row(left, right):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left[TEXT_KEY] == right[TEXT_KEY])


def shuffle_parts(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column):
    """Buffers of a string column as (values uint8 array, offsets int64 array); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def arrow_map(df, fn, schema):
    """``fn(batch) -> dict of columns`` (or a generator of them) over the Arrow batches of each partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    target = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for part in ([out] if isinstance(out, dict) else out):
                    yield pa.RecordBatch.from_arrays([pa.array(part[f.name], type=f.type, from_pandas=False) if not isinstance(part[f.name], pa.Array) else part[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, struct)


def row_chunks(batch, limit=4_000_000, column="text"):
    """Cut a batch into runs of rows of about ``limit`` bytes of text; a longer text comes alone and whole."""
    _, off = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


