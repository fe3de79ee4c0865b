"""Cutting lineage of iterative jobs on storage every executor can reach."""

from cohortspark.sources.io import scratch_path


def durable(df):
    """Write the rows to the folder named by ``spark.checkpoint.dir`` and read them back.

    A lost executor then costs no recomputation, and the optimizer sees real file sizes instead of estimates
    multiplied up over the rounds of a loop.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "state")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
