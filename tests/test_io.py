import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import exprs as X
from cohortspark.sources import io


def test_split_statements():
    text = "select 'a;b' as x; -- c;d\nselect 1 /* ; */; ;\n-- only a comment\n"
    assert [s.split("\n")[-1] for s in io.split_statements(text)] == ["select 'a;b' as x", "select 1 /* ; */"]


def test_duplicate_columns_are_refused(spark):
    df = spark.range(1).select("id", F.col("id").alias("ID"))
    for call in (lambda: io.lowercase_columns(df), lambda: io.infer_ddl(df, "t"), lambda: io.write_table(df, "/tmp/none")):
        with pytest.raises(ValueError):
            call()


def test_ddl_types(spark):
    df = spark.sql("select 1 as i, 1L as l, 1.5D as d, cast(1 as decimal(9,2)) as n, true as b, date'2024-01-01' as dd, timestamp_ntz'2024-01-01 00:00:00' as t, array(1) as a, map('x', 1) as m, named_struct('q', 1) as s, null as z, cast('x' as binary) as y")
    ddl = io.infer_ddl(df, "t")
    for part in ("`i` BIGINT", "`d` DOUBLE", "`n` DECIMAL(9,2)", "`b` BOOLEAN", "`dd` DATE", "`t` TIMESTAMP_NTZ", "`a` ARRAY<BIGINT>", "`m` MAP<STRING, BIGINT>", "`s` STRUCT<q: BIGINT>", "`z` STRING", "`y` BINARY"):
        assert part in ddl, part


def test_upsert_partition_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda d, v: spark.createDataFrame([(v, dt.date(2024, 1, d))], "v long, d date")
    io.upsert_partition(day(1, 1).union(day(2, 2)), path, "d")
    for _ in range(2):
        io.upsert_partition(day(2, 9), path, "d")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]


def test_update_from(spark):
    target = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long")
    up = spark.createDataFrame([(1, 7), (1, 8), (3, 9)], "k long, v long")
    up = up.withColumn("at", -F.col("v"))
    assert sorted(map(tuple, io.update_from(target, up, ["k"], ["v"], order=["at"]).collect())) == [(1, 7), (2, 6)]
    assert sorted(map(tuple, io.update_from(target, up, ["k"], ["v"], F.col("new_v") < 7, ["at"]).collect())) == [(1, 5), (2, 6)]
    with pytest.raises(Exception, match="several updates"):
        io.update_from(target, up, ["k"], ["v"]).collect()
    assert sorted(map(tuple, io.update_from(target, up.select("k", F.lit(4).cast("long").alias("v")), ["k"], ["v"]).collect())) == [(1, 4), (2, 6)]


def test_scratch_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.scratch_path(Session, "x")


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.range(3).withColumn("z", F.lit(None))
    io.write_table(df, path)
    with pytest.raises(Exception):
        io.write_table(df, path)
    io.write_table(df, path, "ignore")
    io.write_table(df, path, "append")
    assert spark.read.parquet(path).count() == 6


def test_user_agent_rules(spark):
    agents = [("Mozilla/5.0 (iPhone) CriOS/120 Safari", ("chrome", "ios", 0)), ("Mozilla (X11; Linux) Gecko Firefox/121", ("firefox", "linux", 0)), ("HeadlessChrome Windows", ("chrome", "windows", 1))]
    df = spark.createDataFrame([(a,) for a, _ in agents], "ua string").select(X.classify_user_agent("ua").alias("u")).select("u.*")
    assert [tuple(r) for r in df.collect()] == [w for _, w in agents]


def test_device_ids(spark):
    df = spark.createDataFrame([("DX_A-1",), ("dxZ-9",), ("A-B",)], "d string")
    # the underscore of the LIKE pattern matches any character, as in SQL
    assert [r[0] for r in df.select(X.normalize_device_id("d")).collect()] == ["dx_dx_a1", "dxz9", "dx_ab"]
