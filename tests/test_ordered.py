"""Cut scans must give what plain windows give, with a key that holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import windows as W
from cohortspark.operators.aggs import percentiles
from cohortspark.operators.ordered import (
    OrderedScan, bfill, ffill, hot_hashes, key_max, key_sum, lag, lead, row_number, running_max, running_min, running_sum,
)

OPS = dict(rn=row_number(), total=running_sum("v"), top=running_max("v"), low=running_min("v"), before=lag("v", -1), after=lead("t"),
           filled=ffill("v"), strictly=ffill("v", True), back=bfill("v"), back_strict=bfill("v", True), whole=key_sum("v"), biggest=key_max("t"))


def skewed(spark):
    # a third of the rows share key 7 and, within it, a fifth share one order value
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 5 == 0, F.lit(100)).when(F.col("id") % 41 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(500))).alias("t"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["t", "id"], ["-t", "id"]])
def test_cut_scan_equals_plain_window(spark, keys, order):
    df = skewed(spark)
    plain = OrderedScan(df, keys, order).add(**OPS)
    cut = OrderedScan(df, keys, order, hot_rows=100)
    assert not plain.split and cut.split
    biggest = cut.df.groupBy(*keys, "_cell").count().agg(F.max("count")).first()[0]
    assert biggest <= 200
    assert rows(plain.result(), plain.df.columns) == rows(cut.add(**OPS).result(), plain.df.columns)


def test_hot_keys_are_found_without_a_shuffle(spark):
    assert len(hot_hashes(skewed(spark), ["k"], 500)) == 1
    assert hot_hashes(skewed(spark).limit(0), ["k"], 1) == []


def test_percentiles_and_buckets_when_cut(spark):
    df = skewed(spark)
    a = percentiles(df, ["k"], "t", [0.25, 0.5, 0.9])
    b = percentiles(df, ["k"], "t", [0.25, 0.5, 0.9], hot_rows=20)
    assert rows(a, a.columns) == rows(b, a.columns)
    a = W.ntile_bucket(df, ["t", "id"], 7)
    b = W.ntile_bucket(df, ["t", "id"], 7, hot_rows=100)
    assert rows(a, a.columns) == rows(b, a.columns)
    a = W.pct_rank(df.filter("t is not null"), "t", by=["k"])
    b = W.pct_rank(df.filter("t is not null"), "t", by=["k"], hot_rows=20)
    assert rows(a, a.columns) == rows(b, a.columns)


def test_text_order_when_cut(spark):
    df = skewed(spark).withColumn("name", F.md5(F.col("id").cast("string")))
    a = W.random_decile(df.select("id"), "id", 5)
    b = W.random_decile(df.select("id"), "id", 5, hot_rows=100)
    assert rows(a, a.columns) == rows(b, a.columns)
    a = OrderedScan(df, [], ["name", "id"]).add(n=row_number()).result()
    b = OrderedScan(df, [], ["name", "id"], hot_rows=100).add(n=row_number()).result()
    assert rows(a, ["id", "n"]) == rows(b, ["id", "n"])


def test_an_order_is_required(spark):
    with pytest.raises(ValueError):
        OrderedScan(skewed(spark), ["k"], [])
    with pytest.raises(ValueError):
        W.top_n_per(skewed(spark), ["k"], [], 1)


def test_a_thousand_hot_keys_are_all_cut(spark):
    df = spark.range(4000).select("id", (F.col("id") % 1000).alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("t"))
    scan = OrderedScan(df, ["k"], ["t", "id"], hot_rows=3)
    assert scan.plain.count() == 0 and scan.cut.groupBy("k").agg(F.count_distinct("_cell").alias("n")).filter("n > 1").count() > 900
    plain = OrderedScan(df, ["k"], ["t", "id"]).add(n=row_number(), prev=lag("id")).result()
    assert rows(plain, ["id", "n", "prev"]) == rows(scan.add(n=row_number(), prev=lag("id")).result(), ["id", "n", "prev"])


def test_names_with_one_long_prefix_are_cut(spark):
    df = spark.range(20_000).select("id", F.concat(F.lit("the same long beginning of every name "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"))
    scan = OrderedScan(df, [], ["-name"], hot_rows=1000)
    assert scan.df.groupBy("_cell").count().agg(F.max("count")).first()[0] <= 1000
    got = scan.add(n=row_number()).result()
    assert got.filter(F.col("n") != 20_000 - F.col("id")).count() == 0


def test_null_and_float_keys_when_cut(spark):
    data = [(None, i) for i in range(40)] + [(float("nan"), i) for i in range(40)] + [(0.0, i) for i in range(20)] + [(-0.0, 20 + i) for i in range(20)] + [(1.0, 0)]
    df = spark.createDataFrame(data, "k double, i long")
    for hot_rows in (None, 10):
        out = OrderedScan(df, ["k"], ["i"], hot_rows=hot_rows).add(n=row_number(), s=key_sum(F.lit(1))).result()
        assert out.filter(F.col("n") != F.col("i") + 1).count() == 0 and out.filter("s = 40").count() == 120
        shares = W.pct_rank(df, "k", hot_rows=hot_rows).groupBy("percent_rank", "cume_dist").count().collect()
        assert sorted((round(r[0], 6), round(r[1], 6), r[2]) for r in shares) == [(0.0, round(40 / 121, 6), 40), (round(40 / 120, 6), round(80 / 121, 6), 40), (round(80 / 120, 6), round(81 / 121, 6), 1), (round(81 / 120, 6), 1.0, 40)]
        both = W.over_partition(df, ["k"], {"total": F.count(F.lit(1))}, hot_rows=hot_rows)
        assert both.filter("total = 40").count() == 120
        ranked = W.ranks(df, [], "k", hot_rows=hot_rows).groupBy("rank", "dense_rank").count().orderBy("rank").collect()
        assert [tuple(r) for r in ranked] == [(1, 1, 40), (41, 2, 40), (81, 3, 1), (82, 4, 40)]


def test_cells_are_many_to_a_task(spark):
    # a cell was a task and a file: their reports to the driver grew with rows / hot_rows
    df = spark.range(6000).select("id", (F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("t"))
    ops = dict(n=row_number(), prev=lag("id"), after=lead("id"), total=key_sum("t"))
    for keys in ([], ["k"]):
        scan = OrderedScan(df, keys, ["-t", "id"], hot_rows=10)
        sizes = scan.cut.groupBy(*keys, "_cell").count().agg(F.count(F.lit(1)), F.max("count")).first()
        assert sizes[0] >= 1200 and sizes[1] <= 5
        assert len(scan.cut.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        plain = OrderedScan(df, keys, ["-t", "id"]).add(**ops).result()
        assert rows(plain, plain.columns) == rows(scan.add(**ops).result(), plain.columns)


def test_a_cut_frame_keeps_all_its_columns(spark):
    # the cells' number stood in a column "_at": a frame's own column of that name was lost
    df = spark.range(400).select((F.col("id") % 2).alias("k"), F.pmod(F.xxhash64("id"), F.lit(90)).alias("_at"), F.col("id").alias("_kind"))
    ops = dict(n=row_number(), before=lag("_at"), after=lead("_kind"), total=running_sum("_at"))
    for keys in ([], ["k"]):
        plain, cut = OrderedScan(df, keys, ["_at", "_kind"]), OrderedScan(df, keys, ["_at", "_kind"], hot_rows=20)
        assert cut.split and cut.columns == df.columns and set(cut.df.columns) == {*df.columns, "_cell"}
        want = plain.add(**ops).result()
        assert rows(want, want.columns) == rows(cut.add(**ops).result(), want.columns)
