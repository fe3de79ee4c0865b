"""Small frames for boundaries, ties, empty groups and the places where a naive reading goes wrong."""

import datetime as dt

from pyspark.sql import functions as F

from cohortspark.functions import exprs as X
from cohortspark.operators import aggs as A, causal as CI, cohorts as C, experiments as E, joins as J, sessions as S, stats as ST, windows as W


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_session_gap_edges(spark):
    data = [(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 10:29:59"), (3, 1, "2024-01-01 10:59:59"), (4, 1, "2024-01-01 11:30:00"), (5, 1, "2024-01-01 11:30:00"),
            (6, 1, "2024-01-01 23:50:00"), (7, 1, "2024-01-02 00:05:00"), (8, 2, "2024-01-01 10:00:59"), (9, 2, "2024-01-01 10:30:00")]
    df = spark.createDataFrame([(i, u, ts(t)) for i, u, t in data], "id long, u long, ts timestamp_ntz")
    got = {r.id: r.session_num for r in S.sessionize(df, ["u"], "ts", "id", 30).collect()}
    # 29 boundaries: same session; exactly 30: new; ties stay together; midnight starts again at 1
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4, 7: 1, 8: 1, 9: 2}
    over = {r.id: r.session_num for r in S.sessionize(df, ["u"], "ts", "id", 30, per_day=False).collect()}
    assert over[7] == over[6] == 4
    cut = {r.id: r.session_num for r in S.sessionize(df, ["u"], "ts", "id", 30, hot_rows=2).collect()}
    assert cut == got


def test_boundary_diff_counts_boundaries(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:00:59"), ts("2024-01-01 00:01:01")), (ts("2024-01-07 23:59:00"), ts("2024-01-08 00:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(*[X.boundary_diff(u, "a", "b").alias(u) for u in ("minute", "hour", "day", "week", "month")]).collect()
    assert tuple(got[0]) == (1, 0, 0, 0, 0) and tuple(got[1]) == (1, 1, 1, 1, 0)
    back = df.select(X.boundary_diff("minute", "b", "a").alias("m")).first().m
    assert back == -1


def test_zone_shift_on_a_clock_change(spark):
    df = spark.createDataFrame([(ts("2024-03-10 09:30:00"),), (ts("2024-03-10 10:30:00"),)], "t timestamp_ntz")
    got = [r.la for r in df.select(X.zone_shift("t", "America/Los_Angeles").alias("la")).collect()]
    assert got == [ts("2024-03-10 01:30:00"), ts("2024-03-10 03:30:00")]


def test_micros_round_trip(spark):
    df = spark.createDataFrame([(ts("1969-12-31 23:59:59.999999"),), (ts("2024-05-06 07:08:09.123456"),)], "t timestamp_ntz")
    for r in df.select("t", X.from_micros(X.micros("t")).alias("back")).collect():
        assert r.t == r.back


def test_fill_by_rank(spark):
    rows = [(1, 10, 3), (2, None, 2), (3, None, 5), (4, 20, 4), (5, None, 9)]
    df = spark.createDataFrame([(1, i, s, r) for i, s, r in rows] + [(2, 1, None, 1)], "k long, i long, store long, rank long")
    got = {(r.k, r.i): r.final for r in W.fill_by_rank(df, ["k"], ["i"], "store", "rank", "final").collect()}
    # earlier value needs rank >= mine, later one rank <= mine, else 0
    assert got == {(1, 1): 10, (1, 2): 10, (1, 3): 20, (1, 4): 20, (1, 5): 0, (2, 1): 0}


def test_streaks(spark):
    df = spark.createDataFrame([(1, w) for w in (1, 2, 3, 5, 6, 9, 9)], "k long, w long")
    got = sorted((r.start_period, r.length) for r in W.streaks(df, ["k"], "w").collect())
    assert got == [(1, 3), (5, 2), (9, 1)]


def test_scd_edges(spark):
    d = dt.date.fromisoformat
    scd = spark.createDataFrame([(1, d("2024-01-01"), d("2024-01-10"), "a"), (1, d("2024-01-11"), None, "b"), (2, d("2024-01-01"), d("2024-01-31"), "long"),
                                 (2, d("2024-01-05"), d("2024-01-06"), "short")], "k long, s date, e date, v string")
    base = spark.createDataFrame([(1, d("2023-12-31")), (1, d("2024-01-01")), (1, d("2024-01-10")), (1, d("2024-01-11")), (1, d("2025-01-01")), (2, d("2024-01-06")),
                                  (2, d("2024-01-07")), (2, d("2024-02-01")), (3, d("2024-01-01"))], "k long, t date")
    want = [None, "a", "a", "b", "b", "short", "long", None, None]
    for hot in (None, 2):
        got = {(r.k, r.t): r.v for r in J.scd_asof(base, scd, "k", "t", "s", "e", ["v"], hot_rows=hot).collect()}
        assert [got[(r.k, r.t)] for r in base.collect()] == want


def test_asof_edges(spark):
    ev = spark.createDataFrame([(1, ts("2024-01-01 10:00:00"), 1), (1, ts("2024-01-01 10:00:00"), 2), (1, ts("2024-01-01 12:00:00"), 3)], "k long, et timestamp_ntz, id long")
    base = spark.createDataFrame([(1, ts("2024-01-01 12:00:00")), (1, ts("2024-01-01 09:00:00")), (2, ts("2024-01-01 12:00:00"))], "k long, t timestamp_ntz")
    pick = lambda strict: [r.prior_id for r in J.asof_prior(base, ev, "k", "t", "et", ["id"], strict=strict, tiebreak=["id"]).orderBy("k", "t").collect()]
    assert pick(True) == [None, 2, None]
    assert pick(False) == [None, 3, None]


def test_window_join_edges_and_left(spark):
    base = spark.createDataFrame([(1, ts("2024-01-01 00:00:00")), (2, ts("2024-01-01 00:00:00")), (3, None)], "k long, t0 timestamp_ntz")
    ev = spark.createDataFrame([(1, ts("2024-01-01 00:00:00")), (1, ts("2024-01-02 00:00:00")), (1, ts("2024-01-02 00:00:01"))], "k long, et timestamp_ntz")
    got = sorted(((r.k, str(r.et)) for r in J.window_join(base, ev, "k", "t0", "et", 0, 86400, how="left").collect()))
    assert got == [(1, "2024-01-02 00:00:00"), (2, "None"), (3, "None")]


def test_last_touch_prefers_click_and_own_surface(spark):
    df = spark.createDataFrame([(1, 1, "view", "v1"), (1, 2, "click", "c1"), (1, 3, "view", "v2"), (1, 4, "buy", None), (1, 5, "buy", "own"), (2, 1, "view", "v9"), (2, 2, "buy", None), (3, 1, "buy", None)],
                               "k long, t long, e string, s string")
    out = S.last_touch(df, ["k"], "t", "t", F.col("e") == "buy", [("click", F.col("e") == "click"), ("view", F.col("e") == "view")], "s")
    got = {(r.k, r.t): r.attributed for r in out.filter("e = 'buy'").collect()}
    assert got == {(1, 4): "c1", (1, 5): "own", (2, 2): "v9", (3, 1): "Unknown"}


def test_first_and_last_by(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k long, t long, v string")
    row = df.groupBy("k").agg(A.first_by("v", "t", "v").alias("f"), A.last_by("v", "t", "v").alias("l")).first()
    assert (row.f, row.l) == ("a", "b")


def test_day_buckets_are_whole_weeks():
    assert [hi - lo + 1 for lo, hi in C.WEEK_BUCKETS] == [7, 7, 7, 7]


def test_percent_sign_and_badges(spark):
    df = spark.createDataFrame([("20% off", "[12+ recent orders]"), ("Welcome back", "[1k+ recent orders]"), ("%", "none")], "p string, b string")
    got = [(r.a, r.b) for r in df.select(X.percent_promo("p").alias("a"), X.parse_badge_volume("b").alias("b")).collect()]
    assert got == [(True, 12), (False, 1000), (True, None)]


def test_zero_denominators(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 2.0)], "n double, d double")
    assert [r[0] for r in df.select(X.safe_div("n", "d")).collect()] == [None, None, 0.5, None]
    assert [r[0] for r in df.select(X.safe_div("n", "d", 0)).collect()] == [0.0, 0.0, 0.5, None]
    zero = spark.createDataFrame([("c", 0.0), ("t", 1.0)], "arm string, y double")
    row = E.lift(zero, "arm", "c", "t", ["y"]).first()
    assert row.abs_lift == 1.0 and row.rel_lift is None


def test_one_row_and_empty_arms(spark):
    one = spark.createDataFrame([("t", 1.0), ("c", 2.0), ("c", 4.0)], "arm string, y double")
    for out in (ST.ztest_mean(one, "arm", "t", "c", "y"), ST.welch(one, "arm", "t", "c", "y")):
        row = out.first()
        assert row.var_t is None and row.p_value is None and row["diff"] == -2.0
    empty = one.filter("arm = 'c'")
    row = ST.ttest_pooled(empty, "arm", "t", "c", "y").first()
    assert row.n_t == 0 and row.t is None
    none = spark.createDataFrame([(0, 0, 5, 10)], "x1 long, n1 long, x2 long, n2 long")
    assert ST.ztest_prop(none, "x1", "n1", "x2", "n2").first().z is None


def test_its_on_exact_lines(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + 2 * i + (5.0 + 3 * (i - 10) if i >= 10 else 0.0)) for i in range(20)]
    daily = spark.createDataFrame(rows, "day date, y double")
    _, _, summary = CI.its(daily, "day", "y", "2024-01-11")
    row = summary.first()
    assert abs(row.level_change - 5) < 1e-6 and abs(row.trend_change - 3) < 1e-6 and abs(row.cumulative_effect - sum(5 + 3 * i for i in range(10))) < 1e-5


def test_sample_size_modes(spark):
    df = spark.createDataFrame([(0.2,)], "p double")
    row = df.select(ST.sample_size(F.col("p"), F.lit(0.02), z_alpha=1.96, z_beta=0.84).alias("a"), ST.sample_size(F.col("p"), F.lit(0.02), mode="as_written", z_alpha=1.96, z_beta=0.84).alias("b")).first()
    assert row.a == 6272 and row.b == 251


def test_cuped_fill(spark):
    units = spark.createDataFrame([(1, "t"), (2, "c"), (3, "c")], "u long, arm string")
    hist = spark.createDataFrame([(1, 10.0), (2, 20.0)], "u long, x double")
    assert sorted(r.x for r in E.cuped_covariate(units, hist, "u", "x").collect()) == [10.0, 15.0, 20.0]
    assert sorted(r.x for r in E.cuped_covariate(units, hist, "u", "x", -1).collect()) == [-1.0, 10.0, 20.0]


def test_cost_per_incremental_uses_the_named_control(spark):
    rows = [("x", "control", 1, 1, 1.0), ("x", "t1", 2, 2, 3.0), ("x", "t1", 2, 3, 3.0), ("x", "t2", 3, None, None)]
    df = spark.createDataFrame(rows, "tag string, bucket string, u long, o long, p double")
    got = {r.bucket: r.cost_per_incremental_order for r in E.cost_per_incremental(df, "tag", "bucket", "control", "u", "o", "p").collect()}
    assert got == {"t1": -5.0, "t2": -1.0}


def test_dow_wraps(spark):
    df = spark.createDataFrame([(0, 6), (6, 0), (0, 2), (3, 4)], "a int, b int")
    assert [r[0] for r in df.select(X.dow_close("a", "b")).collect()] == [True, True, False, True]
