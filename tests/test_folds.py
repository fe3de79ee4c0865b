"""Running totals, sweeps, exact quantiles and mergeable distinct counts against plain Python, with skew, NULLs and ties."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import causal as CI, cohorts as C, distincts as D, prep as PR, profiles as P
from cohortspark.sources import io

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("sketch", [10_000, 40])
def test_quantiles_of_many_columns(spark, monkeypatch, sketch):
    monkeypatch.setattr(PR, "_SKETCH", sketch)
    rng = np.random.default_rng(2)
    columns = {"a": rng.normal(size=900).tolist(), "b": rng.integers(0, 4, 900).tolist(), "c": [7] * 900, "d": [None] * 900, "e": [1e9] + [None] * 899,
               "f": [5.0, 1.0] + [None] * 898, "g": (rng.pareto(1.0, 900) * 1e6).tolist(), "h": [0.0] * 450 + [1.0] * 450, "i": [-0.0, 0.0] * 450}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" if c not in "bc" else f"{c} int" for c in columns)).repartition(4)
    probs = [0.0, 0.01, 0.25, 0.499, 0.5, 0.9, 0.99, 1.0]
    for c, found in PR.exact_quantiles(df, {c: probs for c in columns}).items():
        known = [x for x in columns[c] if x is not None]
        for p in probs:
            assert found[p] is None if not known else found[p] == pytest.approx(np.percentile(known, 100 * p), rel=1e-12), (c, p)
    assert PR.exact_quantiles(df, {}) == {} and PR.exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": {0.5: None}}


def test_imputation_and_clipping_of_many_columns(spark):
    df = spark.createDataFrame([(1.0, "x", None, 2), (3.0, None, None, 2), (None, "y", None, 1), (10.0, "y", None, 1), (None, "x", None, None)], "a double, b string, c double, d int")
    assert PR.modes(df, ["b", "d", "c"]) == {"b": "x", "d": 1, "c": None}
    rows = PR.impute(df, {"a": "median", "b": "mode", "c": "median", "d": "max+1"}).collect()
    assert [tuple(r) for r in rows][2] == (3.0, "y", None, 1) and rows[4] == (3.0, "x", None, 3)
    clipped, report = PR.winsorize(df, ["a", "c"], 0.25, 0.75)
    assert [tuple(r) for r in report.orderBy("column").collect()] == [("a", 2.0, 6.5, 1, 1), ("c", None, None, 0, 0)]
    assert [r.a for r in clipped.collect()] == [2.0, 3.0, None, 6.5, None]


def test_levels_without_a_limit(spark):
    train = spark.range(1000).select(F.format_string("k%04d", "id").alias("k"))
    model = PR.fit_levels(train.union(train.limit(10)), ["k"])
    df = spark.createDataFrame([("k0000",), ("k0999",), ("other",), (None,)], "k string")
    for hot_rows in (None, 1):
        assert sorted((r.k or "", r.k_idx) for r in PR.apply_levels(model, df, hot_rows).collect()) == [("", 1000), ("k0000", 0), ("k0999", 999), ("other", 1000)]


@pytest.mark.parametrize("window", [1, 3, 28])
def test_sweep_of_active_units(spark, window):
    rng = random.Random(window)
    acts = [(rng.choice([1, 2, 3, 4, None]), day(rng.choice([0, 1, 5, 9, 30, 31, 33, 60, 200]))) for _ in range(60)] + [(1, None)]
    people = [(u, g) for u, g in ((1, "a"), (1, "b"), (2, "a"), (5, "a"), (3, None), (None, "a"))]
    df, who = spark.createDataFrame(acts, "u int, d date"), spark.createDataFrame(people, "u int, g string")
    for hot_rows in (None, 5):
        got = {(r.analysis_date, r.g): (r.total, r.active) for r in C.rolling_active(who, df, "u", ["g"], "d", "2024-01-03", "2024-02-20", window, hot_rows).collect()}
        for n in range(2, 51):
            for g in ("a", "b", None):
                units = {u for u, h in people if h == g}
                active = {u for u, d in acts if u in units and u is not None and d is not None and day(n - window) <= d <= day(n - 1)}
                assert got[day(n), g] == (len(units), len(active))


def skewed_events(seed, n=400):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), base + dt.timedelta(hours=rng.randint(0, 24 * 40)) if rng.random() > 0.02 else None, rng.choice("vp"), rng.choice([None, 1.5, 2.0])) for _ in range(n)]
    marks = [(rng.choice([1, 1, 2, 4, None]), base + dt.timedelta(hours=rng.choice([0, 24, 100, 24 * 20, 24 * 45]))) for _ in range(40)] + [(1, None)]
    return rows, marks


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_look_back_and_recency(spark, hot_rows):
    rows, marks = skewed_events(4)
    ev, ex = spark.createDataFrame(rows, "u int, ts timestamp_ntz, kind string, value double"), spark.createDataFrame(marks, "u int, t0 timestamp_ntz")
    stages = {"v": F.col("kind") == "v", "p": F.col("kind") == "p"}
    for whole in (False, True):
        for r in P.stage_recency(ex, ev, "u", "t0", "ts", stages, whole_days=whole, hot_rows=hot_rows).collect():
            mine = [(t, k) for u, t, k, _ in rows if None not in (u, t, r.t0) and u == r.u and (t.date() < r.t0.date() if whole else t < r.t0)]
            for k in "vp":
                times = [t for t, x in mine if x == k]
                assert r[f"n_{k}"] == len(times) and r[f"days_since_{k}"] == ((r.t0.date() - max(times).date()).days if times else None)
                if whole:
                    days = {t.date() for t in times}
                    assert (r[f"n_days_{k}"], r[f"first_day_{k}"], r[f"last_day_{k}"], r[f"has_{k}"]) == (len(days), min(days, default=None), max(days, default=None), int(bool(days)))
    snaps = ex.select("u", F.to_date("t0").alias("snap"))
    out = P.lookback_features(snaps, ev, "u", "snap", "ts", [3, 10], {"n": ("count", None, None), "s": ("sum", "value", stages["v"]), "m": ("avg", "value", None)}, hot_rows=hot_rows)
    assert out.count() == len(marks)
    for r in out.collect():
        mine = [(r.snap - t.date(), k, v) for u, t, k, v in rows if None not in (u, t, r.snap) and u == r.u and 1 <= (r.snap - t.date()).days <= 10]
        for w in (3, 10):
            near = [(k, v) for d, k, v in mine if d.days <= w]
            s, m = [v for k, v in near if k == "v" and v is not None], [v for _, v in near if v is not None]
            assert r[f"n_{w}d"] == (len(near) if mine else None)
            assert r[f"s_{w}d"] == (pytest.approx(sum(s)) if s else None) and r[f"m_{w}d"] == (pytest.approx(sum(m) / len(m)) if m else None)


def one_unit(spark):
    """Orders and exposures of one unit, an hour apart or at the same time, some without a time; a tenth falls to no unit."""
    hours = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    orders = [(None if i % 10 == 9 else 1, None if i % 37 == 0 else hours(i // 2), i, "vp"[i % 2]) for i in range(200)]
    marks = [(1, None if i == 5 else hours(i // 2 * 3)) for i in range(60)]
    return orders, marks, spark.createDataFrame(orders, "u int, ts timestamp_ntz, id long, code string"), spark.createDataFrame(marks, "u int, t0 timestamp_ntz")


def test_recency_of_one_unit_in_cells(spark):
    orders, marks, ev, ex = one_unit(spark)
    for whole in (False, True):
        got = P.stage_recency(ex, ev, "u", "t0", "ts", {"p": F.col("code") == "p"}, whole_days=whole, hot_rows=8).collect()
        assert len(got) == len(marks)
        for r in got:
            mine = [t for u, t, _, k in orders if None not in (u, t, r.t0) and k == "p" and (t.date() < r.t0.date() if whole else t < r.t0)]
            assert (r.n_p, r.days_since_p) == (len(mine), (r.t0.date() - max(mine).date()).days if mine else None)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_redemption_counts(spark, hot_rows):
    rows, marks = skewed_events(9)
    orders = spark.createDataFrame([(u, t, i, k) for i, (u, t, k, _) in enumerate(rows)], "u int, ts timestamp_ntz, id long, code string")
    exposed = spark.createDataFrame([(u, t, "ab"[i % 2]) for i, (u, t) in enumerate(marks)], "u int, t0 timestamp_ntz, arm string")
    got = {r.arm: r for r in P.redemption(exposed, orders, spark.createDataFrame([("p",), ("p",)], "code string"), "u", "t0", "ts", "id", "code", ["arm"], hot_rows).collect()}
    for arm in "ab":
        mine = [m for i, m in enumerate(marks) if "ab"[i % 2] == arm]
        per = {}
        for u, t0 in mine:
            per[u] = per.get(u, 0) + sum(1 for v, t, k, _ in rows if None not in (u, t0, v, t) and v == u and k == "p" and t >= t0)
        assert (got[arm].exposed, got[arm].redeemers, got[arm].redeemed_orders) == (len(per), sum(n > 0 for n in per.values()), sum(per.values()))


def test_distinct_counts_merge(spark):
    rows, _ = skewed_events(6, 600)
    ev = spark.createDataFrame([((u or 0) * 100_003 + i % 90 if u else None, t, k) for i, (u, t, k, _) in enumerate(rows) if t], "u long, ts timestamp_ntz, k string").withColumn("d", F.to_date("ts"))
    early = D.entity_numbers(ev.filter("d < DATE'2024-01-15'"), "u")
    numbers = D.entity_numbers(ev, "u", early)
    assert early.exceptAll(numbers).count() == 0
    values = sorted(r.number for r in numbers.collect())
    assert values == list(range(1, len(values) + 1))
    far = numbers.withColumn("number", F.col("number") * 40_000)  # one block each
    for table in (numbers, far):
        state = D.daily_distinct_state(ev, table, "d", ["k"], "u")
        assert {r.k: r.n for r in D.distinct_from_state(state, ["k"]).collect()} == {r.k: r.n for r in ev.groupBy("k").agg(F.count_distinct("u").alias("n")).collect()}
    got = {(r.d, r.k): r.n for r in D.rolling_distinct(state, "d", ["k"], "2024-01-10", "2024-03-01", 7).collect()}
    raw = ev.collect()
    for n in range(9, 60):
        for k in "vp":
            users = {r.u for r in raw if r.u is not None and r.k == k and day(n - 6) <= r.d <= day(n)}
            assert got.get((day(n), k), 0) == len(users)


def test_folds_are_never_scored_by_their_own_models(spark):
    # the outcome is the fold's own number: a model that has seen a fold would know it
    df = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("a"), F.lit(1).alias("x"))
    coded = CI.cross_fit(CI.TLearner(["x"], "a", "y", kind="forest", max_iter=1, max_depth=1), df.withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(10)) < 3).cast("int")), "id", folds=3)
    assert coded.count() == 3000 and coded.select("fold").distinct().count() == 3
    assert coded.groupBy("fold").agg(F.count_distinct("uplift").alias("n")).filter("n <> 1").count() == 0
    assert coded.select("uplift").distinct().count() == 3


def test_partitions_split_by_their_size(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 990, "small").alias("d"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows end in one file
    try:
        out = io.upsert_partition(df, path, "d", rows_per_file=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert out.count() == 1000 and out.filter("d IS NULL").count() == 10
    files = {r.d: r.n for r in out.select("d", F.input_file_name().alias("f")).groupBy("d").agg(F.count_distinct("f").alias("n")).collect()}
    assert files["small"] == 1 and 2 <= files["big"] <= 9
