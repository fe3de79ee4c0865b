import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cohortspark.operators import causal as CI, models as M, uplift as U


def units(spark, n=400, scores=150):
    return spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(scores)) / 100.0).alias("s"))


def greedy(rows, caliper):
    treated, control = sorted((r.s, r.id) for r in rows if r.a == 1), sorted((r.s, r.id) for r in rows if r.a == 0)
    pairs = sorted((abs(x[0] - y[0]), x, y) for x in treated for y in control if abs(x[0] - y[0]) <= caliper)
    used, gaps = set(), []
    for gap, x, y in pairs:
        if ("t", x) not in used and ("c", y) not in used:
            used |= {("t", x), ("c", y)}
            gaps.append(gap)
    return gaps


def test_unpaired_matching_is_greedy_nearest(spark):
    df = units(spark).persist()
    whole = CI.match_without_replacement(df, "id", "a", "s", 0.02).collect()
    rounds = CI.match_without_replacement(df, "id", "a", "s", 0.02, hot_rows=60, cluster_limit=20).collect()
    assert sorted(whole) == sorted(rounds)
    assert len({r.control_id for r in whole}) == len(whole) == len({r.treated_id for r in whole})
    want = greedy(df.collect(), 0.02)
    assert len(whole) == len(want) and abs(sum(r.gap for r in whole) - sum(want)) < 1e-9


def test_matching_with_one_shared_score(spark):
    # every unit has the same score: one round, ranks paired off, nothing is reused
    df = units(spark).withColumn("s", F.lit(0.5))
    got = CI.match_without_replacement(df, "id", "a", "s", 0.1).collect()
    n = min(df.filter("a = 1").count(), df.filter("a = 0").count())
    assert len(got) == n == len({r.control_id for r in got}) and max(r.gap for r in got) == 0


def test_matching_across_many_borders(spark):
    # chains of shrinking and growing gaps, lumps of equal scores, and a lone score that holds a third of all units
    rng = random.Random(3)
    places = [round(i + i * i / 4000, 6) for i in range(300)] + [400 - 0.01 * 1.02**i for i in range(250)] + [rng.randint(500, 560) for _ in range(400)] + [600.0] * 500
    rows = [(i, rng.randint(0, 1) if s != 600 else int(i % 3 > 0), float(s)) for i, s in enumerate(places)]
    df = spark.createDataFrame(rows, "id long, a int, s double").repartition(3)
    want = None
    for limit in (None, 40):
        got = CI.match_without_replacement(df, "id", "a", "s", 2.5, cluster_limit=limit).collect()
        gaps = sorted(round(r.gap, 6) for r in got)
        assert len({r.control_id for r in got}) == len(got) == len({r.treated_id for r in got})
        assert gaps == sorted(round(g, 6) for g in greedy(df.collect(), 2.5))
        want = want or sorted(got)
        assert sorted(got) == want


def test_no_controls_within_reach(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (2, 0, 0.9)], "id long, a int, s double")
    assert CI.match_without_replacement(df, "id", "a", "s", 0.1).count() == 0
    assert CI.match_with_replacement(df, "id", "a", "s", 0.1).count() == 0


def planted(spark, effect):
    df = spark.range(20000).select("id", (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("a"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2))).alias("seg"),
                                   (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10000)) / 10000.0).alias("u"))
    return df.withColumn("y", (F.col("u") < 0.3 + effect * F.col("a") * F.col("seg")).cast("int"))


def test_learners_find_the_planted_effect(spark):
    df = planted(spark, 0.3).persist()
    for learner in (CI.TLearner(["seg"], "a", "y", max_iter=3, max_depth=2), CI.XLearner(["seg"], "a", "y", max_iter=3, max_depth=2)):
        got = {r.seg: r.u for r in learner.fit(df).predict(df).groupBy("seg").agg(F.avg("uplift").alias("u")).collect()}
        assert abs(got[1] - 0.3) < 0.06 and abs(got[0]) < 0.06
    scored = df.withColumn("score", F.col("seg").cast("double"))
    found = U.uplift_summary(U.qini_curve(scored, "score", "a", "y", "id")).first()
    none = U.uplift_summary(U.qini_curve(planted(spark, 0.0).withColumn("score", F.col("seg").cast("double")), "score", "a", "y", "id")).first()
    assert found.qini_auc > 200 and abs(none.qini_auc) < 60


def test_qini_when_cut(spark):
    df = planted(spark, 0.3).withColumn("score", F.round("u", 1)).limit(3000).persist()
    a = U.qini_curve(df, "score", "a", "y", "id").select("id", "position", "curve").collect()
    b = U.qini_curve(df, "score", "a", "y", "id", hot_rows=200).select("id", "position", "curve").collect()
    assert sorted(a) == sorted(b)


def test_many_cohorts_in_one_fit(spark):
    # 1,000 cohorts with a planted odds ratio each; one of them holds half of all rows
    df = spark.range(60_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("x"))
    df = df.withColumn("y", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100)) < 30 + 30 * F.col("x")).cast("int"))
    terms, model = M.fit_logit(df, ["x"], "y", by="k", key="id", test=0.3, max_iter=8)
    got = {r.cohort: r for r in terms.collect()}
    assert len(got) == model.cohorts.count() == df.select("k").distinct().count()
    assert abs(got[None].odds_ratio - (0.6 / 0.4) / (0.3 / 0.7)) < 0.25 and abs(got[None].auc - got[None].auc_test) < 0.02
    assert model.transform(df.limit(10).withColumn("k", F.lit(-5).cast("bigint")), "p").filter("p IS NULL").count() == 10
    alone, _ = M.fit_logit(df.filter("k IS NULL"), ["x"], "y", key="id", test=0.3)
    assert abs(alone.first().coef - got[None].coef) < 1e-6


def test_fits_refuse_nulls(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 0), (2.0, 0), (float("nan"), 1)], "x double, y int")
    for fit in (lambda: M.fit_logit(df, ["x"], "y"), lambda: M.logit_inference(df, ["x"], "y")):
        with pytest.raises(Exception, match="impute them first"):
            fit()


def test_separated_constant_and_penalised_fits(spark):
    df = spark.range(200).select((F.col("id") / 100.0).alias("x"), F.lit(3.0).alias("flat"), (F.col("id") >= 100).cast("int").alias("y"))
    terms, model = M.fit_logit(df, ["x", "flat"], "y", max_iter=25)
    got = {r.term: r for r in terms.collect()}
    assert got["x"].coef > 10 and got["flat"].coef == 0 and got["x"].auc == 1.0
    ridge = {r.term: r.coef for r in M.fit_logit(df, ["x", "flat"], "y", reg=1.0)[0].collect()}
    assert 0 < ridge["x"] < 2


def test_cells_settle_only_what_is_certain():
    """Random cuts of random scores, round after round, end where greedy matching ends."""
    rng = random.Random(1)
    for trial in range(200):
        places = sorted({rng.randint(0, 80) if trial % 2 else rng.random() * 50 for _ in range(rng.randint(1, 60))})
        state, reach, got, rounds = [(p, rng.choice([-1, 1]) * rng.randint(1, 3), 0, 0) for p in places], rng.choice([1, 2, 5, 100]), [], 0
        rows = [Row(id=i, a=int(u > 0), s=p) for i, (p, u) in enumerate((p, u) for p, u, _, _ in state for _ in range(abs(u)))]
        while state:
            rounds += 1
            state.sort()
            cuts = sorted(rng.sample(range(1, len(state)), min(3, len(state) - 1))) if rounds < 30 else []
            left = []
            for lo, hi in zip([0, *cuts], [*cuts, len(state)]):
                near = [pick([x[0] for x in side if x[1] * sign > 0], default=None) for side, pick in ((state[:lo], max), (state[hi:], min)) for sign in (1, -1)]
                cell = pd.DataFrame([(*x, *near) for x in state[lo:hi]], columns=["_s", "_left", "_ut", "_uc", "_lt", "_lc", "_rt", "_rc"])
                for paired, s, c, ut, uc, units in CI._settle_cell(reach)(cell).itertuples(index=False, name=None):
                    if paired:
                        got += [round(abs(s - c), 9)] * units
                    else:
                        left.append((s, units, ut, uc))
            state = left
        assert sorted(got) == sorted(round(g, 9) for g in greedy(rows, reach))
