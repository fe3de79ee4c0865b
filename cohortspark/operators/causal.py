"""Propensity matching, uplift learners and interrupted time series."""

from functools import reduce

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Window, functions as F

from cohortspark.functions.exprs import md5_bucket64
from cohortspark.operators.joins import asof_prior, nearest_value_join
from cohortspark.operators.lineage import durable
from cohortspark.operators.logits import fit_logits
from cohortspark.operators.models import fit_trees, score
from cohortspark.operators.ordered import OrderedScan, null_safe_join, row_number, running_sum


def propensity(df, unit, arm, xs, name="propensity"):
    """Add P(arm = 1 | xs) from a logistic regression."""
    frame = df.select(unit, F.col(arm).cast("int").alias(arm), *[F.col(x).cast("double").alias(x) for x in xs])
    return fit_logits(frame, xs, arm).transform(frame, name)


def caliper_width(df, score_col, multiple):
    row = df.agg(F.stddev_samp(score_col).alias("s")).first()
    return float(row.s or 0.0) * multiple


def match_with_replacement(df, unit, arm, score_col, caliper):
    """Each treated unit with its nearest control within the caliper; controls may repeat."""
    treated = df.filter(F.col(arm) == 1).select(F.col(unit).alias("treated_id"), F.col(score_col).alias("treated_score"))
    control = df.filter(F.col(arm) == 0).select(F.col(unit).alias("_cid"), F.col(score_col).alias("_cs"))
    near = nearest_value_join(treated, control, "treated_score", "_cs", "_cid", max_gap=caliper)
    return near.filter(F.col("match_id").isNotNull()).select(
        "treated_id", F.col("match_id").alias("control_id"), "treated_score", F.col("match_value").alias("control_score"), F.col("match_gap").alias("gap"))


#: distinct scores one task settles at a time
CELL_SCORES = 50_000


def _settle_cell(caliper):
    """Pairs of one cell of scores that are nearest to each other whatever happens outside, and what stays open.

    Rows: score, units left (treated above, control below 0), units used, and the nearest treated and control scores
    outside the cell (``_lt _lc _rt _rc``). Every score waits in a heap with its nearest live score of the other arm, by
    gap, then by the lower score. When it is its turn, both are nearest to each other, unless one of them has a nearer
    partner outside or waits for one that is open; then it is open too. Partners only become fewer, outside as well, so
    what is settled holds. Scores without a partner in reach leave.
    """
    import heapq

    inf = float("inf")

    def settle(pdf):
        pdf = pdf.sort_values("_s", ignore_index=True)
        s, left = pdf["_s"].tolist(), pdf["_left"].tolist()
        used = [pdf["_ut"].tolist(), pdf["_uc"].tolist()]
        n = len(s)
        # nearest live place of an arm (0 treated, 1 control) at or above, at or below a place: pointers that skip the dead
        arm = [int(x < 0) for x in left]
        up = [[k if arm[k] == side else k + 1 for k in range(n)] + [n] for side in (0, 1)]
        down = [[0] + [k if arm[k - 1] == side else k - 1 for k in range(1, n + 1)] for side in (0, 1)]  # by place + 1

        def find(pointers, k):
            end = k
            while pointers[end] != end:
                end = pointers[end]
            while pointers[k] != end:
                pointers[k], k = end, pointers[k]
            return end

        def edge(name, missing):
            value = pdf[name].iloc[0]
            return missing if pd.isna(value) else float(value)

        below = (edge("_lt", -inf), edge("_lc", -inf))
        above = (edge("_rt", inf), edge("_rc", inf))

        def nearest(k):
            """(gap, lower score, place) of the nearest live score of the other arm in the cell; the lower one of two."""
            side = 1 - arm[k]
            lo, hi = find(down[side], k + 1) - 1, find(up[side], k)
            low = s[k] - s[lo] if lo >= 0 else inf
            high = s[hi] - s[k] if hi < n else inf
            return (low, s[lo], lo) if low <= high and lo >= 0 else (high, s[k], hi)

        def outside_first(k, gap, partner):
            side = 1 - arm[k]
            low, high = s[k] - below[side], above[side] - s[k]
            return low < gap or high < gap or (low == gap and partner > k)

        opened, out, heap = [False] * n, [], []

        def wait(k):
            gap, lower, j = nearest(k)
            if gap <= caliper:
                heapq.heappush(heap, (gap, lower, k, j))

        for k in range(n):
            wait(k)
        while heap:
            gap, _, i, j = heapq.heappop(heap)
            if not left[i] or opened[i]:
                continue
            if not left[j]:
                wait(i)
                continue
            if opened[j] or outside_first(i, gap, j) or outside_first(j, gap, i):
                opened[i] = True
                opened[j] = opened[j] or outside_first(j, gap, i)
                continue
            t, c = (i, j) if left[i] > 0 else (j, i)
            units = min(left[t], -left[c])
            out.append((True, s[t], s[c], used[0][t], used[1][c], units))
            left[t], left[c] = left[t] - units, left[c] + units
            used[0][t], used[1][c] = used[0][t] + units, used[1][c] + units
            for k in (t, c):
                if not left[k]:
                    up[arm[k]][k], down[arm[k]][k + 1] = k + 1, k
                else:
                    wait(k)
        for k in range(n):
            side = 1 - arm[k]
            if left[k] and min(nearest(k)[0], s[k] - below[side], above[side] - s[k]) <= caliper:
                out.append((False, s[k], None, used[0][k], used[1][k], left[k]))
        return pd.DataFrame(out, columns=["_paired", "_s", "_cs", "_ut", "_uc", "_left"])

    return settle


def _cells_with_neighbours(state, cells):
    """Rows by ranges of the score, each with the nearest scores of both arms outside its range."""
    cut = durable(state.repartitionByRange(cells, "_s").withColumn("_cell", F.spark_partition_id()))
    t, c = F.when(F.col("_left") > 0, F.col("_s")), F.when(F.col("_left") < 0, F.col("_s"))
    edges = cut.groupBy("_cell").agg(F.max(t).alias("_xt"), F.max(c).alias("_xc"), F.min(t).alias("_nt"), F.min(c).alias("_nc"))
    by = Window.partitionBy(F.lit(0))  # one row per cell
    before = by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_cell", F.last("_xt", True).over(before).alias("_lt"), F.last("_xc", True).over(before).alias("_lc"),
                         F.last("_nt", True).over(after).alias("_rt"), F.last("_nc", True).over(after).alias("_rc"))
    return cut.join(edges, "_cell")


def match_without_replacement(df, unit, arm, score_col, caliper, hot_rows=None, cluster_limit=None):
    """Greedy nearest 1:1 matching, each control used once; of equal gaps the pair with the lower score goes first.

    The state is one row per distinct score with the units its larger arm has left (equal scores pair off first, so ties
    of any size are one step). In each round the scores are cut into ranges of about ``cluster_limit`` at most, and a task
    contracts its range: every pair that is nearest to each other whatever happens outside is settled, chains of them to
    their end. Only chains that lead over a border stay, so few rows are left for the next round, which cuts elsewhere.
    The state is written out per round.
    """
    cell_scores = CELL_SCORES if cluster_limit is None else cluster_limit
    base = df.filter(F.col(arm).isin(0, 1) & F.col(score_col).isNotNull()).select(
        F.col(unit).alias("_u"), F.col(arm).cast("int").alias("_a"), F.col(score_col).cast("double").alias("_s"))
    units = durable(OrderedScan(base, ["_a", "_s"], ["_u"], hot_rows=hot_rows).add(_k=row_number()).result())
    counts = durable(units.groupBy("_s").agg(F.count(F.when(F.col("_a") == 1, 1)).alias("_nt"), F.count(F.when(F.col("_a") == 0, 1)).alias("_nc")))
    same = F.least("_nt", "_nc")
    settled = [counts.filter(same > 0).select("_s", F.col("_s").alias("_cs"), F.lit(0).cast("bigint").alias("_ut"), F.lit(0).cast("bigint").alias("_uc"), same.alias("_left"))]
    state = counts.select("_s", (F.col("_nt") - F.col("_nc")).alias("_left"), same.alias("_ut"), same.alias("_uc")).filter("_left <> 0")
    n, extra = state.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while n:
        cells = -(-n // cell_scores) + extra
        done = durable(_cells_with_neighbours(state, min(cells, n)).groupBy("_cell").applyInPandas(
            _settle_cell(float(caliper)), "_paired boolean, _s double, _cs double, _ut long, _uc long, _left long"))
        settled.append(done.filter("_paired").drop("_paired"))
        state = done.filter("NOT _paired").select("_s", "_left", "_ut", "_uc")
        before, n = n, state.count()
        extra = 0 if n < before else extra + 1  # a border ran through the only pairs: cut elsewhere
        extra = 0 if n <= cell_scores else extra
    pairs = reduce(lambda a, b: a.unionByName(b), settled).withColumnRenamed("_left", "_n")
    # a score's units are numbered; a pair of scores takes the numbers after those used before it
    t = asof_prior(units.filter("_a = 1"), pairs, "_s", "_k", "_ut", ["_ut", "_cs", "_uc", "_n"], hot_rows=hot_rows).filter(F.col("_k") <= F.col("prior__ut") + F.col("prior__n"))
    t = t.select(F.col("_u").alias("treated_id"), F.col("_s").alias("treated_score"), F.col("prior__cs").alias("control_score"),
                 (F.col("prior__uc") + F.col("_k") - F.col("prior__ut")).alias("_k"))
    c = units.filter("_a = 0").select(F.col("_s").alias("control_score"), "_k", F.col("_u").alias("control_id"))
    return t.join(c, ["control_score", "_k"]).select("treated_id", "control_id", "treated_score", "control_score",
                                                      F.abs(F.col("treated_score") - F.col("control_score")).alias("gap"))


def psm_match(df, unit, arm, xs=None, score_col=None, caliper=0.2, replace=False, hot_rows=None):
    """1:1 nearest propensity matching within ``caliper`` standard deviations of the score.

    The pair id is the treated unit's id, which is unique per pair.
    """
    scored = df if score_col else propensity(df, unit, arm, xs)
    score_col = score_col or "propensity"
    width = caliper_width(scored, score_col, caliper)
    if replace:
        pairs = match_with_replacement(scored, unit, arm, score_col, width)
    else:
        pairs = match_without_replacement(scored, unit, arm, score_col, width, hot_rows)
    return pairs.withColumn("pair_id", F.col("treated_id"))


class TLearner:
    """Two outcome models, one per arm; uplift is the difference of their predictions."""

    def __init__(self, xs, treatment, outcome, **tree_options):
        self.xs, self.treatment, self.outcome, self.options = list(xs), treatment, outcome, tree_options

    def fit(self, df):
        arm = F.col(self.treatment).cast("int")
        self.m1 = fit_trees(df.filter(arm == 1), self.xs, self.outcome, **self.options)
        self.m0 = fit_trees(df.filter(arm == 0), self.xs, self.outcome, **self.options)
        return self

    def predict(self, df, name="uplift"):
        out = score(self.m0, score(self.m1, df, self.xs, "p_treated"), self.xs, "p_control")
        return out.withColumn(name, F.col("p_treated") - F.col("p_control"))


class XLearner(TLearner):
    """T-learner outcome models, regressions of the imputed effects, and their blend by propensity or plain mean.

    Effects are imputed from probabilities, and scoring happens in one frame.
    """

    def __init__(self, xs, treatment, outcome, weighting="propensity", **tree_options):
        super().__init__(xs, treatment, outcome, **tree_options)
        if weighting not in ("propensity", "mean"):
            raise ValueError("weighting is propensity or mean")
        self.weighting = weighting

    def fit(self, df):
        super().fit(df)
        return self.fit_effects(TLearner.predict(self, df, "_t"))

    def fit_effects(self, both):
        """Effect and propensity models from rows that have ``p_treated`` and ``p_control``."""
        arm, y = F.col(self.treatment).cast("int"), F.col(self.outcome).cast("double")
        effect = {k: v for k, v in self.options.items() if k != "kind"}
        self.tau1 = fit_trees(both.filter(arm == 1).withColumn("_d", y - F.col("p_control")), self.xs, "_d", "regression", **effect)
        self.tau0 = fit_trees(both.filter(arm == 0).withColumn("_d", F.col("p_treated") - y), self.xs, "_d", "regression", **effect)
        self.e = fit_trees(both.withColumn("_a", arm.cast("double")), self.xs, "_a", **self.options) if self.weighting == "propensity" else None
        return self

    def predict(self, df, name="uplift"):
        out = score(self.tau0, score(self.tau1, df, self.xs, "tau_treated", "regression"), self.xs, "tau_control", "regression")
        if self.e is None:
            return out.withColumn(name, (F.col("tau_treated") + F.col("tau_control")) / 2)
        out = score(self.e, out, self.xs, "propensity")
        return out.withColumn(name, F.col("propensity") * F.col("tau_control") + (1 - F.col("propensity")) * F.col("tau_treated"))


def cross_fit(learner, df, key, folds=5, seed=0, name="uplift"):
    """Uplift of every row from models that have not seen its fold (by the md5 of ``key``), in one frame with ``fold``.

    An X-learner is cross-fitted twice: effects are imputed from outcome models of the other folds, and the effect and
    propensity models that score a fold are fitted on the other folds' imputed effects."""
    rows = durable(df.withColumn("fold", (md5_bucket64(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))) % folds).cast("int")))
    others, own = lambda frame, k: frame.filter(F.col("fold") != k), lambda frame, k: frame.filter(F.col("fold") == k)
    union = lambda parts: durable(reduce(lambda a, b: a.unionByName(b), parts))
    outcome = TLearner(learner.xs, learner.treatment, learner.outcome, **learner.options)
    scored = union([outcome.fit(others(rows, k)).predict(own(rows, k), name) for k in range(folds)])
    if not isinstance(learner, XLearner):
        return scored
    scored = scored.drop(name)
    return union([learner.fit_effects(others(scored, k)).predict(own(scored, k), name) for k in range(folds)])


def transformed_outcome_tree(df, xs, treatment, outcome, p=None, max_depth=4, seed=7):
    """Regression tree on y*t/p - y*(1-t)/(1-p); p is the treated share unless given. Returns (scored frame, model)."""
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    if p is None:
        p = float(df.agg(F.avg(t).alias("p")).first().p)
    frame = df.withColumn("_z", y * t / p - y * (1 - t) / (1 - p)).withColumns({x: F.col(x).cast("double") for x in xs})
    model = Pipeline(stages=[VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="keep"),
                             DecisionTreeRegressor(labelCol="_z", maxDepth=max_depth, seed=seed)]).fit(frame)
    return score(model, df, xs, "uplift", "regression"), model


def segment_uplift(df, segment, xs, treatment, outcome, min_n=100, cutoff=0.0, reg=0.0):
    """Two logistic outcome models per segment with both arms of at least ``min_n``, all of them iterated together:
    mean uplift and the share with an uplift above ``cutoff``. Smaller segments are reported unscored."""
    arm = F.col(treatment).cast("int")
    data = df.select(F.col(segment).alias("segment"), arm.alias("_a"), *xs, F.col(outcome).cast("double").alias("_y"))
    sizes = data.groupBy("segment").agg(F.count(F.when(F.col("_a") == 1, 1)).alias("n_treated"), F.count(F.when(F.col("_a") == 0, 1)).alias("n_control"))
    large = sizes.filter(F.least("n_treated", "n_control") >= min_n).select("segment", F.lit(True).alias("_large"))
    fitted = null_safe_join(data, large, ["segment"], "inner").drop("_large")
    model = fit_logits(fitted, xs, "_y", ["segment", "_a"], reg)
    for side in (1, 0):
        fitted = model.transform(fitted.withColumn("_own", F.col("_a")).withColumn("_a", F.lit(side)), f"_p{side}").withColumn("_a", F.col("_own")).drop("_own")
    gain = F.col("_p1") - F.col("_p0")
    found = fitted.groupBy("segment").agg(F.avg(gain).alias("mean_uplift"), F.avg(F.when(gain > cutoff, 1.0).otherwise(0.0)).alias("targeted_share"))
    return null_safe_join(sizes.withColumn("_s", F.col("segment")), found, ["segment"]).select(F.col("_s").cast("string").alias("segment"), "n_treated", "n_control", "mean_uplift", "targeted_share")


def daily_metric(events, ts, metric):
    return events.groupBy(F.to_date(ts).alias("day")).agg(metric.alias("y"))


def its(daily, day, y, start):
    """Interrupted time series: y ~ t + post + (days since start), t = 0 on the first day, 0 on the first post day.

    Returns (terms, daily rows with fitted, counterfactual, effect and running effect, one-row summary). The input is
    a daily series, at most a few thousand rows.
    """
    from cohortspark.operators.stats import ols

    first_day = daily.agg(F.min(day).alias("d")).first().d
    begin = F.lit(start).cast("date")
    t = F.datediff(F.col(day), F.lit(first_day))
    post = F.when(F.col(day) >= begin, 1.0).otherwise(0.0)
    frame = daily.select(F.col(day).alias("day"), F.col(y).cast("double").alias("y"), t.cast("double").alias("time"), post.alias("post"),
                         (post * F.datediff(F.col(day), begin)).alias("time_after"))
    terms, fit = ols(frame, "y", ["time", "post", "time_after"])
    b = fit["coef"]
    cf = F.lit(b["intercept"]) + F.lit(b["time"]) * F.col("time")
    fitted = cf + F.lit(b["post"]) * F.col("post") + F.lit(b["time_after"]) * F.col("time_after")
    rows = frame.withColumns({"fitted": fitted, "counterfactual": cf}).withColumn("effect", F.when(F.col("post") == 1, F.col("y") - F.col("counterfactual")).otherwise(0.0))
    rows = OrderedScan(rows, [], ["day"]).add(cumulative_effect=running_sum("effect")).result()
    after = F.col("post") == 1
    summary = rows.agg(F.sum(F.when(after, F.col("effect"))).alias("cumulative_effect"), F.avg(F.when(after, F.col("effect"))).alias("mean_effect"),
                       (F.sum(F.when(after, F.col("effect"))) / F.nullif(F.sum(F.when(after, F.col("counterfactual"))), F.lit(0.0))).alias("relative_effect"))
    summary = summary.withColumns({"level_change": F.lit(b["post"]), "trend_change": F.lit(b["time_after"]), "r2": F.lit(fit["r2"])})
    return terms, rows, summary
