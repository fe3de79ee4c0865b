"""Regression, classification, evaluation and clustering. Fitting runs on executors; the driver sees p x p statistics."""

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import functions as F

from cohortspark.functions.exprs import prob1, safe_div
from cohortspark.functions.tails import norm_sf2
from cohortspark.operators.aggs import percentiles
from cohortspark.operators.joins import with_totals
from cohortspark.operators.logits import auc_by, fit_logits, refuse_nulls
from cohortspark.operators.ordered import OrderedScan, key_sum, null_safe_join, row_number, running_sum
from cohortspark.operators.windows import hash_order, in_fraction, ntile_bucket, sample_fraction


def assemble(df, xs, out="features"):
    """Feature vectors. A NULL feature is an error, never a dropped row: impute first (``prep.impute``)."""
    doubles = df.withColumns({x: F.col(x).cast("double") for x in xs})
    return VectorAssembler(inputCols=list(xs), outputCol=out, handleInvalid="error").transform(doubles)


# ---------------------------------------------------------------- logistic regression


def fit_logit(df, xs, y, by=None, reg=0.0, max_iter=50, key=None, test=0.0, seed=0):
    """Standardised logistic regression, overall or per value of ``by`` (all values iterated together): coefficient on
    the raw scale, odds ratio, percent impact of one standard deviation, AUC on the rows fitted and, with a share
    ``test`` of the values of ``key`` held out, on those. Returns (terms frame, fitted ``Logits``)."""
    names, groups = list(xs), [] if by is None else [by]
    held_out = F.lit(False) if not test else ~in_fraction(key, 1.0 - test, seed)
    data = df.withColumn("_test", held_out)
    model = fit_logits(data.filter(~F.col("_test")), names, y, groups, reg, max_iter)
    scored = model.transform(data.select(*groups, *names, F.col(y).cast("int").alias("_y"), "_test"), "_p")
    auc = auc_by(scored, "_p", "_y", [*groups, "_test"])
    auc = auc.groupBy(*groups).agg(F.max(F.when(~F.col("_test"), F.col("auc"))).alias("auc"), F.max(F.when(F.col("_test"), F.col("auc"))).alias("auc_test"))
    place = F.posexplode(F.array(*[F.lit(x) for x in names])).alias("_i", "term")
    cohort = F.col(by).cast("string") if groups else F.lit(None).cast("string")
    table = null_safe_join(model.cohorts, auc, groups) if groups else with_totals(model.cohorts, auc)
    table = table.select(cohort.alias("cohort"), "_beta", "_sd", "auc", "auc_test", place)
    beta, sd = F.element_at("_beta", F.col("_i") + 2), F.element_at("_sd", F.col("_i") + 1)
    raw = F.when(sd > 0, beta / sd).otherwise(0.0)
    return table.select("cohort", "term", raw.alias("coef"), F.exp(raw).alias("odds_ratio"), beta.alias("coef_per_sd"),
                        ((F.exp(beta) - 1) * 100.0).alias("pct_impact_per_sd"), "auc", "auc_test"), model


def _sums(frame, xs, y, beta, inv=None):
    """Per Arrow batch: X'WX, X'(y-p), log likelihood, sum p(1-p) and, with ``inv``, the HC3 meat; summed by Spark."""
    p = len(xs) + 1
    inv_list = None if inv is None else inv.tolist()

    def batch_sums(batches):
        b = np.asarray(beta)
        v = None if inv_list is None else np.asarray(inv_list)
        total = None
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[xs].to_numpy(float)])
            t = pdf[y].to_numpy(float)
            eta = x @ b
            mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
            w = mu * (1 - mu)
            ll = float(np.sum(t * eta - np.logaddexp(0.0, eta)))
            parts = [(x.T * w) @ x]
            if v is not None:
                h = np.clip(w * np.einsum("ij,jk,ik->i", x, v, x), 0.0, 1 - 1e-9)
                r = (t - mu) / (1 - h)
                parts.append((x.T * (r * r)) @ x)
            flat = np.concatenate([m.ravel() for m in parts] + [x.T @ (t - mu), [ll, w.sum(), len(pdf), t.sum()]])
            total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    sums = frame.mapInPandas(batch_sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(max(r.i for r in sums) + 1)
    for r in sums:
        flat[r.i] = r.v
    k = p * p
    out = {"hess": flat[:k].reshape(p, p)}
    if inv is not None:
        out["meat"] = flat[k:2 * k].reshape(p, p)
        k *= 2
    out["grad"] = flat[k:k + p]
    out["ll"], out["w"], out["n"], out["ones"] = flat[k + p:k + p + 4]
    return out


def logit_inference(df, xs, y, robust=True, max_iter=30, tol=1e-9):
    """Maximum-likelihood logit with HC3 (or model) standard errors, p, CI, odds ratios, average marginal effects and
    McFadden's pseudo R2. Newton steps use one distributed pass each; only p x p sums are collected. NULL or NaN values
    are an error, as in every fit here."""
    xs = list(xs)
    frame = refuse_nulls(df.select(*xs, y), [*xs, y]).persist()
    try:
        beta = np.zeros(len(xs) + 1)
        s = _sums(frame, xs, y, beta.tolist())
        for _ in range(max_iter):
            step = np.linalg.pinv(s["hess"]) @ s["grad"]
            scale, nxt = 1.0, None
            while scale > 1e-4:
                nxt = _sums(frame, xs, y, (beta + scale * step).tolist())
                if nxt["ll"] >= s["ll"] - 1e-12 * abs(s["ll"]):
                    break
                scale /= 2
            beta = beta + scale * step
            s = nxt
            if float(np.max(np.abs(scale * step))) < tol:
                break
        inv = np.linalg.pinv(s["hess"])
        cov = inv
        if robust:
            meat = _sums(frame, xs, y, beta.tolist(), inv)["meat"]
            cov = inv @ meat @ inv
    finally:
        frame.unpersist()
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    rate = s["ones"] / s["n"]
    ll0 = s["n"] * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate)) if 0 < rate < 1 else 0.0
    r2 = float(1 - s["ll"] / ll0) if ll0 else None
    rows = [(name, float(b), float(e), float(b / e) if e > 0 else None, float(math.exp(min(b, 700))), float(b * s["w"] / s["n"]), r2, float(s["n"]))
            for name, b, e in zip(["intercept"] + xs, beta, se)]
    out = df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, odds_ratio double, ame double, pseudo_r2 double, n double")
    return out.withColumns({"p_value": norm_sf2("z"), "ci_low": F.col("coef") - 1.959963984540054 * F.col("se"), "ci_high": F.col("coef") + 1.959963984540054 * F.col("se")})


def glm_binomial(df, xs, y, eps=1e-6):
    """Fractional-response logit: y in [0, 1] clipped to (eps, 1 - eps)."""
    data = assemble(df.withColumn("_y", F.least(F.greatest(F.col(y).cast("double"), F.lit(eps)), F.lit(1 - eps))), xs)
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="_y", maxIter=50).fit(data)
    s = model.summary
    names, coefs = list(xs) + ["intercept"], list(model.coefficients.toArray()) + [model.intercept]
    rows = [(n, float(c), float(e), float(p)) for n, c, e, p in zip(names, coefs, s.coefficientStandardErrors, s.pValues)]
    fit = {"deviance": s.deviance, "null_deviance": s.nullDeviance, "pseudo_r2": 1 - s.deviance / s.nullDeviance if s.nullDeviance else None}
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, p_value double"), fit


def vif(df, xs):
    """Variance inflation factors: diagonal of the inverse correlation matrix."""
    matrix = Correlation.corr(assemble(df.select(*xs), xs).select("features"), "features").first()[0].toArray()
    values = np.diag(np.linalg.pinv(matrix))
    return df.sparkSession.createDataFrame([(x, float(v)) for x, v in zip(xs, values)], "term string, vif double")


def corr_matrix(df, xs, ys):
    """Pearson correlations covariates x targets in long form, one aggregate."""
    wide = df.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"c{i}_{j}") for i, x in enumerate(xs) for j, y in enumerate(ys)])
    rows = [F.struct(F.lit(x).alias("covariate"), F.lit(y).alias("target"), F.col(f"c{i}_{j}").alias("corr")) for i, x in enumerate(xs) for j, y in enumerate(ys)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---------------------------------------------------------------- trees, split, evaluation


def fit_trees(df, xs, y, task="classification", kind="gbt", max_iter=20, max_depth=4, seed=7):
    """Boosted trees or random forest on an assembled frame. Returns the fitted pipeline."""
    frame = df.withColumns({x: F.col(x).cast("double") for x in xs}).withColumn(y, F.col(y).cast("double"))
    common = dict(labelCol=y, featuresCol="features", maxDepth=max_depth, seed=seed)
    if task == "regression":
        stage = GBTRegressor(maxIter=max_iter, **common)
    elif kind == "forest":
        stage = RandomForestClassifier(numTrees=max_iter, bootstrap=max_iter > 1, **common)  # one tree sees every row
    else:
        stage = GBTClassifier(maxIter=max_iter, **common)
    return Pipeline(stages=[VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="keep"), stage]).fit(frame)


def score(model, df, xs, name, task="classification"):
    """Add the model's probability (or prediction) as column ``name``."""
    frame = df.withColumns({f"_x_{x}": F.col(x) for x in xs}).withColumns({x: F.col(x).cast("double") for x in xs})
    out = model.transform(frame)
    value = prob1("probability") if task == "classification" else F.col("prediction")
    kept = [c for c in df.columns if c not in xs]
    return out.select(*kept, *[F.col(f"_x_{x}").alias(x) for x in xs], value.alias(name)).select(*df.columns, name)


def fit_gbt(df, xs, y, task="classification", key=None, test=0.0, seed=0, **options):
    """(importance table in percent, fitted pipeline, AUC or None). With a share ``test`` of the values of ``key`` held
    out, the model is fitted on the others and the AUC is that of the held-out rows; without, of the rows fitted."""
    train, rest = (df, df) if not test else split(df, key, 1.0 - test, seed)
    model = fit_trees(train, xs, y, task, **options)
    weights = model.stages[-1].featureImportances.toArray()
    total = float(weights.sum()) or 1.0
    table = df.sparkSession.createDataFrame([(x, float(w) * 100.0 / total) for x, w in zip(xs, weights)], "feature string, importance_pct double")
    auc = None
    if task == "classification":
        auc = evaluate(score(model, rest, xs, "_p"), "_p", y).first()["auc"]
    return table, model, auc


def split(df, key, frac=0.8, seed=0, strata=None):
    """Train/test split repeatable by key hash; with ``strata`` the share is exact within each stratum."""
    if strata is None:
        return sample_fraction(df, key, frac, seed), df.filter(~in_fraction(key, frac, seed))
    scan = OrderedScan(df.withColumn("_ho", hash_order(key, seed)), [strata], ["_ho", key]).add(_rn=row_number(), _all=key_sum(F.lit(1)))
    coded = scan.derive(_in=F.col("_rn") <= F.round(F.col("_all") * F.lit(float(frac)))).result().drop("_ho", "_rn", "_all")
    return coded.filter("_in").drop("_in"), coded.filter("NOT _in").drop("_in")


def evaluate(pred, score_col, label, cutoff=0.5, hot_rows=None):
    """One row: n, positives, exact ROC AUC (tie-aware rank sum), log loss and the confusion counts."""
    y, s = F.col(label).cast("int"), F.col(score_col)
    per = pred.filter(s.isNotNull()).groupBy(score_col).agg(F.sum(y).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    ranked = OrderedScan(per, [], [score_col], hot_rows=hot_rows).add(_upto=running_sum("_n")).derive(_before=F.col("_upto") - F.col("_n")).result()
    c = F.least(F.greatest(s, F.lit(1e-15)), F.lit(1 - 1e-15))
    n, p = F.col("_n"), F.col("_pos")
    loss = -(p * F.log(c) + (n - p) * F.log(1 - c))
    hit = s >= cutoff
    row = ranked.agg(
        F.sum(n).alias("n"), F.sum(p).alias("positives"), F.sum(p * (F.col("_before") + (n + 1) / 2.0)).alias("_rs"), F.sum(loss).alias("_l"),
        F.sum(F.when(hit, p).otherwise(0)).alias("tp"), F.sum(F.when(hit, n - p).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(p)).alias("fn"), F.sum(F.when(hit, 0).otherwise(n - p)).alias("tn"))
    pos, neg = F.col("positives"), F.col("n") - F.col("positives")
    auc = (F.col("_rs") - pos * (pos + 1) / 2.0) / F.nullif((pos * neg).cast("double"), F.lit(0.0))
    return row.select("n", "positives", auc.alias("auc"), (F.col("_l") / F.col("n")).alias("log_loss"), "tp", "fp", "fn", "tn")


def score_deciles(df, score_col, label, key, n=10, hot_rows=None):
    """Per score decile (1 = highest): units, converters, rate, min/max/mean/median score and lift over the bottom decile."""
    cut = ntile_bucket(df, [f"-{score_col}", key], n, name="decile", hot_rows=hot_rows)
    y = F.col(label).cast("int")
    table = cut.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("converters"), F.avg(y.cast("double")).alias("rate"),
                                      F.min(score_col).alias("min_score"), F.max(score_col).alias("max_score"), F.avg(score_col).alias("mean_score"))
    table = table.join(percentiles(cut, ["decile"], score_col, [0.5], ["median_score"], hot_rows=hot_rows), "decile")
    bottom = cut.filter(F.col("decile") == n).agg(F.avg(y.cast("double")).alias("_b"))
    return with_totals(table, bottom).withColumn("lift_vs_bottom", safe_div("rate", "_b")).drop("_b")


# ---------------------------------------------------------------- clustering


def cluster_sessions(df, xs, k_range, seed=7, max_iter=20):
    """K-means over a range of k on standardised features: (k, inertia, silhouette) table, the frame with the best
    silhouette's ``cluster``, and the chosen k. One cluster has no silhouette."""
    data = assemble(df, xs, "_raw")
    data = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(data).transform(data).persist()
    try:
        rows, best = [], None
        for k in k_range:
            if k == 1:  # all rows around their mean, which is 0
                square = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, v: s + v * v)
                model, inertia, sil = None, data.agg(F.sum(square)).first()[0], None
            else:
                model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(data)
                inertia = float(model.summary.trainingCost)
                sil = float(ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(model.transform(data)))
            rows.append((int(k), inertia, sil))
            if best is None or (sil is not None and (best[1] is None or sil > best[1])):
                best = (k, sil, model)
        table = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
        labelled = data.withColumn("prediction", F.lit(0)) if best[2] is None else best[2].transform(data)
        out = labelled.withColumnRenamed("prediction", "cluster").drop("_raw")
    finally:
        data.unpersist()
    return table, out, best[0]


def profile_clusters(df, cluster, xs):
    """Size, share and feature means per cluster in one grouped pass."""
    table = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"mean_{x}") for x in xs])
    return with_totals(table, df.agg(F.count(F.lit(1)).alias("_t"))).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def davies_bouldin(df, features, cluster):
    """Davies-Bouldin index: centroids and mean distances by aggregates, the k x k comparison on k rows."""
    if df.schema[features].dataType.typeName() == "array":
        df = df.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))
    centers = df.groupBy(cluster).agg(vector_to_array(Summarizer.mean(F.col(features))).alias("_c"))
    far = F.sqrt(F.aggregate(F.zip_with(vector_to_array(features), "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    spread = df.join(centers, cluster).groupBy(cluster).agg(F.avg(far).alias("_s"))
    rows = centers.join(spread, cluster).collect()  # k rows
    c, s = np.array([r["_c"] for r in rows]), np.array([r["_s"] for r in rows])
    worst = [max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    return df.sparkSession.createDataFrame([(len(rows), float(np.mean(worst)))], "k int, davies_bouldin double")


def pca2(df, features, k=2):
    """First k principal components as columns pc1.. and the explained-variance table."""
    if df.schema[features].dataType.typeName() == "array":
        df = df.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))
    model = PCA(k=k, inputCol=features, outputCol="_pc").fit(df)
    pcs = vector_to_array("_pc")
    out = model.transform(df).withColumns({f"pc{i + 1}": pcs[i] for i in range(k)}).drop("_pc")
    table = df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())], "component int, explained double")
    return out, table
