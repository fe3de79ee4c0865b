"""Significance tests, effect sizes, balance and power. Raw data is reduced to moments by one aggregate; p-values are
computed on the result rows."""

from pyspark.sql import functions as F

from cohortspark.functions.exprs import classify, safe_div
from cohortspark.functions.tails import chi2_sf, norm_ppf, norm_sf2, t_sf2
from cohortspark.operators.ordered import value_ranks

Z95 = norm_ppf(0.975)


def ztest_prop(df, x1, n1, x2, n2, z_crit=Z95):
    """Pooled two-proportion z-test of group 1 against group 2 with the unpooled confidence interval."""
    a, b = F.col(n1).cast("double"), F.col(n2).cast("double")
    p1, p2 = safe_div(x1, n1), safe_div(x2, n2)
    pool = safe_div(F.col(x1) + F.col(x2), F.col(n1) + F.col(n2))
    se = F.sqrt(pool * (1 - pool) * (1 / F.nullif(a, F.lit(0.0)) + 1 / F.nullif(b, F.lit(0.0))))
    out = df.withColumns({"rate_1": p1, "rate_2": p2, "rate_diff": p1 - p2, "se": F.nullif(se, F.lit(0.0))})
    out = out.withColumn("z", F.col("rate_diff") / F.col("se")).withColumn("p_value", norm_sf2("z"))
    wide = F.sqrt(p1 * (1 - p1) / F.nullif(a, F.lit(0.0)) + p2 * (1 - p2) / F.nullif(b, F.lit(0.0)))
    return out.withColumns({"ci_low": F.col("rate_diff") - z_crit * wide, "ci_high": F.col("rate_diff") + z_crit * wide})


def two_arm_moments(df, arm, treatment, control, metric, by=()):
    """n, mean and variance of a metric in both arms, one aggregate."""
    v = F.col(metric).cast("double")
    t, c = F.when(F.col(arm) == treatment, v), F.when(F.col(arm) == control, v)
    return df.groupBy(*by).agg(F.count(t).alias("n_t"), F.avg(t).alias("mean_t"), F.var_samp(t).alias("var_t"),
                               F.count(c).alias("n_c"), F.avg(c).alias("mean_c"), F.var_samp(c).alias("var_c"))


def ztest_mean(df, arm, treatment, control, metric, by=(), z_crit=1.96):
    """Unpooled mean-difference z-test with a significance flag."""
    m = two_arm_moments(df, arm, treatment, control, metric, by)
    se = F.sqrt(safe_div("var_t", "n_t") + safe_div("var_c", "n_c"))
    m = m.withColumns({"diff": F.col("mean_t") - F.col("mean_c"), "se": F.nullif(se, F.lit(0.0))})
    m = m.withColumn("z", F.col("diff") / F.col("se"))
    return m.withColumn("p_value", norm_sf2("z")).withColumn("significant", (F.abs("z") > z_crit).cast("int"))


def cohens_d_col():
    pooled = ((F.col("n_t") - 1) * F.col("var_t") + (F.col("n_c") - 1) * F.col("var_c")) / F.nullif(F.col("n_t") + F.col("n_c") - 2, F.lit(0))
    return (F.col("mean_t") - F.col("mean_c")) / F.nullif(F.sqrt(pooled), F.lit(0.0))


def welch(df, arm, treatment, control, metric, by=(), p_values=True):
    """Welch t-test with Satterthwaite degrees of freedom, Cohen's d and the normal 95 % interval."""
    m = two_arm_moments(df, arm, treatment, control, metric, by)
    a, b = safe_div("var_t", "n_t"), safe_div("var_c", "n_c")
    dof = (a + b) * (a + b) / F.nullif(a * a / F.nullif(F.col("n_t") - 1, F.lit(0)) + b * b / F.nullif(F.col("n_c") - 1, F.lit(0)), F.lit(0.0))
    m = m.withColumns({"diff": F.col("mean_t") - F.col("mean_c"), "se": F.nullif(F.sqrt(a + b), F.lit(0.0)), "dof": dof, "cohens_d": cohens_d_col()})
    m = m.withColumns({"t": F.col("diff") / F.col("se"), "ci_low": F.col("diff") - Z95 * F.col("se"), "ci_high": F.col("diff") + Z95 * F.col("se")})
    return m.withColumn("p_value", t_sf2("t", "dof")) if p_values else m


def ttest_pooled(df, arm, treatment, control, metric, by=(), p_values=True):
    """Student t-test with the pooled variance."""
    m = two_arm_moments(df, arm, treatment, control, metric, by)
    dof = (F.col("n_t") + F.col("n_c") - 2).cast("double")
    pooled = ((F.col("n_t") - 1) * F.col("var_t") + (F.col("n_c") - 1) * F.col("var_c")) / F.nullif(dof, F.lit(0.0))
    se = F.sqrt(pooled * (1 / F.nullif(F.col("n_t").cast("double"), F.lit(0.0)) + 1 / F.nullif(F.col("n_c").cast("double"), F.lit(0.0))))
    m = m.withColumns({"diff": F.col("mean_t") - F.col("mean_c"), "se": F.nullif(se, F.lit(0.0)), "dof": dof})
    m = m.withColumn("t", F.col("diff") / F.col("se"))
    return m.withColumn("p_value", t_sf2("t", "dof")) if p_values else m


def count_test(df, x1, n1, x2, n2):
    """Difference of two event rates per unit with Poisson variance, and of two raw counts."""
    r1, r2 = safe_div(x1, n1), safe_div(x2, n2)
    se = F.sqrt(safe_div(r1, n1) + safe_div(r2, n2))
    out = df.withColumns({"rate_1": r1, "rate_2": r2, "z": (r1 - r2) / F.nullif(se, F.lit(0.0)),
                          "z_count": (F.col(x1) - F.col(x2)) / F.nullif(F.sqrt((F.col(x1) + F.col(x2)).cast("double")), F.lit(0.0))})
    return out.withColumn("p_value", norm_sf2("z")).withColumn("p_count", norm_sf2("z_count"))


def chi2(df, a, b, p_values=True):
    """Chi-square independence test of two categorical columns from their cell counts."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("_r")), cells.groupBy(b).agg(F.sum("o").alias("_c"))
    joined = cells.join(rows, a).join(cols, b)
    # sum (o - e)^2 / e = N * (sum o^2 / (r c) - 1), which also covers the empty cells
    stat = joined.agg(F.sum(F.col("o") * F.col("o") / (F.col("_r") * F.col("_c"))).alias("_s"), F.sum("o").alias("n"),
                      F.count_distinct(a).alias("_na"), F.count_distinct(b).alias("_nb"))
    out = stat.select("n", (F.col("n") * (F.col("_s") - 1)).alias("chi2"), ((F.col("_na") - 1) * (F.col("_nb") - 1)).cast("double").alias("dof"))
    return out.withColumn("p_value", chi2_sf("chi2", "dof")) if p_values else out


def mann_whitney(df, arm, treatment, control, metric, hot_rows=None):
    """Mann-Whitney U of treatment against control: average ranks from distinct values, tie-corrected normal p-value."""
    both = df.filter(F.col(arm).isin(treatment, control)).filter(F.col(metric).isNotNull())
    per = both.groupBy(metric).agg(F.count(F.when(F.col(arm) == treatment, 1)).alias("_t"), F.count(F.lit(1)).alias("_n"))
    ranked = value_ranks(per, metric, weight="_n", hot_rows=hot_rows)
    ranked = ranked.join(per.select(metric, "_t"), metric)
    rank = F.col("_before") + (F.col("_n") + 1) / 2.0
    n3 = F.col("_n").cast("double") * F.col("_n") * F.col("_n") - F.col("_n")
    s = ranked.agg(F.sum(F.col("_t") * rank).alias("_rs"), F.sum("_t").alias("n_t"), F.sum("_n").alias("_all"), F.sum(n3).alias("_ties"))
    s = s.withColumn("n_c", F.col("_all") - F.col("n_t"))
    u = F.col("_rs") - F.col("n_t") * (F.col("n_t") + 1) / 2.0
    mean = F.col("n_t") * F.col("n_c") / 2.0
    n = F.col("_all").cast("double")
    var = F.col("n_t") * F.col("n_c") / 12.0 * (n + 1 - F.col("_ties") / (n * (n - 1)))
    s = s.withColumns({"u": u, "z": (u - mean - F.signum(u - mean) * 0.5) / F.nullif(F.sqrt(var), F.lit(0.0))})
    return s.select("n_t", "n_c", "u", "z").withColumn("p_value", norm_sf2("z"))


def ols(df, y, xs):
    """Least squares with intercept; returns (DataFrame of terms, dict of fit).

    Two aggregates: means and deviations first, then the sums of products of standardised columns, so covariates far
    from zero (times in microseconds) lose no precision. Only (p+1)^2 sums reach the driver.
    """
    import numpy as np

    names = ["intercept"] + list(xs)
    yy = F.col(y).cast("double")
    data = df.filter(yy.isNotNull())
    for x in xs:
        data = data.filter(F.col(x).isNotNull())
    m = len(xs)
    raw = [F.col(x).cast("double") for x in xs] + [yy]
    row = data.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(raw) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = float(row["n"])
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(m + 1)])
    scale = np.array([row[f"s{i}"] or 0.0 for i in range(m + 1)])
    scale[scale == 0] = 1.0
    z = [(c - F.lit(float(mean[i]))) / F.lit(float(scale[i])) for i, c in enumerate(raw)]
    row = data.agg(*[F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i in range(m + 1) for j in range(i, m + 1)]).first()
    zz = np.zeros((m + 1, m + 1))
    for i in range(m + 1):
        for j in range(i, m + 1):
            zz[i, j] = zz[j, i] = row[f"a{i}_{j}"] or 0.0
    inv = np.linalg.pinv(zz[:m, :m])
    gamma = inv @ zz[:m, m]
    slopes = gamma * scale[m] / scale[:m]
    beta = np.r_[mean[m] - slopes @ mean[:m], slopes]
    sst = float(zz[m, m]) * scale[m] ** 2
    sse = max(0.0, float(zz[m, m] - gamma @ zz[:m, m])) * scale[m] ** 2
    dof = n - m - 1
    sigma2 = sse / dof if dof > 0 else float("nan")
    shape = inv / np.outer(scale[:m], scale[:m])
    se = np.sqrt(np.maximum(np.r_[1 / n + mean[:m] @ shape @ mean[:m] if n else 0.0, np.diag(shape)] * sigma2, 0.0))
    p = m + 1
    terms = [(names[i], float(beta[i]), float(se[i]), float(beta[i] / se[i]) if se[i] > 0 else None, float(dof)) for i in range(p)]
    out = df.sparkSession.createDataFrame(terms, "term string, coef double, se double, t double, dof double")
    out = out.withColumns({"p_value": t_sf2("t", "dof"), "ci_low": F.col("coef") - Z95 * F.col("se"),
                           "ci_high": F.col("coef") + Z95 * F.col("se")})
    return out, {"n": n, "r2": 1 - sse / sst if sst > 0 else float("nan"), "sigma2": sigma2, "coef": dict(zip(names, beta.tolist()))}


def interaction_ols(df, y, a, b):
    """y ~ a + b + a*b."""
    return ols(df.withColumn("a_x_b", F.col(a).cast("double") * F.col(b).cast("double")), y, [a, b, "a_x_b"])


def effect_size_interaction(df, a, b, metric):
    """Cohen's d of factor a at each level of factor b, and their difference."""
    m = two_arm_moments(df, a, 1, 0, metric, [b]).withColumn("d", cohens_d_col())
    wide = m.agg(F.max(F.when(F.col(b) == 0, F.col("d"))).alias("d_at_0"), F.max(F.when(F.col(b) == 1, F.col("d"))).alias("d_at_1"))
    return wide.withColumn("d_difference", F.col("d_at_1") - F.col("d_at_0"))


def balance(df, arm, treatment, control, covariates, limit=0.1):
    """Standardised mean difference per covariate, all in one aggregate."""
    aggs = []
    for x in covariates:
        for tag, value in (("t", treatment), ("c", control)):
            v = F.when(F.col(arm) == value, F.col(x).cast("double"))
            aggs += [F.avg(v).alias(f"_m{tag}_{x}"), F.var_samp(v).alias(f"_v{tag}_{x}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(x).alias("covariate"), F.col(f"_mt_{x}").alias("mean_t"), F.col(f"_mc_{x}").alias("mean_c"),
                     ((F.col(f"_mt_{x}") - F.col(f"_mc_{x}")) / F.nullif(F.sqrt((F.col(f"_vt_{x}") + F.col(f"_vc_{x}")) / 2), F.lit(0.0))).alias("smd")) for x in covariates]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("balanced", (F.abs("smd") < limit).cast("int"))


def sample_size(p, effect, alpha=0.05, power=0.8, mode="absolute", z_alpha=None, z_beta=None):
    """Units per arm to detect ``effect`` on a rate: Columns in, Column out.

    ``mode="as_written"`` divides by the effect relative to the rate instead, kept for comparison only.
    """
    z = (z_alpha or norm_ppf(1 - alpha / 2)) + (z_beta or norm_ppf(power))
    step = effect if mode == "absolute" else effect / F.nullif(p, F.lit(0.0))
    return F.ceil(2 * z * z * p * (1 - p) / F.nullif(step * step, F.lit(0.0)))


def duration(per_arm, daily_enrollment, scenarios=(("base", 1.0), ("high", 1.5), ("low", 0.8))):
    """Days to enrol both arms under each enrolment scenario."""
    return {f"days_{name}": F.ceil(2 * per_arm / F.nullif(daily_enrollment * factor, F.lit(0.0))) for name, factor in scenarios}


def sig_label(p):
    return classify([(F.col(p) < 0.001, "***"), (F.col(p) < 0.01, "**"), (F.col(p) < 0.05, "*")], "")


def two_arm_counts(df, arm, treatment, control, xs):
    """One row per outcome with treatment/control n and x."""
    aggs = [F.count(F.when(F.col(arm) == treatment, 1)).alias("n_t"), F.count(F.when(F.col(arm) == control, 1)).alias("n_c")]
    for x in xs:
        aggs += [F.sum(F.when(F.col(arm) == treatment, F.col(x))).cast("bigint").alias(f"_t_{x}"), F.sum(F.when(F.col(arm) == control, F.col(x))).cast("bigint").alias(f"_c_{x}")]
    rows = [F.struct(F.lit(x).alias("metric"), F.col(f"_t_{x}").alias("x_t"), F.col(f"_c_{x}").alias("x_c")) for x in xs]
    return df.agg(*aggs).select("n_t", "n_c", F.explode(F.array(*rows)).alias("r")).select("r.metric", "n_t", "n_c", "r.x_t", "r.x_c")
