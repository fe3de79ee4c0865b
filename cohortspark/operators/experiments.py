"""Experiment read-outs: exposure, metrics per arm, lift, moments, CUPED, cost per incremental order."""

from functools import reduce

from pyspark.sql import functions as F

from cohortspark.functions.exprs import plus, safe_div
from cohortspark.operators.aggs import unpivot
from cohortspark.operators.joins import window_join, with_totals
from cohortspark.operators.windows import limit_dimension


def first_exposure(exposures, unit, arm, ts, drop_arms=("overridden", "internal")):
    """First exposure per unit and arm without overridden or internal tags."""
    return exposures.filter(~F.col(arm).isin(*drop_arms)).groupBy(unit, arm).agg(F.min(ts).alias("exposure_ts"))


def unit_metrics(exposure, events, unit, arm, t0, ts, metrics, window_hours=None):
    """Per unit: metrics over events after exposure (optionally within a window); units without events get 0."""
    ev = events.withColumnRenamed(ts, "_ts") if ts != "_ts" else events
    hi = window_hours * 3600 if window_hours else None
    inside = window_join(exposure.select(unit, arm, t0), ev, unit, t0, "_ts", lo=0, hi=hi)
    per = inside.groupBy(unit, arm).agg(*[e.alias(n) for n, e in metrics.items()])
    out = exposure.select(unit, arm).join(per, [unit, arm], "left")
    return out.fillna(0, subset=list(metrics))


def arm_metrics(exposure, events, unit, arm, t0, ts, metrics, window_hours=None):
    """Per arm: units, sum and mean of each unit metric, and the share of units with a non-zero value."""
    per = unit_metrics(exposure, events, unit, arm, t0, ts, metrics, window_hours)
    return _summarise(per, [arm], metrics)


def _summarise(per, by, metrics):
    aggs = [F.count(F.lit(1)).alias("n_units")]
    for n in metrics:
        aggs += [F.sum(n).alias(f"{n}_total"), F.avg(n).alias(f"{n}_per_unit"), F.avg(F.when(F.col(n) > 0, 1.0).otherwise(0.0)).alias(f"{n}_unit_share")]
    return per.groupBy(*by).agg(*aggs)


def arm_metrics_windows(exposure, events, unit, arm, t0, ts, metrics, windows):
    """The same for several windows (hours) at once: one window join at the longest, rows fanned out to the windows
    that hold them. ``metrics`` maps a name to an aggregate Column."""
    ev = events.withColumnRenamed(ts, "_ts") if ts != "_ts" else events
    inside = window_join(exposure.select(unit, arm, t0), ev, unit, t0, "_ts", lo=0, hi=max(windows) * 3600)
    hours = F.array(*[F.when(F.col("_ts") <= plus(t0, hours=w), F.lit(int(w))) for w in windows])
    spread = inside.withColumn("window_hours", F.explode(F.array_compact(hours)))
    per = spread.groupBy(unit, arm, "window_hours").agg(*[e.alias(n) for n, e in metrics.items()])
    grid = exposure.select(unit, arm, F.explode(F.array(*[F.lit(int(w)) for w in windows])).alias("window_hours"))
    full = grid.join(per, [unit, arm, "window_hours"], "left").fillna(0, subset=list(metrics))
    return _summarise(full, [arm, "window_hours"], metrics)


def lift(df, arm, control, treatment, metrics, by=()):
    """Mean per arm, absolute and relative lift of treatment over control, one row per group and metric."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(F.when(F.col(arm) == control, F.col(m).cast("double"))).alias(f"_c_{m}"),
                 F.avg(F.when(F.col(arm) == treatment, F.col(m).cast("double"))).alias(f"_t_{m}")]
    wide = df.groupBy(*by).agg(F.count(F.when(F.col(arm) == control, 1)).alias("n_control"), F.count(F.when(F.col(arm) == treatment, 1)).alias("n_treatment"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_c_{m}").alias("control"), F.col(f"_t_{m}").alias("treatment")) for m in metrics]))
    out = wide.select(*by, "n_control", "n_treatment", rows.alias("r")).select(*by, "n_control", "n_treatment", "r.*")
    diff = F.col("treatment") - F.col("control")
    return out.withColumns({"abs_lift": diff, "rel_lift": safe_div(diff, "control")})


def ratio_moments(df, by, num, den):
    """Moments of a ratio metric per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("data_count"), F.avg(num).alias("mean_num"), F.avg(den).alias("mean_den"),
        F.var_samp(num).alias("var_num"), F.var_samp(den).alias("var_den"), F.covar_samp(num, den).alias("cov_num_den"))


def pooled_and_by_arm(df, arm, aggs, label="all_data"):
    """Aggregates per arm plus the pooled row from one GROUPING SETS pass."""
    out = df.groupingSets([[F.col(arm)], []], arm).agg(*[e.alias(n) for n, e in aggs.items()], F.grouping(arm).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(arm).cast("string")).alias(arm), *aggs)


def cuped_covariate(units, history, unit, covariate, fill="mean"):
    """Attach the pre-period covariate; a missing one becomes the covariate mean or the given number."""
    out = units.join(history.select(unit, F.col(covariate).cast("double").alias("_c")), unit, "left")
    if fill == "mean":
        out = with_totals(out, history.agg(F.avg(F.col(covariate).cast("double")).alias("_m")))
        return out.withColumn(covariate, F.coalesce("_c", "_m")).drop("_c", "_m")
    return out.withColumn(covariate, F.coalesce(F.col("_c"), F.lit(float(fill)))).drop("_c")


def cuped_moments(df, arm, num, den, cov):
    """Ratio-metric moments with the covariate's own and cross moments, per arm and pooled."""
    aggs = {"data_count": F.count(F.lit(1)), "mean_num": F.avg(num), "mean_den": F.avg(den), "mean_cov": F.avg(cov),
            "var_num": F.var_samp(num), "var_den": F.var_samp(den), "var_cov": F.var_samp(cov),
            "cov_num_den": F.covar_samp(num, den), "cov_num_cov": F.covar_samp(num, cov), "cov_den_cov": F.covar_samp(den, cov)}
    return pooled_and_by_arm(df, arm, aggs)


def cuped_adjust(df, arm, metric, cov):
    """CUPED means and variances per arm with the pooled theta = cov / var."""
    pooled = df.agg((F.covar_samp(metric, cov) / F.nullif(F.var_samp(cov), F.lit(0.0))).alias("theta"), F.avg(cov).alias("_mc"))
    base = df.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"), F.var_samp(metric).alias("var"), F.avg(cov).alias("_ac"),
                               F.var_samp(cov).alias("_vc"), F.covar_samp(metric, cov).alias("_xc"))
    out = with_totals(base, pooled)
    theta = F.coalesce(F.col("theta"), F.lit(0.0))
    return out.select(arm, "n", "mean", "var", theta.alias("theta"),
                      (F.col("mean") - theta * (F.col("_ac") - F.col("_mc"))).alias("adjusted_mean"),
                      (F.col("var") - 2 * theta * F.col("_xc") + theta * theta * F.col("_vc")).alias("adjusted_var"))


def dimension_moments(df, dim, arm, num, den, cap=30):
    """Ratio moments per arm and dimension value for the ``cap`` largest values."""
    return ratio_moments(limit_dimension(df, dim, cap), [dim, arm], num, den)


def global_totals(df, report, num, den):
    """Attach the global numerator and denominator to every report row."""
    return with_totals(report, df.agg(F.sum(num).alias("global_numerator"), F.sum(den).alias("global_denominator")))


def joint_exposure(a, b, unit, arm_a, arm_b):
    """Units in each cell of two experiments."""
    both = a.select(unit, arm_a).distinct().join(b.select(unit, arm_b).distinct(), unit)
    return both.groupBy(arm_a, arm_b).agg(F.count(F.lit(1)).alias("n_units"))


def cost_per_incremental(df, tag, bucket, control, unit, order_id, profit):
    """Per tag: profit and orders per unit by bucket against the named control, and the cost per extra order."""
    per_unit = df.groupBy(tag, bucket, unit).agg(F.count(order_id).alias("_o"), F.coalesce(F.sum(profit), F.lit(0.0)).alias("_p"))
    per = per_unit.groupBy(tag, bucket).agg(F.count(F.lit(1)).alias("n_units"), F.avg("_o").alias("orders_per_unit"), F.avg("_p").alias("profit_per_unit"))
    base = per.filter(F.col(bucket) == control).select(tag, F.col("orders_per_unit").alias("_co"), F.col("profit_per_unit").alias("_cp"))
    out = per.filter(F.col(bucket) != control).join(base, tag)
    cost = (F.col("profit_per_unit") - F.col("_cp")) / F.nullif(-(F.col("orders_per_unit") - F.col("_co")), F.lit(0.0))
    return out.withColumn("cost_per_incremental_order", cost).drop("_co", "_cp")


def interaction_2x2(df, a, b, metrics):
    """Cell means of two 0/1 factors, both main effects, the difference-in-differences and its t value."""
    aggs = []
    for m in metrics:
        for i in (0, 1):
            for j in (0, 1):
                hit = (F.col(a) == i) & (F.col(b) == j)
                v = F.when(hit, F.col(m).cast("double"))
                aggs += [F.avg(v).alias(f"_m{i}{j}_{m}"), F.var_samp(v).alias(f"_v{i}{j}_{m}"), F.count(v).alias(f"_n{i}{j}_{m}")]
    wide = df.agg(*aggs)
    rows = []
    for m in metrics:
        mean = {(i, j): F.col(f"_m{i}{j}_{m}") for i in (0, 1) for j in (0, 1)}
        se2 = reduce(lambda x, y: x + y, [F.col(f"_v{i}{j}_{m}") / F.col(f"_n{i}{j}_{m}") for i in (0, 1) for j in (0, 1)])
        did = mean[1, 1] - mean[1, 0] - mean[0, 1] + mean[0, 0]
        rows.append(F.struct(F.lit(m).alias("metric"), *[mean[i, j].alias(f"mean_{i}{j}") for i in (0, 1) for j in (0, 1)],
                             (mean[1, 0] - mean[0, 0]).alias("effect_a"), (mean[0, 1] - mean[0, 0]).alias("effect_b"),
                             did.alias("interaction"), F.sqrt(se2).alias("se"), (did / F.nullif(F.sqrt(se2), F.lit(0.0))).alias("t")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def to_report(df, section, units, ids=()):
    """Wide result row(s) to (section, metric, value, unit) lines; ``units`` = {column: unit}."""
    long = unpivot(df, list(ids), list(units))
    unit = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])[F.col("metric")]
    return long.select(*ids, F.lit(section).alias("section"), "metric", "value", unit.alias("unit"))


def compliance(df, arm, assigned, received):
    """Per arm: units, share that received the treatment, and its complement as contamination or non-compliance."""
    got = F.avg(F.col(received).cast("double"))
    out = df.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), got.alias("received_share"), F.max(assigned).alias("_as"))
    return out.select(arm, "n", "received_share", F.when(F.col("_as") == 1, F.col("received_share")).alias("compliance"),
                      F.when(F.col("_as") == 0, F.col("received_share")).alias("contamination"))
