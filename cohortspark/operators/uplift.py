"""Uplift curves and targeting tables from an ordered scan of the scores."""

from pyspark.sql import functions as F

from cohortspark.operators.ordered import OrderedScan, key_sum, row_number, running_sum
from cohortspark.operators.windows import ntile_bucket


def qini_curve(df, score, treated, outcome, key, hot_rows=None):
    """One row per unit in descending score order: position, cumulative counts, uplift curve and incremental outcomes.

    curve = treated outcomes - control outcomes * n_treated / n_control (the control term is 0 while n_control = 0).
    """
    t, y = F.col(treated).cast("int"), F.col(outcome).cast("double")
    scan = OrderedScan(df.select(key, score, t.alias("_t"), y.alias("_y")), [], [f"-{score}", key], hot_rows=hot_rows)
    scan.derive(_c=1 - F.col("_t"), _yt=F.col("_y") * F.col("_t"), _yc=F.col("_y") * (1 - F.col("_t")))
    scan.add(position=row_number(), n_treated=running_sum("_t"), n_control=running_sum("_c"), y_treated=running_sum("_yt"),
             y_control=running_sum("_yc"), n=key_sum(F.lit(1)), _all_t=key_sum("_t"), _all_c=key_sum("_c"))
    adj = F.coalesce(F.col("y_control") * F.col("n_treated") / F.nullif(F.col("n_control"), F.lit(0)), F.lit(0.0))
    rate = (F.col("y_treated") / F.greatest(F.col("_all_t"), F.lit(1)) - F.col("y_control") / F.greatest(F.col("_all_c"), F.lit(1)))
    scan.derive(curve=F.col("y_treated") - adj, rate_gap=rate, incremental=F.col("y_treated") - F.col("y_control"),
                share=F.col("position") / F.col("n"))
    return scan.result().drop("_t", "_y", "_c", "_yt", "_yc", "_all_t", "_all_c")


def _trapezoid(c):
    ends = F.max(F.when(F.col("position") == 1, F.col(c))) + F.max(F.when(F.col("position") == F.col("n"), F.col(c)))
    return F.sum(c) - ends / 2


def uplift_summary(curve):
    """Qini coefficient (area under the curve / n), Qini AUC (that area less the straight line's) and AUUC."""
    s = curve.agg(F.max("n").alias("n"), _trapezoid("curve").alias("_a"), _trapezoid("rate_gap").alias("_u"),
                  F.max(F.when(F.col("position") == F.col("n"), F.col("curve"))).alias("_end"))
    return s.select("n", (F.col("_a") / F.col("n")).alias("qini_coefficient"),
                    ((F.col("_a") - F.col("_end") * (F.col("n") - 1) * (F.col("n") + 1) / (2.0 * F.col("n"))) / F.col("n")).alias("qini_auc"),
                    (F.col("_u") / F.col("n")).alias("auuc"))


def uplift_at_k(df, score, treated, outcome, key, ks=(0.3, 0.5), hot_rows=None):
    """Outcome rate of treated minus control among the top k share by score."""
    t, y = F.col(treated).cast("int"), F.col(outcome).cast("double")
    scan = OrderedScan(df.select(key, score, t.alias("_t"), y.alias("_y")), [], [f"-{score}", key], hot_rows=hot_rows)
    ranked = scan.add(_p=row_number(), _n=key_sum(F.lit(1))).result()
    aggs = []
    for i, k in enumerate(ks):
        top = F.col("_p") <= F.floor(F.col("_n") * F.lit(float(k)))
        aggs += [F.avg(F.when(top & (F.col("_t") == 1), F.col("_y"))).alias(f"t{i}"), F.avg(F.when(top & (F.col("_t") == 0), F.col("_y"))).alias(f"c{i}")]
    rows = [F.struct(F.lit(float(k)).alias("k"), F.col(f"t{i}").alias("treated_rate"), F.col(f"c{i}").alias("control_rate"),
                     (F.col(f"t{i}") - F.col(f"c{i}")).alias("uplift")) for i, k in enumerate(ks)]
    return ranked.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def uplift_buckets(df, score, treated, outcome, key, n=10, hot_rows=None):
    """Observed against predicted uplift per score bucket (1 = highest)."""
    cut = ntile_bucket(df, [f"-{score}", key], n, name="bucket", hot_rows=hot_rows)
    t, y = F.col(treated).cast("int"), F.col(outcome).cast("double")
    out = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.count(F.when(t == 1, 1)).alias("n_treated"),
                                    F.avg(F.when(t == 1, y)).alias("treated_rate"), F.avg(F.when(t == 0, y)).alias("control_rate"))
    return out.withColumn("observed", F.col("treated_rate") - F.col("control_rate"))


def threshold_policy(df, unit, channel, score, cutoffs):
    """Best channel per unit among those whose score reaches the channel's cutoff; ``target`` = 0 and no channel otherwise."""
    limit = F.create_map(*[F.lit(x) for kv in cutoffs.items() for x in kv])[F.col(channel)]
    ok = F.col(score) >= limit
    best = F.max(F.when(ok, F.struct(F.col(score).alias("s"), F.col(channel).alias("c"))))
    out = df.groupBy(unit).agg(best.alias("_b"), F.max(score).alias("max_score"))
    return out.select(unit, F.when(F.col("_b").isNotNull(), 1).otherwise(0).alias("target"), F.col("_b.c").alias("channel"), "max_score")


