"""Queries for experiments, statistics, models, causal inference and sequences."""

from pyspark.sql import functions as F

from cohortspark.functions import exprs as X
from cohortspark.functions.tails import norm_sf2_oracle
from cohortspark.operators import causal as CI, experiments as E, models as M, prep as PR, sequences as SQ, stats as ST, uplift as U
from cohortspark.plans.common import EXPOSURE_SQL, SKEY, UNITS_SQL, arm_of, first_events, sess, sess_sql, unit_orders
from cohortspark.plans.registry import q

is_type = lambda k: F.col("event_type") == k


def _exposures(t):
    return t("events").select("user_id", "ts", F.when(F.col("event_id") % 11 == 0, "overridden").otherwise(arm_of("user_id")).alias("arm"))


q("x01_first_exposure", lambda t: E.first_exposure(_exposures(t), "user_id", "arm", "ts"),
  "SELECT user_id, CASE WHEN user_id % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm, min(ts) AS exposure_ts FROM events WHERE event_id % 11 <> 0 GROUP BY 1, 2")



def _metrics():
    return {"buys": F.count(F.when(is_type("purchase"), 1)), "spent": F.sum("value")}


def _arm_sql(window, extra=""):
    hi = f" AND e.ts <= t0 + INTERVAL {window} HOUR" if window else ""
    return f"""
SELECT arm{extra}, count(*) AS n_units, CAST(sum(buys) AS BIGINT) AS buys_total, avg(buys) AS buys_per_unit, avg(CASE WHEN buys > 0 THEN 1.0 ELSE 0 END) AS buys_unit_share,
  sum(spent) AS spent_total, avg(spent) AS spent_per_unit, avg(CASE WHEN spent > 0 THEN 1.0 ELSE 0 END) AS spent_unit_share
FROM (SELECT x.user_id, arm, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS buys, coalesce(sum(value), 0) AS spent FROM x LEFT JOIN events e ON e.user_id = x.user_id AND e.ts > t0{hi} GROUP BY 1, 2) GROUP BY arm"""


_ARM_FLOATS = "buys_per_unit buys_unit_share spent_total spent_per_unit spent_unit_share"
q("x02_arm_metrics", lambda t: E.arm_metrics(first_events(t), t("events"), "user_id", "arm", "t0", "ts", _metrics()), f"WITH {EXPOSURE_SQL} {_arm_sql(None)}", _ARM_FLOATS, 4)
q("x03_arm_metrics_windows", lambda t: E.arm_metrics_windows(first_events(t), t("events"), "user_id", "arm", "t0", "ts", _metrics(), [24, 48, 168]),
  f"WITH {EXPOSURE_SQL} " + " UNION ALL ".join(_arm_sql(h, f", {h} AS window_hours") for h in (24, 48, 168)), _ARM_FLOATS, 4)

_LIFT = """count(CASE WHEN arm = 'control' THEN 1 END) AS n_control, count(CASE WHEN arm = 'treatment' THEN 1 END) AS n_treatment, '{m}' AS metric, avg(CASE WHEN arm = 'control' THEN {m} END) AS control, avg(CASE WHEN arm = 'treatment' THEN {m} END) AS treatment"""
_LIFTED = "SELECT *, treatment - control AS abs_lift, (treatment - control) / nullif(control, 0) AS rel_lift FROM l"
q("x04_lift", lambda t: E.lift(unit_orders(t), "arm", "control", "treatment", ["n_orders", "spend"]),
  f"WITH {UNITS_SQL}, l AS (" + " UNION ALL ".join(f"SELECT {_LIFT.format(m=m)} FROM units" for m in ("n_orders", "spend")) + f") {_LIFTED}", "control treatment abs_lift rel_lift", 4)
q("x05_lift_by_segment", lambda t: E.lift(unit_orders(t), "arm", "control", "treatment", ["n_orders", "spend"], ["c_mktsegment"]),
  f"WITH {UNITS_SQL}, l AS (" + " UNION ALL ".join(f"SELECT c_mktsegment, {_LIFT.format(m=m)} FROM units GROUP BY c_mktsegment" for m in ("n_orders", "spend")) + f") {_LIFTED}", "control treatment abs_lift rel_lift", 4)

q("x06_ratio_moments", lambda t: E.pooled_and_by_arm(unit_orders(t), "arm", {
    "data_count": F.count(F.lit(1)), "mean_num": F.avg("spend"), "mean_den": F.avg("n_orders"), "var_num": F.var_samp("spend"), "var_den": F.var_samp("n_orders"), "cov_num_den": F.covar_samp("spend", "n_orders")}),
  f"WITH {UNITS_SQL} " + " UNION ALL ".join(f"SELECT {a} AS arm, count(*) AS data_count, avg(spend) AS mean_num, avg(n_orders) AS mean_den, var_samp(spend) AS var_num, var_samp(n_orders) AS var_den, covar_samp(spend, n_orders) AS cov_num_den FROM units{g}"
                                             for a, g in (("arm", " GROUP BY arm"), ("'all_data'", ""))), "mean_num mean_den var_num var_den cov_num_den", 1)


def _cuped_units(t):
    before, after = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    post = t("orders").filter(after).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n"))
    units = t("customer").select("c_custkey", arm_of("c_custkey").alias("arm")).join(post, "c_custkey", "left").fillna(0, subset=["spend", "n"])
    pre = t("orders").filter(before & (F.col("o_orderpriority") != "5-LOW")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("pre_spend"))
    return units, pre


_CUPED = """
  po AS (SELECT o_custkey, sum(o_totalprice) AS spend, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1),
  pr AS (SELECT o_custkey, sum(o_totalprice) AS pre FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' AND o_orderpriority <> '5-LOW' GROUP BY 1),
  cu AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm, coalesce(spend, 0) AS spend, coalesce(n, 0) AS n, {fill} AS pre_spend
         FROM customer LEFT JOIN po ON po.o_custkey = c_custkey LEFT JOIN pr ON pr.o_custkey = c_custkey)"""


def _cuped(t, fill):
    units, pre = _cuped_units(t)
    return E.cuped_covariate(units, pre, "c_custkey", "pre_spend", fill)


_CM = "count(*) AS data_count, avg(spend) AS mean_num, avg(n) AS mean_den, avg(pre_spend) AS mean_cov, var_samp(spend) AS var_num, var_samp(n) AS var_den, var_samp(pre_spend) AS var_cov, covar_samp(spend, n) AS cov_num_den, covar_samp(spend, pre_spend) AS cov_num_cov, covar_samp(n, pre_spend) AS cov_den_cov"
q("x07_cuped_moments", lambda t: E.cuped_moments(_cuped(t, -1), "arm", "spend", "n", "pre_spend"),
  f"WITH {_CUPED.format(fill='coalesce(pre, -1)')} SELECT arm, {_CM} FROM cu GROUP BY arm UNION ALL SELECT 'all_data', {_CM} FROM cu", "mean_num mean_den mean_cov var_num var_den var_cov cov_num_den cov_num_cov cov_den_cov", 0)
q("x07_cuped_adjust", lambda t: E.cuped_adjust(_cuped(t, "mean"), "arm", "spend", "pre_spend"), f"""
WITH {_CUPED.format(fill='coalesce(pre, (SELECT avg(pre) FROM pr))')}, p AS (SELECT covar_samp(spend, pre_spend) / var_samp(pre_spend) AS theta, avg(pre_spend) AS mc FROM cu)
SELECT arm, count(*) AS n, avg(spend) AS mean, var_samp(spend) AS var, any_value(theta) AS theta, avg(spend) - any_value(theta) * (avg(pre_spend) - any_value(mc)) AS adjusted_mean,
  var_samp(spend) - 2 * any_value(theta) * covar_samp(spend, pre_spend) + any_value(theta) * any_value(theta) * var_samp(pre_spend) AS adjusted_var FROM cu, p GROUP BY arm""", "mean var theta adjusted_mean adjusted_var", 1)



def _cuped_all(t):
    """Spend after 1999 against all earlier orders."""
    old = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    pre = t("orders").filter(old).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("pre_spend"))
    return E.cuped_covariate(_cuped_units(t)[0], pre, "c_custkey", "pre_spend", -1)


q("x07_cuped_all_orders", lambda t: E.cuped_moments(_cuped_all(t), "arm", "spend", "n", "pre_spend"),
  f"WITH {_CUPED.format(fill='coalesce(pre, -1)').replace(chr(32) + 'AND o_orderpriority <> ' + repr('5-LOW'), '')} SELECT arm, {_CM} FROM cu GROUP BY arm UNION ALL SELECT 'all_data', {_CM} FROM cu", "mean_num mean_den mean_cov var_num var_den var_cov cov_num_den cov_num_cov cov_den_cov", 0)

q("x08_dimension_moments", lambda t: E.dimension_moments(unit_orders(t), "c_nationkey", "arm", "spend", "n_orders", 10), f"""
WITH {UNITS_SQL}, k AS (SELECT c_nationkey FROM units GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 10)
SELECT c_nationkey, arm, count(*) AS data_count, avg(spend) AS mean_num, avg(n_orders) AS mean_den, var_samp(spend) AS var_num, var_samp(n_orders) AS var_den, covar_samp(spend, n_orders) AS cov_num_den
FROM units WHERE c_nationkey IN (SELECT c_nationkey FROM k) GROUP BY 1, 2""", "mean_num mean_den var_num var_den cov_num_den", 1)

q("x09_global_totals", lambda t: E.global_totals(unit_orders(t), unit_orders(t).groupBy("arm").agg(F.count(F.lit(1)).alias("n")), "spend", "n_orders"),
  f"WITH {UNITS_SQL} SELECT arm, count(*) AS n, (SELECT sum(spend) FROM units) AS global_numerator, (SELECT CAST(sum(n_orders) AS BIGINT) FROM units) AS global_denominator FROM units GROUP BY 1", "global_numerator", 1)


def _outcomes(t):
    u = unit_orders(t)
    return u.withColumns({"many": (F.col("n_orders") >= 12).cast("int"), "rich": (F.col("c_acctbal") > 8000).cast("int"), "odd_nation": (F.col("c_nationkey") % 2).cast("int")})


_COUNTS = f"""{UNITS_SQL}, o AS (SELECT *, CASE WHEN n_orders >= 12 THEN 1 ELSE 0 END AS many, CASE WHEN c_acctbal > 8000 THEN 1 ELSE 0 END AS rich, c_nationkey % 2 AS odd_nation FROM units),
  c AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, count(CASE WHEN arm = 'treatment' THEN 1 END) AS n_t, count(CASE WHEN arm = 'control' THEN 1 END) AS n_c, CAST(sum(CASE WHEN arm = 'treatment' THEN {m} END) AS BIGINT) AS x_t, CAST(sum(CASE WHEN arm = 'control' THEN {m} END) AS BIGINT) AS x_c FROM o" for m in ("many", "rich", "odd_nation"))})"""
_P = norm_sf2_oracle("z")
q("x10_ztest_prop", lambda t: ST.ztest_prop(ST.two_arm_counts(_outcomes(t), "arm", "treatment", "control", ["many", "rich", "odd_nation"]), "x_t", "n_t", "x_c", "n_c"), f"""
WITH {_COUNTS}, r AS (SELECT *, x_t / n_t AS rate_1, x_c / n_c AS rate_2, (x_t + x_c) / (n_t + n_c) AS pool FROM c),
z AS (SELECT *, rate_1 - rate_2 AS rate_diff, sqrt(pool * (1 - pool) * (1 / n_t + 1 / n_c)) AS se, (rate_1 - rate_2) / sqrt(pool * (1 - pool) * (1 / n_t + 1 / n_c)) AS z, sqrt(rate_1 * (1 - rate_1) / n_t + rate_2 * (1 - rate_2) / n_c) AS w FROM r)
SELECT metric, n_t, n_c, x_t, x_c, rate_1, rate_2, rate_diff, se, z, {_P} AS p_value, rate_diff - 1.959963984540054 * w AS ci_low, rate_diff + 1.959963984540054 * w AS ci_high FROM z""", "rate_1 rate_2 rate_diff se z p_value ci_low ci_high")

_TWO = "count(CASE WHEN arm = 'treatment' THEN 1 END) AS n_t, avg(CASE WHEN arm = 'treatment' THEN {m} END) AS mean_t, var_samp(CASE WHEN arm = 'treatment' THEN {m} END) AS var_t, count(CASE WHEN arm = 'control' THEN 1 END) AS n_c, avg(CASE WHEN arm = 'control' THEN {m} END) AS mean_c, var_samp(CASE WHEN arm = 'control' THEN {m} END) AS var_c"
q("x11_ztest_mean", lambda t: ST.ztest_mean(unit_orders(t), "arm", "treatment", "control", "n_orders", ["c_mktsegment"]), f"""
WITH {UNITS_SQL}, m AS (SELECT c_mktsegment, {_TWO.format(m='n_orders')} FROM units GROUP BY 1), z AS (SELECT *, mean_t - mean_c AS diff, sqrt(var_t / n_t + var_c / n_c) AS se, (mean_t - mean_c) / sqrt(var_t / n_t + var_c / n_c) AS z FROM m)
SELECT *, {_P} AS p_value, CASE WHEN abs(z) > 1.96 THEN 1 ELSE 0 END AS significant FROM z""", "mean_t var_t mean_c var_c diff se z p_value")

_POOLSD = "sqrt(((n_t - 1) * var_t + (n_c - 1) * var_c) / (n_t + n_c - 2))"
q("x12_welch", lambda t: ST.welch(unit_orders(t), "arm", "treatment", "control", "spend").drop("p_value"), f"""
WITH {UNITS_SQL}, m AS (SELECT {_TWO.format(m='spend')} FROM units), a AS (SELECT *, var_t / n_t AS a, var_c / n_c AS b FROM m)
SELECT n_t, mean_t, var_t, n_c, mean_c, var_c, mean_t - mean_c AS diff, sqrt(a + b) AS se, (a + b) * (a + b) / (a * a / (n_t - 1) + b * b / (n_c - 1)) AS dof, (mean_t - mean_c) / {_POOLSD} AS cohens_d, (mean_t - mean_c) / sqrt(a + b) AS t,
  mean_t - mean_c - 1.959963984540054 * sqrt(a + b) AS ci_low, mean_t - mean_c + 1.959963984540054 * sqrt(a + b) AS ci_high FROM a""", "mean_t var_t mean_c var_c diff se dof cohens_d t ci_low ci_high", 3)
q("x12_welch_p_value", lambda t: ST.welch(unit_orders(t), "arm", "treatment", "control", "spend").select("t", "dof", "p_value"), f"""
WITH {UNITS_SQL}, m AS (SELECT {_TWO.format(m='spend')} FROM units), a AS (SELECT *, var_t / n_t AS a, var_c / n_c AS b FROM m),
w AS (SELECT (mean_t - mean_c) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n_t - 1) + b * b / (n_c - 1)) AS dof FROM a),
s AS (SELECT t, dof, abs(t) / 4000 AS h, unnest(range(0, 4001)) AS i FROM w),
d AS (SELECT t, dof, h, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi() * dof) * pow(1 + h * i * h * i / dof, -(dof + 1) / 2) AS f FROM s)
SELECT t, dof, 1 - 2 * sum(f) * any_value(h) / 3 AS p_value FROM d GROUP BY t, dof""", "t dof p_value")
q("x13_ttest_pooled", lambda t: ST.ttest_pooled(unit_orders(t), "arm", "treatment", "control", "spend", p_values=False), f"""
WITH {UNITS_SQL}, m AS (SELECT {_TWO.format(m='spend')} FROM units)
SELECT *, mean_t - mean_c AS diff, {_POOLSD} * sqrt(1 / n_t + 1 / n_c) AS se, n_t + n_c - 2 AS dof, (mean_t - mean_c) / ({_POOLSD} * sqrt(1 / n_t + 1 / n_c)) AS t FROM m""", "mean_t var_t mean_c var_c diff se dof t", 3)

q("x14_count_test", lambda t: ST.count_test(ST.two_arm_counts(_outcomes(t), "arm", "treatment", "control", ["n_orders", "many"]), "x_t", "n_t", "x_c", "n_c"), f"""
WITH {UNITS_SQL}, o AS (SELECT *, CASE WHEN n_orders >= 12 THEN 1 ELSE 0 END AS many FROM units),
c AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, count(CASE WHEN arm = 'treatment' THEN 1 END) AS n_t, count(CASE WHEN arm = 'control' THEN 1 END) AS n_c, CAST(sum(CASE WHEN arm = 'treatment' THEN {m} END) AS BIGINT) AS x_t, CAST(sum(CASE WHEN arm = 'control' THEN {m} END) AS BIGINT) AS x_c FROM o" for m in ("n_orders", "many"))}),
z AS (SELECT *, x_t / n_t AS rate_1, x_c / n_c AS rate_2, (x_t / n_t - x_c / n_c) / sqrt(x_t / n_t / n_t + x_c / n_c / n_c) AS z, (x_t - x_c) / sqrt(x_t + x_c) AS z_count FROM c)
SELECT *, {_P} AS p_value, {norm_sf2_oracle("z_count")} AS p_count FROM z""", "rate_1 rate_2 z z_count p_value p_count")

_CHI = """
  k AS (SELECT event_type AS a, user_id % 2 AS b, count(*) AS o FROM events GROUP BY 1, 2), e AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM k),
  s AS (SELECT CAST(sum(o) AS BIGINT) AS n, sum((o - e) * (o - e) / e) AS chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS DOUBLE) AS dof FROM e)"""
q("x15_chi2", lambda t: ST.chi2(t("events").withColumn("arm", F.col("user_id") % 2), "event_type", "arm"), f"WITH {_CHI} SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2) AS p_value FROM s", "chi2 p_value")

q("x16_mann_whitney", lambda t: ST.mann_whitney(unit_orders(t), "arm", "treatment", "control", "n_orders"), f"""
WITH {UNITS_SQL}, r AS (SELECT arm, n_orders, rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY n_orders) AS ties FROM units),
s AS (SELECT count(CASE WHEN arm = 'treatment' THEN 1 END) AS n_t, count(CASE WHEN arm = 'control' THEN 1 END) AS n_c, sum(CASE WHEN arm = 'treatment' THEN rk END) AS rs, sum(CAST(ties AS DOUBLE) * ties - 1) AS tc, CAST(count(*) AS DOUBLE) AS n FROM r),
z AS (SELECT n_t, n_c, rs - n_t * (n_t + 1) / 2.0 AS u, (rs - n_t * (n_t + 1) / 2.0 - n_t * n_c / 2.0 - sign(rs - n_t * (n_t + 1) / 2.0 - n_t * n_c / 2.0) * 0.5) / sqrt(n_t * n_c / 12.0 * (n + 1 - tc / (n * (n - 1)))) AS z FROM s)
SELECT *, {_P} AS p_value FROM z""", "u z p_value")

_CELLS = ", ".join(f"{f}(CASE WHEN a = {i} AND b = {j} THEN {{m}} END) AS {k}{i}{j}" for f, k in (("avg", "m"), ("var_samp", "v"), ("count", "n")) for i in (0, 1) for j in (0, 1))
_FACT = f"{UNITS_SQL}, f AS (SELECT *, c_custkey % 2 AS a, CAST(floor(c_custkey / 2) AS BIGINT) % 2 AS b FROM units)"


def _factors(t):
    return unit_orders(t).withColumns({"a": F.col("c_custkey") % 2, "b": F.floor(F.col("c_custkey") / 2) % 2})


q("x17_interaction_2x2", lambda t: E.interaction_2x2(_factors(t), "a", "b", ["n_orders", "spend"]), f"""
WITH {_FACT}, c AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {_CELLS.format(m=m)} FROM f" for m in ("n_orders", "spend"))})
SELECT metric, m00 AS mean_00, m01 AS mean_01, m10 AS mean_10, m11 AS mean_11, m10 - m00 AS effect_a, m01 - m00 AS effect_b, m11 - m10 - m01 + m00 AS interaction, sqrt(v00 / n00 + v01 / n01 + v10 / n10 + v11 / n11) AS se,
  (m11 - m10 - m01 + m00) / sqrt(v00 / n00 + v01 / n01 + v10 / n10 + v11 / n11) AS t FROM c""", "mean_00 mean_01 mean_10 mean_11 effect_a effect_b interaction se t", 4)

q("x18_interaction_ols", lambda t: ST.interaction_ols(_factors(t), "n_orders", "a", "b")[0].select("term", "coef", "se"), f"""
WITH {_FACT}, c AS (SELECT {_CELLS.format(m='n_orders')}, count(*) AS n FROM f), s AS (SELECT *, ((n00 - 1) * v00 + (n01 - 1) * v01 + (n10 - 1) * v10 + (n11 - 1) * v11) / (n - 4) AS s2 FROM c)
SELECT 'intercept' AS term, m00 AS coef, sqrt(s2 / n00) AS se FROM s UNION ALL SELECT 'a', m10 - m00, sqrt(s2 * (1 / n00 + 1 / n10)) FROM s UNION ALL SELECT 'b', m01 - m00, sqrt(s2 * (1 / n00 + 1 / n01)) FROM s
UNION ALL SELECT 'a_x_b', m11 - m10 - m01 + m00, sqrt(s2 * (1 / n00 + 1 / n01 + 1 / n10 + 1 / n11)) FROM s""", "coef se")

q("x19_effect_size_interaction", lambda t: ST.effect_size_interaction(_factors(t), "a", "b", "spend"), f"""
WITH {_FACT}, c AS (SELECT {_CELLS.format(m='spend')} FROM f),
d AS (SELECT (m10 - m00) / sqrt(((n10 - 1) * v10 + (n00 - 1) * v00) / (n10 + n00 - 2)) AS d_at_0, (m11 - m01) / sqrt(((n11 - 1) * v11 + (n01 - 1) * v01) / (n11 + n01 - 2)) AS d_at_1 FROM c) SELECT *, d_at_1 - d_at_0 AS d_difference FROM d""", "d_at_0 d_at_1 d_difference")

q("x20_balance", lambda t: ST.balance(unit_orders(t), "arm", "treatment", "control", ["c_acctbal", "n_orders", "spend"]),
  f"WITH {UNITS_SQL}, b AS (" + " UNION ALL ".join(f"SELECT '{m}' AS covariate, {_TWO.format(m=m)} FROM units" for m in ("c_acctbal", "n_orders", "spend"))
  + ") SELECT covariate, mean_t, mean_c, (mean_t - mean_c) / sqrt((var_t + var_c) / 2) AS smd, CASE WHEN abs((mean_t - mean_c) / sqrt((var_t + var_c) / 2)) < 0.1 THEN 1 ELSE 0 END AS balanced FROM b", "mean_t mean_c smd")


def _power(t):
    daily = t("events").groupBy(F.to_date("ts").alias("d")).agg(F.count_distinct("user_id").alias("n")).agg(F.avg("n").alias("daily"))
    base = _outcomes(t).agg(F.avg(F.col("many").cast("double")).alias("p"))
    from cohortspark.operators.joins import with_totals

    both = with_totals(base, daily)
    n = ST.sample_size(F.col("p"), F.lit(0.03), z_alpha=1.96, z_beta=0.84)
    rel = ST.sample_size(F.col("p"), F.lit(0.03), mode="as_written", z_alpha=1.96, z_beta=0.84)
    out = both.withColumns({"n_per_arm": n, "n_as_written": rel}).withColumn("n_total", 2 * F.col("n_per_arm"))
    return out.withColumns(ST.duration(F.col("n_per_arm"), F.col("daily")))


_POWER = f"""{UNITS_SQL}, p AS (SELECT (SELECT avg(CASE WHEN n_orders >= 12 THEN 1.0 ELSE 0 END) FROM units) AS p, (SELECT avg(n) FROM (SELECT count(DISTINCT user_id) AS n FROM events GROUP BY CAST(ts AS DATE))) AS daily),
  n AS (SELECT *, CAST(ceil(2 * 2.8 * 2.8 * p * (1 - p) / (0.03 * 0.03)) AS BIGINT) AS n_per_arm, CAST(ceil(2 * 2.8 * 2.8 * p * (1 - p) / ((0.03 / p) * (0.03 / p))) AS BIGINT) AS n_as_written FROM p),
  o AS (SELECT *, 2 * n_per_arm AS n_total, CAST(ceil(2 * n_per_arm / daily) AS BIGINT) AS days_base, CAST(ceil(2 * n_per_arm / (daily * 1.5)) AS BIGINT) AS days_high, CAST(ceil(2 * n_per_arm / (daily * 0.8)) AS BIGINT) AS days_low FROM n)"""
q("x21_power", _power, f"WITH {_POWER} SELECT * FROM o", "p daily")
q("x22_report", lambda t: E.to_report(_power(t), "power", {"p": "rate", "n_per_arm": "units", "n_total": "units", "days_base": "days"}), f"""
WITH {_POWER} SELECT 'power' AS section, 'p' AS metric, p AS value, 'rate' AS unit FROM o UNION ALL SELECT 'power', 'n_per_arm', n_per_arm, 'units' FROM o UNION ALL SELECT 'power', 'n_total', n_total, 'units' FROM o UNION ALL SELECT 'power', 'days_base', days_base, 'days' FROM o""", "value")

q("x23_sig_label", lambda t: ST.ztest_mean(unit_orders(t), "arm", "treatment", "control", "n_orders", ["c_nationkey"]).select("c_nationkey", ST.sig_label("p_value").alias("label")), f"""
WITH {UNITS_SQL}, m AS (SELECT c_nationkey, {_TWO.format(m='n_orders')} FROM units GROUP BY 1), z AS (SELECT *, (mean_t - mean_c) / sqrt(var_t / n_t + var_c / n_c) AS z FROM m), p AS (SELECT c_nationkey, {_P} AS p FROM z)
SELECT c_nationkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS label FROM p""")

q("x24_compliance", lambda t: E.compliance(unit_orders(t).withColumns({"assigned": (F.col("arm") == "treatment").cast("int"), "received": (F.col("c_custkey") % 10 < 7).cast("int")}), "arm", "assigned", "received"), f"""
WITH {UNITS_SQL}, r AS (SELECT arm, count(*) AS n, avg(CASE WHEN c_custkey % 10 < 7 THEN 1.0 ELSE 0 END) AS received_share FROM units GROUP BY 1)
SELECT *, CASE WHEN arm = 'treatment' THEN received_share END AS compliance, CASE WHEN arm = 'control' THEN received_share END AS contamination FROM r""", "received_share compliance contamination")

q("x25_cost_per_incremental", lambda t: E.cost_per_incremental(
    t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_mktsegment", F.concat(F.lit("b"), (F.col("c_custkey") % 3).cast("string")).alias("bucket"), "c_custkey", "o_orderkey", (F.col("o_totalprice") * 0.01).alias("profit")),
    "c_mktsegment", "bucket", "b0", "c_custkey", "o_orderkey", "profit"), """
WITH u AS (SELECT c_mktsegment, 'b' || (c_custkey % 3) AS bucket, c_custkey, count(o_orderkey) AS o, coalesce(sum(o_totalprice * 0.01), 0) AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3),
b AS (SELECT c_mktsegment, bucket, count(*) AS n_units, avg(o) AS orders_per_unit, avg(p) AS profit_per_unit FROM u GROUP BY 1, 2)
SELECT b.*, (b.profit_per_unit - c.profit_per_unit) / nullif(-(b.orders_per_unit - c.orders_per_unit), 0) AS cost_per_incremental_order FROM b JOIN b c ON c.c_mktsegment = b.c_mktsegment AND c.bucket = 'b0' WHERE b.bucket <> 'b0'""",
  "orders_per_unit profit_per_unit cost_per_incremental_order", 3)

q("x26_joint_exposure", lambda t: E.joint_exposure(first_events(t).select("user_id", F.col("arm").alias("arm_a")), t("events").filter(is_type("click")).select("user_id", (F.floor(F.col("user_id") / 2) % 2).alias("arm_b")), "user_id", "arm_a", "arm_b"), """
SELECT CASE WHEN user_id % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm_a, CAST(floor(user_id / 2) AS BIGINT) % 2 AS arm_b, count(DISTINCT user_id) AS n_units FROM events WHERE event_type = 'click' GROUP BY 1, 2""")

# ---------------------------------------------------------------- preparation and models

XS = ["c_acctbal", "c_nationkey", "n_orders"]


def _modelled(t):
    """Customers with a binary target that depends on the features, and a treatment arm."""
    u = unit_orders(t).withColumn("a", (F.col("c_custkey") % 2).cast("int"))
    noise = X.md5_bucket("c_custkey", 1000) / 1000.0
    signal = 0.15 + 0.3 * (F.col("c_acctbal") > 4000).cast("double") + 0.02 * F.col("n_orders") + 0.15 * F.col("a") * (F.col("c_nationkey") < 12).cast("double")
    return u.withColumn("y", (noise < signal).cast("int"))


_MODELLED = f"""{UNITS_SQL}, md AS (SELECT *, CAST(c_custkey % 2 AS INTEGER) AS a, CASE WHEN (CAST('0x' || substring(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 1000) / 1000.0
  < 0.15 + 0.3 * (CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END) + 0.02 * n_orders + 0.15 * (c_custkey % 2) * (CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS y FROM units)"""

q("m01_prepare_features", lambda t: PR.prepare_features(_modelled(t).withColumn("flat", F.lit(3)), XS + ["flat"], "y", ["c_custkey"])[0],
  f"WITH {_MODELLED} SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(n_orders AS DOUBLE) AS n_orders, CAST(y AS DOUBLE) AS y FROM md")


def _gaps(t):
    return t("documents").select("doc_id", "n_chars", "lang").join(t("labels"), "doc_id", "left").select(
        "doc_id", "quality", "toxic", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars").cast("double")).alias("size"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("tag"), F.col("quality").alias("q2"))


q("m02_impute", lambda t: PR.impute(_gaps(t), {"quality": "zero", "toxic": "max+1", "size": "median", "lang": "mode", "tag": "Unknown", "q2": "=9"}), """
WITH g AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars AS DOUBLE) END AS size, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 3 <> 0 THEN lang END AS tag FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, (SELECT max(toxic) + 1 FROM g)) AS toxic, coalesce(size, (SELECT quantile_cont(size, 0.5) FROM g)) AS size,
  coalesce(lang, (SELECT lang FROM g WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)) AS lang, coalesce(tag, 'Unknown') AS tag, coalesce(quality, 9) AS q2 FROM g""")

q("m03_winsorize", lambda t: PR.winsorize(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])[0],
  "SELECT o_orderkey, least(greatest(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.01) FROM orders)), (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)) AS o_totalprice FROM orders", "o_totalprice", 4)
q("m03_winsorize_report", lambda t: PR.winsorize(t("orders"), ["o_totalprice"])[1].withColumnRenamed("column", "name"), """
WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
SELECT 'o_totalprice' AS name, lo AS low, hi AS high, (SELECT count(*) FROM orders WHERE o_totalprice < lo) AS n_low, (SELECT count(*) FROM orders WHERE o_totalprice > hi) AS n_high FROM b""", "low high", 4)

q("m04_one_hot", lambda t: PR.one_hot(t("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"]), """
SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_mktsegment_building, CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS c_mktsegment_furniture, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS c_mktsegment_household,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS c_mktsegment_machinery FROM customer""")

q("m05_filter_covariates", lambda t: t("lineitem").groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in PR.filter_covariates(
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"], "l_returnflag", {"return": ["price", "flag"]})]),
  "SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY 1", "l_quantity l_discount l_tax")

q("m06_logit", lambda t: M.fit_logit(_modelled(t), XS, "y")[0])
q("m06_logit_by_cohort", lambda t: M.fit_logit(_modelled(t), XS, "y", by="c_mktsegment")[0])
q("m06_logit_closed_form", lambda t: M.fit_logit(_modelled(t), ["a"], "y")[0].select("term", "coef", "auc"), f"""
WITH {_MODELLED}, c AS (SELECT sum(CASE WHEN a = 1 THEN y END) AS p1, sum(CASE WHEN a = 1 THEN 1 - y END) AS q1, sum(CASE WHEN a = 0 THEN y END) AS p0, sum(CASE WHEN a = 0 THEN 1 - y END) AS q0 FROM md)
SELECT 'a' AS term, ln(p1 / q1) - ln(p0 / q0) AS coef, (p1 * q0 + 0.5 * (p1 * q1 + p0 * q0)) / ((p1 + p0) * (q1 + q0)) AS auc FROM c""", "coef auc", 3)


def _binary(t):
    """Line items with a 0/1 feature and target and 200 cohorts."""
    return t("lineitem").select((F.col("l_partkey") % 200).alias("cohort"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"),
                                (F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_tax") > 0.04).cast("int").alias("x"), (F.col("l_discount") > 0.05).cast("int").alias("y"))


# cells of a saturated model, per cohort, train and test by the first 32 bits of md5; cohorts with an empty cell have no finite fit
_BINARY = """b AS (SELECT l_partkey % 200 AS cohort, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS a, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y,
  CAST('0x' || substring(md5(l_orderkey || '-' || l_linenumber || '|0'), 1, 8) AS BIGINT) >= 3435973837 AS test FROM lineitem),
c AS (SELECT cohort, sum(CASE WHEN a = 1 AND NOT test THEN y END) AS p1, sum(CASE WHEN a = 1 AND NOT test THEN 1 - y END) AS q1, sum(CASE WHEN a = 0 AND NOT test THEN y END) AS p0, sum(CASE WHEN a = 0 AND NOT test THEN 1 - y END) AS q0,
  sum(CASE WHEN a = 1 AND test THEN y ELSE 0 END) AS tp1, sum(CASE WHEN a = 1 AND test THEN 1 - y ELSE 0 END) AS tq1, sum(CASE WHEN a = 0 AND test THEN y ELSE 0 END) AS tp0, sum(CASE WHEN a = 0 AND test THEN 1 - y ELSE 0 END) AS tq0 FROM b GROUP BY 1)"""
q("m06_logit_cohorts_held_out", lambda t: M.fit_logit(_binary(t), ["a"], "y", by="cohort", key="k", test=0.2)[0].filter("abs(coef) > 1e-9").select("cohort", "coef", "odds_ratio", "auc", "auc_test"), f"""
WITH {_BINARY}, s AS (SELECT *, p1 * q0 > p0 * q1 AS up FROM c WHERE p1 * q0 <> p0 * q1 AND least(p1, q1, p0, q0) > 0)
SELECT CAST(cohort AS VARCHAR) AS cohort, ln(p1 * q0 / (p0 * q1)) AS coef, p1 * q0 / (p0 * q1) AS odds_ratio,
  (CASE WHEN up THEN p1 * q0 ELSE p0 * q1 END + 0.5 * (p1 * q1 + p0 * q0)) / ((p1 + p0) * (q1 + q0)) AS auc,
  (CASE WHEN up THEN tp1 * tq0 ELSE tp0 * tq1 END + 0.5 * (tp1 * tq1 + tp0 * tq0)) / nullif((tp1 + tp0) * (tq1 + tq0), 0) AS auc_test FROM s""", "coef odds_ratio auc auc_test")
q("m07_logit_inference", lambda t: M.logit_inference(_modelled(t).withColumn("bal", F.col("c_acctbal") / 1000), ["bal", "n_orders", "a"], "y"))
# a logit on one 0/1 feature has a closed form: group log-odds, so the fit can be checked by counting
q("m07_logit_closed_form", lambda t: M.logit_inference(_modelled(t), ["a"], "y", robust=False).select("term", "coef", "se"), f"""
WITH {_MODELLED}, c AS (SELECT sum(CASE WHEN a = 1 THEN y END) AS p1, sum(CASE WHEN a = 1 THEN 1 - y END) AS q1, sum(CASE WHEN a = 0 THEN y END) AS p0, sum(CASE WHEN a = 0 THEN 1 - y END) AS q0 FROM md)
SELECT 'intercept' AS term, ln(p0 / q0) AS coef, sqrt(1 / p0 + 1 / q0) AS se FROM c UNION ALL SELECT 'a', ln(p1 / q1) - ln(p0 / q0), sqrt(1 / p0 + 1 / q0 + 1 / p1 + 1 / q1) FROM c""", "coef se", 5)
# on one 0/1 feature every row of a group has the leverage 1 / rows of the group
q("m07_logit_robust", lambda t: M.logit_inference(_modelled(t), ["a"], "y").select("term", "coef", "se"), f"""
WITH {_MODELLED}, c AS (SELECT sum(CASE WHEN a = 1 THEN y END) AS p1, sum(CASE WHEN a = 1 THEN 1 - y END) AS q1, sum(CASE WHEN a = 0 THEN y END) AS p0, sum(CASE WHEN a = 0 THEN 1 - y END) AS q0 FROM md),
v AS (SELECT *, (1 / p0 + 1 / q0) / pow(1 - 1 / (p0 + q0), 2) AS v0, (1 / p1 + 1 / q1) / pow(1 - 1 / (p1 + q1), 2) AS v1 FROM c)
SELECT 'intercept' AS term, ln(p0 / q0) AS coef, sqrt(v0) AS se FROM v UNION ALL SELECT 'a', ln(p1 / q1) - ln(p0 / q0), sqrt(v0 + v1) FROM v""", "coef se", 5)
q("m08_glm_binomial", lambda t: M.glm_binomial(_modelled(t).withColumn("rate", F.least(F.col("n_orders") / 25.0, F.lit(1.0))), ["c_acctbal", "a"], "rate")[0])
q("m08_glm_closed_form", lambda t: M.glm_binomial(_modelled(t).withColumn("rate", F.least(F.col("n_orders") / 25.0, F.lit(1.0))), ["a"], "rate")[0].select("term", "coef"), f"""
WITH {_MODELLED}, r AS (SELECT a, least(greatest(n_orders / 25.0, 1e-6), 1 - 1e-6) AS r FROM md), m AS (SELECT avg(CASE WHEN a = 1 THEN r END) AS m1, avg(CASE WHEN a = 0 THEN r END) AS m0 FROM r)
SELECT 'intercept' AS term, ln(m0 / (1 - m0)) AS coef FROM m UNION ALL SELECT 'a', ln(m1 / (1 - m1)) - ln(m0 / (1 - m0)) FROM m""", "coef", 5)
q("m09_vif", lambda t: M.vif(t("lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]),
  "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT 'l_quantity' AS term, 1 / (1 - r * r) AS vif FROM r UNION ALL SELECT 'l_extendedprice', 1 / (1 - r * r) FROM r", "vif")
q("m10_corr_matrix", lambda t: M.corr_matrix(t("lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"]),
  " UNION ALL ".join(f"SELECT '{a}' AS covariate, '{b}' AS target, corr({a}, {b}) AS corr FROM lineitem" for a in ("l_quantity", "l_discount") for b in ("l_extendedprice", "l_tax")), "corr")
q("m11_gbt_importance", lambda t: M.fit_gbt(_modelled(t), XS + ["a"], "y", max_iter=5, max_depth=3)[0])
q("m11_gbt_regression", lambda t: M.fit_gbt(_modelled(t), ["c_acctbal", "n_orders"], "spend", task="regression", max_iter=5, max_depth=3)[0])
q("m11_random_forest", lambda t: M.fit_gbt(_modelled(t), XS, "y", kind="forest", max_iter=5, max_depth=3)[0])
q("m12_split", lambda t: M.split(t("customer").select("c_custkey"), "c_custkey", 0.8, 3)[0],
  "SELECT c_custkey FROM customer WHERE CAST('0x' || substring(md5(c_custkey || '|3'), 1, 8) AS BIGINT) < 3435973837")
q("m12_split_stratified", lambda t: M.split(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", 0.75, 3, "c_mktsegment")[1].groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
  "SELECT c_mktsegment, count(*) AS n FROM (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|3'), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE k > round(0.75 * n) GROUP BY 1")
q("m12_split_fine", lambda t: M.split(t("orders").select("o_orderkey"), "o_orderkey", 0.995, 3)[1],
  "SELECT o_orderkey FROM orders WHERE CAST('0x' || substring(md5(o_orderkey || '|3'), 1, 8) AS BIGINT) >= 4273492460")
q("x18_ols_large_covariate", lambda t: ST.ols(t("events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), (F.lit(5.0) + F.col("event_id") % 7 + F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("y")), "y", ["micros"])[0].select("term", "coef", "se"), """
WITH x AS (SELECT epoch_us(ts) / 3.6e9 AS h, 5.0 + event_id % 7 + epoch_us(ts) / 3.6e9 AS y FROM events), m AS (SELECT avg(h) AS mh, avg(y) AS my, count(*) AS n FROM x),
s AS (SELECT sum((h - mh) * (h - mh)) AS hh, sum((h - mh) * (y - my)) AS hy, sum((y - my) * (y - my)) AS yy, any_value(mh) AS mh, any_value(my) AS my, any_value(n) AS n FROM x, m)
SELECT 'intercept' AS term, my - hy / hh * mh AS coef, sqrt((yy - hy * hy / hh) / (n - 2) * (1.0 / n + mh * mh / hh)) AS se FROM s
UNION ALL SELECT 'micros', hy / hh / 3.6e9, sqrt((yy - hy * hy / hh) / (n - 2) / hh) / 3.6e9 FROM s""", floats="coef se")


def _scored(t):
    return _modelled(t).withColumn("score", F.round(F.least(F.greatest((F.col("c_acctbal") + 1000) / 12000, F.lit(0.01)), F.lit(0.99)), 2))


_SCORED = f"{_MODELLED}, sc AS (SELECT *, round(least(greatest((c_acctbal + 1000) / 12000, 0.01), 0.99), 2) AS score FROM md)"
q("m13_evaluate", lambda t: M.evaluate(_scored(t), "score", "y"), f"""
WITH {_SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sc),
s AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, sum(CASE WHEN y = 1 THEN rk END) AS rs, -avg(y * ln(score) + (1 - y) * ln(1 - score)) AS log_loss, CAST(sum(CASE WHEN score >= 0.5 THEN y ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN score >= 0.5 THEN 1 - y ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN score < 0.5 THEN y ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN score < 0.5 THEN 1 - y ELSE 0 END) AS BIGINT) AS tn FROM r)
SELECT n, positives, (rs - positives * (positives + 1) / 2.0) / (positives * (n - positives)) AS auc, log_loss, tp, fp, fn, tn FROM s""", "auc log_loss")
q("m14_score_deciles", lambda t: M.score_deciles(_scored(t), "score", "y", "c_custkey"), f"""
WITH {_SCORED}, d AS (SELECT *, CAST(ntile(10) OVER (ORDER BY score DESC, c_custkey) AS INTEGER) AS decile FROM sc)
SELECT decile, count(*) AS n, CAST(sum(y) AS BIGINT) AS converters, avg(y) AS rate, min(score) AS min_score, max(score) AS max_score, avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score, avg(y) / (SELECT avg(y) FROM d WHERE decile = 10) AS lift_vs_bottom FROM d GROUP BY 1""",
  "rate min_score max_score mean_score median_score lift_vs_bottom")


def _cluster(t):
    from cohortspark.operators.sessions import session_features

    feats = session_features(sess(t), SKEY, "ts", "event_type", ["view", "click", "purchase"])
    return M.cluster_sessions(feats, ["n_events", "duration_s", "n_view", "n_click", "n_purchase"], [2, 3, 4])


q("m15_cluster_sweep", lambda t: _cluster(t)[0])
q("m15_cluster_profile", lambda t: M.profile_clusters(_cluster(t)[1], "cluster", ["n_events", "duration_s", "n_purchase"]))

q("m16_davies_bouldin", lambda t: M.davies_bouldin(t("embeddings"), "embedding", "label"), f"""
WITH l AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM l GROUP BY 1, 2),
d AS (SELECT vec_id, l.label, sqrt(sum((v - m) * (v - m))) AS dist FROM l JOIN c ON c.label = l.label AND c.i = l.i GROUP BY 1, 2), s AS (SELECT label, avg(dist) AS s FROM d GROUP BY 1),
p AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
w AS (SELECT la, max((x.s + y.s) / gap) AS worst FROM p JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY 1)
SELECT CAST(count(*) AS INTEGER) AS k, avg(worst) AS davies_bouldin FROM w""", "davies_bouldin", 5)
q("m17_pca", lambda t: M.pca2(t("embeddings"), "embedding")[0].select("vec_id", "pc1", "pc2"))
q("m17_pca_variance", lambda t: M.pca2(t("embeddings"), "embedding")[1])

# ---------------------------------------------------------------- causal and uplift

q("m18_match_with_replacement", lambda t: CI.psm_match(_modelled(t), "c_custkey", "a", score_col="c_acctbal", caliper=0.001, replace=True).select("treated_id", "control_id", "gap"), f"""
WITH {_MODELLED}, w AS (SELECT 0.001 * stddev_samp(c_acctbal) AS cal FROM md),
p AS (SELECT t.c_custkey AS treated_id, c.c_custkey AS control_id, abs(t.c_acctbal - c.c_acctbal) AS gap, row_number() OVER (PARTITION BY t.c_custkey ORDER BY round(abs(t.c_acctbal - c.c_acctbal), 6), c.c_acctbal, c.c_custkey) AS rn FROM md t, md c WHERE t.a = 1 AND c.a = 0)
SELECT treated_id, control_id, gap FROM p, w WHERE rn = 1 AND gap <= cal""", "gap")

def _whole_scores(t):
    return _modelled(t).select("c_custkey", "a", F.floor(F.col("c_acctbal") / 5).alias("s"))


# greedy over all pairs within reach in order of gap, lower score and ids; one row of the recursion per pair
q("m18_match_whole_scores", lambda t: CI.match_without_replacement(_whole_scores(t), "c_custkey", "a", "s", 1.0, cluster_limit=100).select("treated_id", "control_id", "gap"), f"""
WITH RECURSIVE {_MODELLED}, sc AS (SELECT c_custkey AS id, a, floor(c_acctbal / 5) AS s FROM md),
p AS (SELECT t.id AS t, c.id AS c, abs(t.s - c.s) AS gap, row_number() OVER (ORDER BY abs(t.s - c.s), least(t.s, c.s), t.id, c.id) AS r FROM sc t JOIN sc c ON t.a = 1 AND c.a = 0 AND abs(t.s - c.s) <= 1),
g AS (SELECT 0 AS r, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS cs, false AS took
  UNION ALL SELECT p.r, CASE WHEN free THEN list_append(ts, t) ELSE ts END, CASE WHEN free THEN list_append(cs, c) ELSE cs END, free
  FROM (SELECT g.r + 1 AS n, ts, cs FROM g) JOIN p ON p.r = n, LATERAL (SELECT NOT list_contains(ts, t) AND NOT list_contains(cs, c) AS free))
SELECT t AS treated_id, c AS control_id, CAST(gap AS DOUBLE) AS gap FROM g JOIN p ON g.r = p.r WHERE took""")
q("m18_match_without_replacement", lambda t: CI.psm_match(_modelled(t), "c_custkey", "a", XS))
q("m18_match_balance", lambda t: ST.balance(_modelled(t).join(
    CI.psm_match(_modelled(t), "c_custkey", "a", XS).select(F.explode(F.array("treated_id", "control_id")).alias("c_custkey")), "c_custkey"), "a", 1, 0, XS))
_TREE = dict(max_iter=3, max_depth=2)


def _uplift(t, learner):
    df = _modelled(t)
    return learner.fit(df).predict(df).select("c_custkey", "a", "y", "uplift")


q("m19_t_learner", lambda t: _uplift(t, CI.TLearner(XS, "a", "y", **_TREE)))
q("m20_x_learner", lambda t: _uplift(t, CI.XLearner(XS, "a", "y", **_TREE)))
q("m20_x_learner_mean", lambda t: _uplift(t, CI.XLearner(XS, "a", "y", weighting="mean", **_TREE)))
q("m21_transformed_outcome", lambda t: CI.transformed_outcome_tree(_modelled(t), XS, "a", "y", max_depth=2)[0].select("c_custkey", "uplift"))


# one tree of depth 1 on a 0/1 feature gives the means of its two groups, so folds can be checked by counting; where both
# groups have the same likelier class, the tree keeps one leaf
_STUMP = dict(kind="forest", max_iter=1, max_depth=1)


def _stumps(t):
    return _modelled(t).withColumn("x", (F.col("c_acctbal") > 4000).cast("int"))


def _oof(t, learner):
    return CI.cross_fit(learner, _stumps(t), "c_custkey", folds=4)


_OOF = f"""{_MODELLED}, st AS (SELECT c_custkey, a, y, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS x, CAST('0x' || substring(md5(c_custkey || '|0'), 1, 8) AS BIGINT) % 4 AS fold FROM md),
f AS (SELECT unnest([0, 1, 2, 3]) AS fold), g0 AS (SELECT f.fold, x, avg(y) FILTER (a = 1) AS p1, avg(y) FILTER (a = 0) AS p0, avg(a) AS e FROM f JOIN st ON st.fold <> f.fold GROUP BY 1, 2),
w0 AS (SELECT f.fold, avg(y) FILTER (a = 1) AS w1, avg(y) FILTER (a = 0) AS w0, avg(a) AS we FROM f JOIN st ON st.fold <> f.fold GROUP BY 1),
g AS (SELECT fold, x, CASE WHEN count(*) FILTER (p1 > 0.5) OVER k = 1 THEN p1 ELSE w1 END AS p1, CASE WHEN count(*) FILTER (p0 > 0.5) OVER k = 1 THEN p0 ELSE w0 END AS p0, CASE WHEN count(*) FILTER (e > 0.5) OVER k = 1 THEN e ELSE we END AS e FROM g0 JOIN w0 USING (fold) WINDOW k AS (PARTITION BY fold)),
p AS (SELECT st.*, p1, p0, e FROM st JOIN g USING (fold, x)),
h AS (SELECT f.fold, x, avg(y - p0) FILTER (a = 1) AS t1, avg(p1 - y) FILTER (a = 0) AS t0 FROM f JOIN p ON p.fold <> f.fold GROUP BY 1, 2)"""
q("m19_t_learner_cross_fitted", lambda t: _oof(t, CI.TLearner(["x"], "a", "y", **_STUMP)).select("c_custkey", "fold", "uplift"),
  f"WITH {_OOF} SELECT c_custkey, CAST(fold AS INTEGER) AS fold, p1 - p0 AS uplift FROM p", "uplift")
q("m20_x_learner_cross_fitted", lambda t: _oof(t, CI.XLearner(["x"], "a", "y", **_STUMP)).select("c_custkey", "uplift"),
  f"WITH {_OOF} SELECT c_custkey, e * t0 + (1 - e) * t1 AS uplift FROM p JOIN h USING (fold, x)", "uplift")
q("m20_x_learner_mean_cross_fitted", lambda t: _oof(t, CI.XLearner(["x"], "a", "y", weighting="mean", **_STUMP)).select("c_custkey", "uplift"),
  f"WITH {_OOF} SELECT c_custkey, (t0 + t1) / 2 AS uplift FROM p JOIN h USING (fold, x)", "uplift")
# Qini on rows whose models have not seen them; equal scores are rounded together
q("m22_qini_held_out", lambda t: U.uplift_summary(U.qini_curve(_oof(t, CI.TLearner(["x"], "a", "y", **_STUMP)).withColumn("score", F.round("uplift", 9)), "score", "a", "y", "c_custkey")), f"""
WITH {_OOF}, o AS (SELECT row_number() OVER w AS position, sum(a) OVER w AS nt, sum(1 - a) OVER w AS nc, sum(y * a) OVER w AS yt, sum(y * (1 - a)) OVER w AS yc, count(*) OVER () AS n, sum(a) OVER () AS all_t, sum(1 - a) OVER () AS all_c
    FROM p WINDOW w AS (ORDER BY round(p1 - p0, 9) DESC, c_custkey ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, yt - coalesce(yc * nt / nullif(nc, 0), 0) AS curve, yt / greatest(all_t, 1) - yc / greatest(all_c, 1) AS rate_gap FROM o), s AS (SELECT max(n) AS n, sum(curve) - (max(CASE WHEN position = 1 THEN curve END) + max(CASE WHEN position = n THEN curve END)) / 2 AS area,
  sum(rate_gap) - (max(CASE WHEN position = 1 THEN rate_gap END) + max(CASE WHEN position = n THEN rate_gap END)) / 2 AS ua, max(CASE WHEN position = n THEN curve END) AS fin FROM k)
SELECT n, area / n AS qini_coefficient, (area - fin * (n - 1) * (n + 1) / (2.0 * n)) / n AS qini_auc, ua / n AS auuc FROM s""", "qini_coefficient qini_auc auuc")
q("m21_transformed_outcome_means", lambda t: CI.transformed_outcome_tree(_stumps(t), ["x"], "a", "y", max_depth=1)[0].select("c_custkey", "uplift"), f"""
WITH {_OOF}, r AS (SELECT avg(a) AS r FROM st), z AS (SELECT x, avg(y * a / r - y * (1 - a) / (1 - r)) AS uplift FROM st, r GROUP BY 1) SELECT c_custkey, uplift FROM st JOIN z USING (x)""", "uplift")
q("m11_forest_held_out", lambda t: _held_out(t), f"""
WITH {_MODELLED}, st AS (SELECT y, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS x, CAST('0x' || substring(md5(c_custkey || '|0'), 1, 8) AS BIGINT) >= 3435973837 AS test FROM md),
c AS (SELECT avg(y) FILTER (NOT test AND x = 1) > avg(y) FILTER (NOT test AND x = 0) AS up, sum(y) FILTER (test AND x = 1) AS p1, sum(1 - y) FILTER (test AND x = 1) AS q1, sum(y) FILTER (test AND x = 0) AS p0, sum(1 - y) FILTER (test AND x = 0) AS q0 FROM st)
SELECT 'x' AS feature, 100.0 AS importance_pct, (CASE WHEN up THEN p1 * q0 ELSE p0 * q1 END + 0.5 * (p1 * q1 + p0 * q0)) / ((p1 + p0) * (q1 + q0)) AS auc FROM c""", "importance_pct auc")


def _held_out(t):
    table, _, auc = M.fit_gbt(_stumps(t), ["x"], "y", key="c_custkey", test=0.2, **_STUMP)
    return table.withColumn("auc", F.lit(auc))


# closed forms: one cluster has its rows less one as inertia of each standardised feature; two features have the two eigenvalues of their covariance
q("m15_one_cluster", lambda t: M.cluster_sessions(t("lineitem").select("l_quantity", "l_tax", "l_discount"), ["l_quantity", "l_tax", "l_discount"], [1])[0],
  "SELECT CAST(1 AS INTEGER) AS k, 3.0 * (count(*) - 1) AS inertia, CAST(NULL AS DOUBLE) AS silhouette FROM lineitem", "inertia silhouette", 3)
q("m17_pca_two_columns", lambda t: M.pca2(t("lineitem").select(F.array("l_quantity", F.col("l_extendedprice") / 2000).alias("v")), "v")[1], """
WITH c AS (SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice / 2000) AS b, covar_samp(l_quantity, l_extendedprice / 2000) AS ab FROM lineitem), e AS (SELECT (a + b) / 2 AS m, sqrt((a - b) * (a - b) / 4 + ab * ab) AS d FROM c)
SELECT CAST(1 AS INTEGER) AS component, (m + d) / (2 * m) AS explained FROM e UNION ALL SELECT 2, (m - d) / (2 * m) FROM e""", "explained", 5)

_QINI = f"""{_SCORED}, o AS (SELECT c_custkey, a, y, row_number() OVER w AS position, sum(a) OVER w AS nt, sum(1 - a) OVER w AS nc, sum(y * a) OVER w AS yt, sum(y * (1 - a)) OVER w AS yc, count(*) OVER () AS n, sum(a) OVER () AS all_t, sum(1 - a) OVER () AS all_c
    FROM sc WINDOW w AS (ORDER BY score DESC, c_custkey ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, yt - coalesce(yc * nt / nullif(nc, 0), 0) AS curve, yt / greatest(all_t, 1) - yc / greatest(all_c, 1) AS rate_gap FROM o)"""
q("m22_qini_curve", lambda t: U.qini_curve(_scored(t), "score", "a", "y", "c_custkey").select("c_custkey", "position", "curve", "rate_gap", "incremental"),
  f"WITH {_QINI} SELECT c_custkey, position, curve, rate_gap, yt - yc AS incremental FROM k", "curve rate_gap incremental")
q("m22_uplift_summary", lambda t: U.uplift_summary(U.qini_curve(_scored(t), "score", "a", "y", "c_custkey")), f"""
WITH {_QINI}, s AS (SELECT max(n) AS n, sum(curve) - (max(CASE WHEN position = 1 THEN curve END) + max(CASE WHEN position = n THEN curve END)) / 2 AS area, sum(rate_gap) - (max(CASE WHEN position = 1 THEN rate_gap END) + max(CASE WHEN position = n THEN rate_gap END)) / 2 AS ua,
  max(CASE WHEN position = n THEN curve END) AS fin FROM k) SELECT n, area / n AS qini_coefficient, (area - fin * (n - 1) * (n + 1) / (2.0 * n)) / n AS qini_auc, ua / n AS auuc FROM s""", "qini_coefficient qini_auc auuc")
q("m22_uplift_at_k", lambda t: U.uplift_at_k(_scored(t), "score", "a", "y", "c_custkey", (0.3, 0.5, 0.8)), f"WITH {_QINI} " + " UNION ALL ".join(
    f"SELECT CAST({k} AS DOUBLE) AS k, avg(CASE WHEN a = 1 THEN y END) AS treated_rate, avg(CASE WHEN a = 0 THEN y END) AS control_rate, avg(CASE WHEN a = 1 THEN y END) - avg(CASE WHEN a = 0 THEN y END) AS uplift FROM k WHERE position <= floor(n * {k})" for k in (0.3, 0.5, 0.8)), "treated_rate control_rate uplift")
q("m23_uplift_buckets", lambda t: U.uplift_buckets(_scored(t), "score", "a", "y", "c_custkey", 4), f"""
WITH {_SCORED}, d AS (SELECT *, CAST(ntile(4) OVER (ORDER BY score DESC, c_custkey) AS INTEGER) AS bucket FROM sc)
SELECT bucket, count(*) AS n, avg(score) AS predicted, count(CASE WHEN a = 1 THEN 1 END) AS n_treated, avg(CASE WHEN a = 1 THEN y END) AS treated_rate, avg(CASE WHEN a = 0 THEN y END) AS control_rate, avg(CASE WHEN a = 1 THEN y END) - avg(CASE WHEN a = 0 THEN y END) AS observed FROM d GROUP BY 1""",
  "predicted treated_rate control_rate observed")
q("m24_threshold_policy", lambda t: U.threshold_policy(t("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("score")), "user_id", "event_type", "score", {"view": 55.0, "click": 52.0, "error": 60.0}), """
WITH s AS (SELECT user_id, event_type, avg(value) AS score FROM events GROUP BY 1, 2), k AS (SELECT *, CASE event_type WHEN 'view' THEN 55.0 WHEN 'click' THEN 52.0 WHEN 'error' THEN 60.0 END AS cut FROM s)
SELECT user_id, CASE WHEN count(CASE WHEN score >= cut THEN 1 END) > 0 THEN 1 ELSE 0 END AS target, arg_max(CASE WHEN score >= cut THEN event_type END, CASE WHEN score >= cut THEN (score, event_type) END) AS channel, max(score) AS max_score FROM k GROUP BY 1""", "max_score")


def _its(t):
    return CI.its(CI.daily_metric(t("events"), "ts", F.sum(F.when(is_type("purchase"), F.col("value")))), "day", "y", "2024-01-16")


_ITS = """d AS (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'purchase' THEN value END) AS y FROM events GROUP BY 1), t AS (SELECT *, date_diff('day', (SELECT min(day) FROM d), day) AS t, day >= DATE '2024-01-16' AS post FROM d),
  f AS (SELECT regr_intercept(y, t) FILTER (NOT post) AS b0, regr_slope(y, t) FILTER (NOT post) AS b1, regr_intercept(y, t) FILTER (post) AS c0, regr_slope(y, t) FILTER (post) AS c1, min(t) FILTER (post) AS s FROM t)"""
q("m25_its_terms", lambda t: _its(t)[0].select("term", "coef"), f"""
WITH {_ITS} SELECT 'intercept' AS term, b0 AS coef FROM f UNION ALL SELECT 'time', b1 FROM f UNION ALL SELECT 'post', c0 + c1 * s - b0 - b1 * s FROM f UNION ALL SELECT 'time_after', c1 - b1 FROM f""", "coef", 4)
q("m25_its_effects", lambda t: _its(t)[1].select("day", "y", "counterfactual", "effect", "cumulative_effect"), f"""
WITH {_ITS}, e AS (SELECT day, y, b0 + b1 * t AS counterfactual, CASE WHEN post THEN y - b0 - b1 * t ELSE 0 END AS effect FROM t, f) SELECT *, sum(effect) OVER (ORDER BY day) AS cumulative_effect FROM e""", "y counterfactual effect cumulative_effect", 4)
q("m25_its_summary", lambda t: _its(t)[2].select("cumulative_effect", "mean_effect", "relative_effect", "level_change", "trend_change"), f"""
WITH {_ITS}, e AS (SELECT y, b0 + b1 * t AS cf, c0 + c1 * s - b0 - b1 * s AS lv, c1 - b1 AS tr FROM t, f WHERE post)
SELECT sum(y - cf) AS cumulative_effect, avg(y - cf) AS mean_effect, sum(y - cf) / sum(cf) AS relative_effect, any_value(lv) AS level_change, any_value(tr) AS trend_change FROM e""", "cumulative_effect mean_effect relative_effect level_change trend_change", 4)

# ---------------------------------------------------------------- similarity and sequences


def _vectors(t):
    return t("embeddings").select("vec_id", (F.col("vec_id") % 40).alias("unit"), "embedding")


_COS = "list_dot_product(CAST(embedding AS DOUBLE[]), CAST(r AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(r AS DOUBLE[]), CAST(r AS DOUBLE[])))"
q("m26_similarity_prev", lambda t: SQ.session_similarity(_vectors(t), "unit", ["vec_id"], "embedding", "prev").select("vec_id", "similarity"),
  f"SELECT vec_id, {_COS} AS similarity FROM (SELECT *, lag(embedding) OVER (PARTITION BY vec_id % 40 ORDER BY vec_id) AS r FROM embeddings)", "similarity", 5)
q("m26_similarity_anchor", lambda t: SQ.session_similarity(_vectors(t), "unit", ["vec_id"], "embedding", "anchor").select("vec_id", "similarity"),
  f"SELECT vec_id, {_COS} AS similarity FROM (SELECT *, first_value(embedding) OVER (PARTITION BY vec_id % 40 ORDER BY vec_id) AS r FROM embeddings)", "similarity", 5)
q("m26_text_similarity", lambda t: SQ.session_similarity(SQ.text_vectors(t("conversations"), "text", features=256), "conv_id", ["turn"], "vec", "prev").select("conv_id", "turn", "similarity"))
q("m27_profile_text", lambda t: t("part").withColumn("pad", F.when(F.col("p_partkey") % 9 == 0, "  ")).withColumn("a", F.when(F.col("p_partkey") % 9 != 0, F.concat("p_name", F.lit("   "), "p_type"))).select("p_partkey", SQ.profile_text(["a", "pad"]).alias("profile")),
  "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN lower(p_name || ' ' || p_type) END AS profile FROM part")

_TOK = """v AS (SELECT event_type AS e, 1 + row_number() OVER (ORDER BY count(*) DESC, event_type) AS id FROM events GROUP BY 1 HAVING count(*) >= 2000)"""
q("m28_session_sequences", lambda t: SQ.session_sequences(t("events"), ["user_id"], "ts", "event_id", "event_type", max_len=20, min_freq=2000).select(
    "user_id", "n_events", F.array_join("events", ">").alias("events"), F.array_join(F.transform("token_ids", lambda x: x.cast("string")), ",").alias("tokens"), F.aggregate("seconds_since_prev", F.lit(0.0), lambda s, x: s + x).alias("seconds")), f"""
WITH {_TOK}, n AS (SELECT user_id, event_type, coalesce(id, 1) AS id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0, 0) AS g
  FROM events LEFT JOIN v ON e = event_type WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, any_value(n) AS n_events, string_agg(event_type, '>' ORDER BY rn) AS events, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) || repeat(',0', CAST(20 - count(*) AS INTEGER)) AS tokens, sum(g) AS seconds FROM n WHERE rn <= 20 GROUP BY 1 HAVING any_value(n) >= 2""", "seconds", 3)


def _touch(t):
    w = SQ.touch_weights(sess(t), SKEY, "ts", "event_id")
    bought = sess(t).groupBy(*SKEY).agg(F.max(F.when(is_type("purchase"), 1).otherwise(0)).alias("bought"))
    return w.join(bought, SKEY)


_TOUCH = f"""{sess_sql()}, w AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_date, session_num ORDER BY ts, event_id) AS position, 1.0 / count(*) OVER (PARTITION BY user_id, event_date, session_num) AS score,
  max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_date, session_num) AS bought FROM s)"""
q("m29_attribution_events", lambda t: SQ.attribution_summary(_touch(t), "bought", "event_type", "score", "position")[0],
  f"WITH {_TOUCH} SELECT event_type, count(*) AS n, avg(CASE WHEN bought = 1 THEN score END) AS score_1, avg(CASE WHEN bought = 0 THEN score END) AS score_0, avg(CASE WHEN bought = 1 THEN score END) / nullif(avg(CASE WHEN bought = 0 THEN score END), 0) AS lift FROM w GROUP BY 1", "score_1 score_0 lift")
q("m29_attribution_positions", lambda t: SQ.attribution_summary(_touch(t), "bought", "event_type", "score", "position")[1],
  f"WITH {_TOUCH} SELECT least(position, 5) AS position_bin, count(*) AS n, avg(score) AS mean_score FROM w GROUP BY 1", "mean_score")
q("m29_top_stores", lambda t: SQ.top_entities(_touch(t).withColumn("store", F.col("event_id") % 60), "store", "score", 10, 100).withColumn("mean_score", F.round("mean_score", 6)),
  f"WITH {_TOUCH} SELECT event_id % 60 AS store, count(*) AS n, avg(score) AS mean_score FROM w GROUP BY 1 HAVING count(*) >= 100 ORDER BY mean_score DESC, store LIMIT 10", "mean_score")

q("m30_segment_uplift", lambda t: CI.segment_uplift(_modelled(t), "c_mktsegment", XS, "a", "y", min_n=50))
# one 0/1 feature: the models give the rates of its groups
q("m30_segment_uplift_rates", lambda t: CI.segment_uplift(_binary(t), "cohort", ["x"], "a", "y", min_n=20, cutoff=0.01), """
WITH b AS (SELECT l_partkey % 200 AS cohort, l_quantity > 25 AS a, l_tax > 0.04 AS x, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y FROM lineitem),
n AS (SELECT cohort, count(*) FILTER (a) AS n_treated, count(*) FILTER (NOT a) AS n_control FROM b GROUP BY 1),
g AS (SELECT cohort, x, count(*) AS n, avg(y) FILTER (a) - avg(y) FILTER (NOT a) AS gain FROM b GROUP BY 1, 2)
SELECT CAST(cohort AS VARCHAR) AS segment, n_treated, n_control, CASE WHEN least(n_treated, n_control) >= 20 THEN sum(gain * g.n) / sum(g.n) END AS mean_uplift,
  CASE WHEN least(n_treated, n_control) >= 20 THEN sum(CASE WHEN gain > 0.01 THEN g.n ELSE 0 END) / sum(g.n) END AS targeted_share
FROM n JOIN g USING (cohort) GROUP BY cohort, n_treated, n_control""", "mean_uplift targeted_share", 5)


def _levels(t):
    train = t("customer").filter("c_mktsegment <> 'MACHINERY'")
    return PR.apply_levels(PR.fit_levels(train, ["c_mktsegment"]), t("customer")).select("c_custkey", "c_mktsegment_idx")


q("m31_levels", _levels, """
WITH l AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'))
SELECT c_custkey, CAST(coalesce(i, (SELECT count(*) FROM l)) AS INTEGER) AS c_mktsegment_idx FROM customer LEFT JOIN l USING (c_mktsegment)""")
