"""Queries for joins, aggregation, windows, sorting, set operations and data quality."""

from pyspark.sql import functions as F

from cohortspark.functions import exprs as X
from cohortspark.operators import aggs as A, joins as J, quality as Q, windows as W
from cohortspark.operators.ordered import OrderedScan, key_max, key_min, row_number
from cohortspark.plans.common import HISTORY_SQL, UNITS_SQL, arm_of, order_history, unit_orders
from cohortspark.plans.registry import q

# ---------------------------------------------------------------- joins

q("j01_inner_join", lambda t: t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "inner").groupBy("s_name").agg(F.sum("l_quantity").alias("qty")),
  "SELECT s_name, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")

q("j02_left_join", lambda t: t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left"),
  "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")

q("j03_right_join", lambda t: t("orders").filter("o_totalprice > 450000").select("o_custkey", "o_orderkey").join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "right"),
  "SELECT o_custkey, o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 450000) o RIGHT JOIN customer ON o_custkey = c_custkey")

q("j04_natural_full_join", lambda t: J.natural_full_join(
    t("events").filter("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("buys")),
    t("events").filter("event_type = 'error'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("errors"))),
  """
SELECT * FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS buys FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
FULL JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2) USING (user_id, day)""")

q("j05_using_join", lambda t: t("nation").withColumnRenamed("n_regionkey", "r_regionkey").join(t("region"), ["r_regionkey"]), "SELECT n_regionkey AS r_regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")

q("j06_with_totals", lambda t: J.with_totals(t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), t("orders").agg(F.count(F.lit(1)).alias("n_all"), F.max("o_totalprice").alias("top_price"))),
  "SELECT o_orderpriority, count(*) AS n, (SELECT count(*) FROM orders) AS n_all, (SELECT max(o_totalprice) FROM orders) AS top_price FROM orders GROUP BY 1")

q("j07_spine_cross", lambda t: J.spine_cross(t("events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first_day")), F.col("first_day"), F.lit("2024-01-30").cast("date")).select("user_id", "day"),
  "SELECT user_id, CAST(unnest(generate_series(CAST(min(ts) AS DATE), DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM events GROUP BY user_id")

q("j08_semi_join", lambda t: J.semi_join(t("customer"), t("orders").filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"),
  "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")

q("j09_anti_join", lambda t: J.anti_join(t("customer"), t("orders").filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"),
  "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")

q("j10_contains_join", lambda t: J.contains_join(t("documents"), t("benchmark").select(F.split_part("text", F.lit("."), F.lit(1)).alias("needle")), "doc_id", "text", "needle").select("doc_id", "lang"),
  "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(d.text), lower(split_part(b.text, '.', 1))))")

# whole benchmark texts as patterns
q("j10_contains_whole_items", lambda t: J.contains_join(t("documents"), t("benchmark"), "doc_id", "text", "text").select("doc_id", "lang"),
  "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(d.text), lower(b.text)))")


def _buys(t):
    return t("events").filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("buy_id"))


q("j11_window_join", lambda t: J.window_join(t("events").filter("event_type = 'click'").select("event_id", "user_id", "ts"), _buys(t), "user_id", "ts", "buy_ts", 0, 86400, how="left").select("event_id", "buy_id"),
  """
SELECT c.event_id, b.event_id AS buy_id FROM (SELECT * FROM events WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON b.user_id = c.user_id AND b.ts > c.ts AND b.ts <= c.ts + INTERVAL 24 HOUR""")

q("j12_lookback_join", lambda t: J.lookback_join(
    t("events").filter("event_type = 'purchase'").select("event_id", "user_id", F.to_date("ts").alias("day")),
    t("events").filter("event_type = 'view'").select("user_id", F.to_date("ts").alias("view_day"), F.col("event_id").alias("view_id")), "user_id", "day", "view_day", 7).select("event_id", "view_id"),
  """
SELECT p.event_id, v.event_id AS view_id FROM events p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view'
 AND CAST(v.ts AS DATE) BETWEEN CAST(p.ts AS DATE) - 7 AND CAST(p.ts AS DATE) - 1 WHERE p.event_type = 'purchase'""")


def _anchor(t):
    return t("customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"), F.date_add(F.lit("1995-06-01").cast("date"), (F.col("c_custkey") % 2200).cast("int")).alias("anchor"))


q("j13_scd_asof", lambda t: J.scd_asof(_anchor(t), order_history(t), "o_custkey", "anchor", "start_day", "end_day", ["state"]).select("c_custkey", "anchor", "state"),
  f"""
WITH {HISTORY_SQL}, a AS (SELECT c_custkey, DATE '1995-06-01' + CAST(c_custkey % 2200 AS INTEGER) AS anchor FROM customer)
SELECT c_custkey, anchor, state FROM (
  SELECT a.c_custkey, a.anchor, scd.state, row_number() OVER (PARTITION BY c_custkey ORDER BY start_day DESC NULLS LAST) AS rn
  FROM a LEFT JOIN scd ON o_custkey = c_custkey AND start_day <= anchor AND anchor <= coalesce(end_day, DATE '9999-12-31')) WHERE rn = 1""")

q("j14_scd_current", lambda t: J.scd_current(order_history(t), "start_day", "end_day", "1999-01-01").select("o_custkey", "state", "start_day"),
  f"WITH {HISTORY_SQL} SELECT o_custkey, state, start_day FROM scd WHERE start_day <= DATE '1999-01-01' AND (end_day IS NULL OR end_day >= DATE '1999-01-01')")

q("j15_asof_prior", lambda t: J.asof_prior(
    t("events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), t("events").filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id")),
    "user_id", "ts", "click_ts", ["click_id"], strict=True, tiebreak=["click_id"]).select("event_id", "prior_click_id"),
  """
SELECT p.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS prior_click_id FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts < p.ts
WHERE p.event_type = 'purchase' GROUP BY 1""")

q("j16_clock_skew_join", lambda t: J.window_join(t("events").groupBy("user_id").agg(F.min("ts").alias("t0")), _buys(t), "user_id", "t0", "buy_ts", lo=-10, hi=None, include_lo=True).groupBy("user_id").agg(F.count("buy_id").alias("n")),
  """
SELECT user_id, count(*) AS n FROM (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1) x JOIN events e USING (user_id)
WHERE event_type = 'purchase' AND e.ts >= t0 - INTERVAL 10 SECOND GROUP BY 1""")

q("j17_join_on_str", lambda t: J.join_on_str(t("customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("cid"), "c_mktsegment"), t("orders").select("o_custkey", "o_totalprice"), "cid", "o_custkey")
  .groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
  "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON CAST(c_custkey AS VARCHAR) = CAST(o_custkey AS VARCHAR) GROUP BY 1")

q("j18_fuzzy_join", lambda t: J.fuzzy_join(
    t("part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")), t("part").select(F.reverse(F.split("p_name", " "))[0].alias("noun"), F.split("p_name", " ")[0].alias("adj")).distinct()
    .select(F.concat_ws(" ", F.concat(F.left("adj", F.lit(3)), F.lit("x")), "noun").alias("term")), "p_name", "term", 90).select("p_name", "term", "n", "similarity"),
  """
WITH a AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1),
     b AS (SELECT DISTINCT left(split_part(p_name, ' ', 1), 3) || 'x ' || split_part(p_name, ' ', 2) AS term FROM part)
SELECT p_name, term, n, similarity FROM (SELECT *, CAST(floor(jaro_winkler_similarity(lower(p_name), lower(term)) * 100 + 0.5) AS BIGINT) AS similarity FROM a, b) WHERE similarity >= 90""")

q("j19_nearest_join", lambda t: J.nearest_value_join(
    t("customer").filter("c_custkey % 2 = 1").select("c_custkey", "c_acctbal"), t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ctrl"), F.col("c_acctbal").alias("bal")),
    "c_acctbal", "bal", "ctrl", max_gap=5.0).select("c_custkey", "match_id", "match_gap"),
  """
WITH p AS (SELECT t.c_custkey, c.c_custkey AS ctrl, abs(t.c_acctbal - c.c_acctbal) AS gap,
                  row_number() OVER (PARTITION BY t.c_custkey ORDER BY round(abs(t.c_acctbal - c.c_acctbal), 6), c.c_acctbal, c.c_custkey) AS rn
           FROM customer t, customer c WHERE t.c_custkey % 2 = 1 AND c.c_custkey % 2 = 0)
SELECT c_custkey, CASE WHEN gap <= 5 THEN ctrl END AS match_id, CASE WHEN gap <= 5 THEN gap END AS match_gap FROM p WHERE rn = 1""", "match_gap")

q("j20_device_user_map", lambda t: J.device_user_map(t("events").withColumn("device", F.get_json_object("props", "$.k").cast("int")), "device", "user_id", "ts"),
  """
WITH edges AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS device, user_id, min(ts) AS f, max(ts) AS l, count(*) AS n FROM events GROUP BY 1, 2)
SELECT device, count(*) AS n_users, arg_max(user_id, (l, user_id)) AS latest_user, min(f) AS first_seen, max(l) AS last_seen, CAST(sum(n) AS BIGINT) AS n_events FROM edges GROUP BY 1""")

q("j21_self_prior_join", lambda t: J.self_prior_join(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", ["o_orderkey", "o_totalprice"], "o_orderkey")
  .select("o_orderkey", "prior_o_orderkey", "prior_o_totalprice"),
  """
SELECT o_orderkey, lag(o_orderkey) OVER w AS prior_o_orderkey, lag(o_totalprice) OVER w AS prior_o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")

q("j22_proximity_join", lambda t: J.proximity_join(
    t("events").filter("event_type = 'error'").select("event_id", "user_id", "ts"), t("events").filter("event_type <> 'error'").select("user_id", F.col("ts").alias("near_ts"), F.col("event_id").alias("near_id")),
    "user_id", "ts", "near_ts", 5).select("event_id", "near_id"),
  """
SELECT a.event_id, b.event_id AS near_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error' AND abs(date_diff('minute', a.ts, b.ts)) <= 5""")

q("j22_nearest_in_time", lambda t: J.nearest_in_time(
    t("events").filter("event_type = 'error'").select("event_id", "user_id", "ts"), t("events").filter("event_type <> 'error'").select("user_id", F.col("ts").alias("near_ts"), F.col("event_id").alias("id")),
    "user_id", "ts", "near_ts", 60, ["id"], "id").select("event_id", "near_id"),
  """
SELECT event_id, near_id FROM (
  SELECT a.event_id, CASE WHEN abs(date_diff('minute', a.ts, b.ts)) <= 60 THEN b.event_id END AS near_id,
         row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, b.event_id) AS rn
  FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'error' AND b.event_type <> 'error') WHERE rn = 1""")

# ---------------------------------------------------------------- aggregation

q("a01_group_by", lambda t: t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
    F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"), F.min("l_discount").alias("min_disc"), F.max("l_tax").alias("max_tax"), F.count(F.lit(1)).alias("n"),
    F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")),
  "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1, 2",
  "avg_price revenue", 3)


def _group_all(t):
    t("orders").createOrReplaceTempView("orders_all")
    return t.spark.sql("SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders_all GROUP BY ALL")


q("a02_group_by_all", _group_all, "SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL")

q("a03_count_distinct", lambda t: t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("supps"), F.count_distinct("l_partkey").alias("parts")),
  "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")

q("a04_conditional_aggregates", lambda t: A.cond_agg(t("events"), ["event_type"], {
    "n": ("count", None, None), "big": ("count", None, F.col("value") > 50), "big_value": ("sum", "value", F.col("value") > 50), "share_big": ("share", None, F.col("value") > 50)}).join(
    A.distinct_entities(t("events"), ["event_type"], "user_id", {"users": F.lit(True), "big_users": F.col("value") > 80, "late_users": F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")}), "event_type"),
  """
SELECT event_type, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS big, sum(CASE WHEN value > 50 THEN value END) AS big_value, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) AS share_big,
       count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN value > 80 THEN user_id END) AS big_users, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN user_id END) AS late_users
FROM events GROUP BY 1""", "big_value share_big")

q("a05_composite_distinct", lambda t: A.count_distinct_keys(t("lineitem"), ["l_returnflag"], ["l_suppkey", "l_partkey"], "pairs"),
  "SELECT l_returnflag, count(DISTINCT (l_suppkey, l_partkey)) AS pairs FROM lineitem GROUP BY 1")

q("a06_flags", lambda t: A.flags(t("events"), ["user_id"], {"bought": F.col("event_type") == "purchase", "big_error": (F.col("event_type") == "error") & (F.col("value") > 90)}),
  "SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought, max(CASE WHEN event_type = 'error' AND value > 90 THEN 1 ELSE 0 END) AS big_error FROM events GROUP BY 1")

q("a07_percentiles", lambda t: A.percentiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.95]),
  "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1", "p10 p50 p95", 4)


def _approx(t):
    exact = A.percentiles(t("orders"), ["o_orderpriority"], "o_totalprice", [0.5, 0.9], ["e50", "e90"])
    near = A.approx_percentiles(t("orders"), ["o_orderpriority"], "o_totalprice", [0.5, 0.9]).join(exact, "o_orderpriority")
    return near.select("o_orderpriority", *[(F.abs(F.col(f"p{p}") / F.col(f"e{p}") - 1) < 0.01).alias(f"ok{p}") for p in (50, 90)])


q("a08_approx_percentile", _approx, "SELECT DISTINCT o_orderpriority, TRUE AS ok50, TRUE AS ok90 FROM orders")

q("a09_mode", lambda t: A.mode_of(t("orders"), ["o_custkey"], "o_orderpriority", "usual"),
  "SELECT o_custkey, o_orderpriority AS usual FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")

q("a10_first_last_by", lambda t: t("events").groupBy("user_id").agg(A.first_by("event_type", "ts", "event_id").alias("first_type"), A.last_by("event_type", "ts", "event_id").alias("last_type"),
    F.max_by(F.when(F.col("event_type") == "click", F.col("value")), F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_click_value")),
  """
SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, ts) FILTER (event_type = 'click') AS last_click_value FROM events GROUP BY 1""")

q("a11_any_value", lambda t: t("customer").groupBy("c_nationkey").agg(F.any_value(F.floor(F.col("c_nationkey") / 5)).alias("grp"), F.count(F.lit(1)).alias("n")),
  "SELECT c_nationkey, any_value(CAST(floor(c_nationkey / 5) AS BIGINT)) AS grp, count(*) AS n FROM customer GROUP BY 1")

q("a12_moments", lambda t: A.moments(t("lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"),
  """
SELECT l_suppkey, count(l_quantity) AS n, avg(l_quantity) AS mean, var_samp(l_quantity) AS var, var_pop(l_quantity) AS var_pop, stddev_samp(l_quantity) AS sd, stddev_pop(l_quantity) AS sd_pop,
       covar_samp(l_quantity, l_extendedprice) AS cov FROM lineitem GROUP BY 1""", "mean var var_pop sd sd_pop cov", 4)

q("a13_listagg", lambda t: A.list_values(t("orders"), ["o_custkey"], "o_orderpriority", "|", "priorities"),
  "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")

q("a14_top_n_array", lambda t: A.top_n_array(t("orders"), ["o_custkey"], "o_orderkey", ["-o_totalprice", "o_orderkey"], 3, "top").select("o_custkey", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top")),
  "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY 1")

q("a15_hours_list", lambda t: A.list_values(t("events").select("user_id", F.hour("ts").alias("h")), ["user_id"], "h", ",", "hours"),
  "SELECT user_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS hours FROM (SELECT DISTINCT user_id, hour(ts) AS h FROM events) GROUP BY 1")

q("a16_share_of_total", lambda t: A.share_of_total(t("orders"), ["o_orderpriority", "o_orderstatus"], ["o_orderpriority"]).join(
    A.share_of_total(t("orders"), ["o_orderpriority", "o_orderstatus"]).withColumnRenamed("share", "share_all").drop("n"), ["o_orderpriority", "o_orderstatus"]),
  "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share, count(*) / sum(count(*)) OVER () AS share_all FROM orders GROUP BY 1, 2", "share share_all")

q("a17_entropy", lambda t: A.entropy(t("events"), ["user_id"], "event_type"),
  "SELECT user_id, -sum(p * ln(p)) AS entropy, count(*) AS n_categories FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) GROUP BY 1", "entropy")

q("a18_arm_pivot", lambda t: A.arm_pivot(unit_orders(t), ["c_mktsegment"], "arm", ["control", "treatment"], {"n": F.count(F.lit(1)), "spend": F.avg("spend")}),
  f"""
WITH {UNITS_SQL} SELECT c_mktsegment, count(CASE WHEN arm = 'control' THEN 1 END) AS control_n, avg(CASE WHEN arm = 'control' THEN spend END) AS control_spend,
  count(CASE WHEN arm = 'treatment' THEN 1 END) AS treatment_n, avg(CASE WHEN arm = 'treatment' THEN spend END) AS treatment_spend FROM units GROUP BY 1""", "control_spend treatment_spend", 3)

q("a19_pivot_table", lambda t: A.pivot_table(t("events").withColumn("day", F.to_date("ts")), ["day"], "event_type", ["click", "purchase", "view"], "value"),
  "SELECT CAST(ts AS DATE) AS day, sum(value) FILTER (event_type = 'click') AS click, sum(value) FILTER (event_type = 'purchase') AS purchase, sum(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 1", "click purchase view", 4)

q("a20_unpivot", lambda t: A.unpivot(t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")), ["l_suppkey"], ["n", "qty"]),
  "SELECT l_suppkey, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'qty', sum(l_quantity) FROM lineitem GROUP BY 1", "value")

q("a21_rollup_totals", lambda t: A.rollup_totals(t("orders"), ["o_orderpriority", "o_orderstatus"], {"n": F.count(F.lit(1)), "total": F.sum("o_totalprice")}),
  "SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2 UNION ALL SELECT 'all', 'all', count(*), sum(o_totalprice) FROM orders", "total", 2)

q("a22_cut_report", lambda t: A.cut_report(unit_orders(t), "arm", ["c_mktsegment", "c_nationkey"], {"n": F.count(F.lit(1)), "mean_spend": F.avg("spend")}),
  f"""
WITH {UNITS_SQL} SELECT arm, 'overall' AS cut, 'all' AS cut_value, count(*) AS n, avg(spend) AS mean_spend FROM units GROUP BY 1
UNION ALL SELECT arm, 'c_mktsegment', c_mktsegment, count(*), avg(spend) FROM units GROUP BY 1, 3
UNION ALL SELECT arm, 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*), avg(spend) FROM units GROUP BY 1, 3""", "mean_spend", 3)

# ---------------------------------------------------------------- windows

q("w01_first_per", lambda t: W.first_per(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["-o_orderdate", "o_orderkey"]),
  "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")

q("w02_rank", lambda t: W.ranks(t("part").select("p_partkey", "p_type", "p_size"), ["p_type"], "p_size", descending=True),
  "SELECT p_partkey, p_type, p_size, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_size DESC)")

q("w03_ntile", lambda t: W.ntile_bucket(W.ntile_bucket(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_totalprice", "o_orderkey"], 10, name="decile"), ["o_totalprice", "o_orderkey"], 4, by=["o_orderpriority"], name="quartile"),
  """
SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS decile,
       CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS quartile FROM orders""")

q("w04_percent_rank_nulls", lambda t: W.pct_rank(t("orders").select("o_orderkey", F.expr("CASE WHEN o_totalprice > 100000 THEN o_orderpriority END").alias("p")), "p").select("o_orderkey", "percent_rank", "cume_dist"),
  """SELECT o_orderkey, percent_rank() OVER (ORDER BY p NULLS FIRST) AS percent_rank, cume_dist() OVER (ORDER BY p NULLS FIRST) AS cume_dist
FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS p FROM orders)""", floats="percent_rank cume_dist")
q("w04_percent_rank", lambda t: W.pct_rank(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").withColumn("top30", (F.col("percent_rank") >= 0.7).cast("int")),
  "SELECT l_orderkey, l_linenumber, l_quantity, percent_rank() OVER (ORDER BY l_quantity) AS percent_rank, cume_dist() OVER (ORDER BY l_quantity) AS cume_dist, CASE WHEN percent_rank() OVER (ORDER BY l_quantity) >= 0.7 THEN 1 ELSE 0 END AS top30 FROM lineitem",
  "percent_rank cume_dist")

# positive and negative zero are one value
q("w04_percent_rank_zeros", lambda t: W.pct_rank(t("customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN -0.0D WHEN 1 THEN 0.0D ELSE c_acctbal END").alias("v")), "v").select("c_custkey", "percent_rank", "cume_dist"),
  """SELECT c_custkey, percent_rank() OVER (ORDER BY v) AS percent_rank, cume_dist() OVER (ORDER BY v) AS cume_dist
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 0.0 ELSE c_acctbal END AS v FROM customer)""", "percent_rank cume_dist")
# the same results from cells: the whole table, and four keys of a quarter of the rows each, count as too large for one task
q("w03_ntile_in_cells", lambda t: W.ntile_bucket(t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_shipdate", "l_orderkey", "l_linenumber"], 10, name="decile", hot_rows=5000),
  "SELECT l_orderkey, l_linenumber, l_shipdate, CAST(ntile(10) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS INTEGER) AS decile FROM lineitem")
q("w05_lag_lead_in_cells", lambda t: W.lag_lead(t("customer").select("c_custkey", "c_mktsegment", "c_name"), ["c_mktsegment"], ["-c_name", "c_custkey"], "c_custkey", hot_rows=200),
  """SELECT c_custkey, c_mktsegment, c_name, lag(c_custkey) OVER w AS prev_c_custkey, lead(c_custkey) OVER w AS next_c_custkey
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_name DESC, c_custkey)""")

q("w05_lag_lead", lambda t: W.lag_lead(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "none"),
  """
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus, 1, 'none') OVER w AS prev_o_orderstatus, lead(o_orderstatus, 1, 'none') OVER w AS next_o_orderstatus
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")


def _holes(t):
    return t("events").select("event_id", "user_id", "ts", F.when(F.col("event_type").isin("click", "view"), F.col("value")).alias("store"), (F.col("event_id") % 4).cast("int").alias("rank_no"))


_HOLES = "h AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('click', 'view') THEN value END AS store, CAST(event_id % 4 AS INTEGER) AS rank_no FROM events)"

q("w06_forward_fill", lambda t: W.forward_fill(_holes(t), ["user_id"], ["ts", "event_id"], ["store"]).select("event_id", "store_filled"),
  f"WITH {_HOLES} SELECT event_id, last_value(store IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS store_filled FROM h")

q("w07_backward_fill", lambda t: W.backward_fill(_holes(t), ["user_id"], ["ts", "event_id"], ["store"]).select("event_id", "store_filled"),
  f"WITH {_HOLES} SELECT event_id, first_value(store IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS store_filled FROM h")

q("w08_fill_by_rank", lambda t: W.fill_by_rank(_holes(t), ["user_id"], ["ts", "event_id"], "store", "rank_no", "store_final", 0.0).select("event_id", "store_final"),
  f"""
WITH {_HOLES}, k AS (SELECT *, CASE WHEN store IS NOT NULL THEN rank_no END AS kr FROM h),
f AS (SELECT *, last_value(store IGNORE NULLS) OVER p AS ps, last_value(kr IGNORE NULLS) OVER p AS pr, first_value(store IGNORE NULLS) OVER n AS ns, first_value(kr IGNORE NULLS) OVER n AS nr FROM k
  WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN store IS NOT NULL THEN store WHEN pr >= rank_no THEN ps WHEN nr <= rank_no THEN ns ELSE 0 END AS store_final FROM f""")

q("w09_over_partition", lambda t: W.over_partition(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], {"best": F.max("o_totalprice"), "worst": F.min("o_totalprice"), "n": F.count(F.lit(1))}),
  "SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER w AS best, min(o_totalprice) OVER w AS worst, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)")

q("w09_over_ordered", lambda t: OrderedScan(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).add(best=key_max("o_totalprice"), worst=key_min("o_totalprice")).result().select("o_orderkey", "best", "worst"),
  "SELECT o_orderkey, max(o_totalprice) OVER w AS best, min(o_totalprice) OVER w AS worst FROM orders WINDOW w AS (PARTITION BY o_custkey)")

q("w10_running_share", lambda t: W.running_share(t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")), ["day"], "n"),
  """
SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS running_total, sum(n) OVER (ORDER BY day) / sum(n) OVER () AS running_share FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)""", "running_share")


def _stage_ratio(t):
    from cohortspark.operators.cohorts import stage_ratio

    stage = X.classify([(F.col("event_type") == "view", 1), (F.col("event_type") == "click", 2), (F.col("event_type") == "purchase", 3)], None)
    return stage_ratio(t("events").withColumn("stage_no", stage).filter("stage_no is not null").withColumn("day", F.to_date("ts")).withColumn("n", F.lit(1)), ["day"], "stage_no", "n")


q("w11_stage_ratio", _stage_ratio, """
SELECT day, stage_no, n, n / lag(n) OVER (PARTITION BY day ORDER BY stage_no) AS step_rate FROM (
  SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS stage_no, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)""", "step_rate")

q("w12_streaks", lambda t: W.streaks(t("events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day_no")), ["user_id"], "day_no"),
  """
SELECT user_id, min(day_no) AS start_period, max(day_no) AS end_period, count(*) AS length FROM (
  SELECT user_id, day_no, day_no - row_number() OVER (PARTITION BY user_id ORDER BY day_no) AS g FROM (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_no FROM events)) GROUP BY user_id, g""")

q("w13_random_decile", lambda t: W.random_decile(t("customer").select("c_custkey"), "c_custkey", 7),
  "SELECT c_custkey, CAST(ntile(10) OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|7'), c_custkey) AS INTEGER) AS decile FROM customer")

# ---------------------------------------------------------------- sort, top-k, set operations


def _positions(t):
    ranked = OrderedScan(t("customer"), ["c_mktsegment"], ["-c_acctbal", "c_custkey"]).add(pos=row_number()).result()
    ranked.createOrReplaceTempView("ranked_customers")
    return t.spark.sql("SELECT c_mktsegment, pos, c_custkey FROM ranked_customers ORDER BY ALL")


q("k01_order_by", _positions, "SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS pos, c_custkey FROM customer ORDER BY ALL")

q("k02_label_order", lambda t: W.order_by_labels(t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "o_orderstatus", ["P", "O", "F"]),
  "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")

q("k03_top_n", lambda t: W.top_n(t("orders").select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], 25), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")

q("k04_top_n_per", lambda t: W.top_n_per(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"], 2),
  "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")

q("k05_limit_dimension", lambda t: W.limit_dimension(t("lineitem"), "l_suppkey", 30).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")),
  "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 30")

q("u01_union_all", lambda t: A.union_sources([
    t("customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), "c_mktsegment"), t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")),
    t("part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), "p_type")]),
  """
SELECT c_custkey AS id, 'customer' AS kind, c_mktsegment, NULL AS p_type FROM customer UNION ALL SELECT s_suppkey, 'supplier', NULL, NULL FROM supplier UNION ALL SELECT p_partkey, 'part', NULL, p_type FROM part""")

q("u02_union_distinct", lambda t: A.union_distinct([t("orders").select(F.col("o_custkey").alias("id")), t("events").select(F.col("user_id").alias("id"))]), "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")

# ---------------------------------------------------------------- data quality

q("q01_duplicates", lambda t: Q.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")

q("q02_summary_report", lambda t: Q.summary_report(t("documents").join(t("labels"), "doc_id", "left"), {"rows": "rows", "langs": ("distinct", "lang"), "labelled": ("non_null", "quality"), "mean_chars": F.avg("n_chars")}),
  """
WITH b AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM b UNION ALL SELECT 'langs', count(DISTINCT lang) FROM b UNION ALL SELECT 'labelled', count(quality) FROM b UNION ALL SELECT 'mean_chars', avg(n_chars) FROM b""", "value")

q("q03_missing_profile", lambda t: Q.missing_profile(t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")),
  """
WITH b AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), c AS (
SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS n_missing, count(*) AS n FROM b UNION ALL SELECT 'lang', count(*) - count(lang), count(*) FROM b UNION ALL SELECT 'quality', count(*) - count(quality), count(*) FROM b
UNION ALL SELECT 'toxic', count(*) - count(toxic), count(*) FROM b) SELECT "column", n_missing, n_missing / n AS missing_share FROM c""", "missing_share")

q("q04_feature_types", lambda t: Q.infer_feature_types(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("odd", F.col("c_custkey") % 2).select("c_acctbal", "c_mktsegment", "n_regionkey", "odd")).select("column", "kind"),
  "SELECT * FROM (VALUES ('c_acctbal', 'continuous'), ('c_mktsegment', 'categorical'), ('n_regionkey', 'categorical'), ('odd', 'binary')) v(\"column\", kind)")

q("q05_filter_report", lambda t: Q.filter_report(t("orders"), {"priced": F.col("o_totalprice") > 50000, "open": F.col("o_orderstatus") != "F", "recent": F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")}),
  """
WITH f AS (SELECT o_totalprice > 50000 AS a, o_orderstatus <> 'F' AS b, o_orderdate >= TIMESTAMP '1998-01-01' AS c FROM orders)
SELECT 'input' AS step, count(*) AS n FROM f UNION ALL SELECT 'removed_priced', count(*) FROM f WHERE NOT a UNION ALL SELECT 'removed_open', count(*) FROM f WHERE a AND NOT b
UNION ALL SELECT 'removed_recent', count(*) FROM f WHERE a AND b AND NOT c UNION ALL SELECT 'kept', count(*) FROM f WHERE a AND b AND c""")

q("q05_apply_filters", lambda t: Q.apply_filters(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"priced": F.col("o_totalprice") > 50000, "open": F.col("o_orderstatus") != "F"}),
  "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 50000 AND o_orderstatus <> 'F'")

q("q06_target_summary", lambda t: Q.target_summary(t("labels").withColumn("arm", arm_of("doc_id")), "arm", ["quality", "toxic"]),
  """
WITH l AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm FROM labels)
SELECT arm, count(*) AS n, 'quality' AS target, CAST(sum(quality) AS DOUBLE) AS total, avg(quality) AS mean, stddev_samp(quality) AS sd FROM l GROUP BY 1
UNION ALL SELECT arm, count(*), 'toxic', sum(toxic), avg(toxic), stddev_samp(toxic) FROM l GROUP BY 1""", "total mean sd")


def _prob1(t):
    from pyspark.ml.functions import array_to_vector

    return t("events").select("event_id", X.prob1(array_to_vector(F.array(1 - F.col("value") / 1000, F.col("value") / 1000))).alias("p"))


q("q07_prob1", _prob1, "SELECT event_id, value / 1000 AS p FROM events", "p")
