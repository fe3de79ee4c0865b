"""Queries for events, sessions, cohorts and profiles."""

from pyspark.sql import functions as F

from cohortspark.functions import exprs as X
from cohortspark.operators import cohorts as C, distincts as D, profiles as P, sessions as S, windows as W
from cohortspark.operators.aggs import share_of_total
from cohortspark.plans.common import EXPOSURE_SQL, SKEY, UNITS_SQL, arm_of, first_events, sess, sess_sql, unit_orders
from cohortspark.plans.flagship import purchase_lift
from cohortspark.plans.registry import q
from cohortspark.sources import io

KINDS = ["view", "click", "signup", "purchase", "error"]
is_type = lambda k: F.col("event_type") == k

q("e01_sessionize", lambda t: sess(t, 30).select("event_id", "event_date", "session_num"), f"WITH {sess_sql(30)} SELECT event_id, event_date, session_num FROM s")
q("e01_sessionize_12h", lambda t: sess(t, 720).select("event_id", "session_num", "session_start"),
  f"WITH {sess_sql(720)} SELECT event_id, session_num, min(ts) OVER (PARTITION BY user_id, event_date, session_num) AS session_start FROM s")
q("e01_sessionize_across_days", lambda t: sess(t, 720, per_day=False).select("event_id", "session_num"), """
SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS session_num FROM (
  SELECT *, CASE WHEN p IS NULL OR date_diff('minute', p, ts) >= 720 THEN 1 ELSE 0 END AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))""")

q("e02_union_events", lambda t: S.union_events(
    [t("events").select(F.col("user_id").alias("unit"), "ts", F.col("event_type").alias("event")),
     t("orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderdate").alias("ts"), F.lit("order").alias("event"), F.col("o_totalprice").alias("amount"))],
    [(F.col("event").isin("purchase", "order"), "funnel"), (F.col("event") == "view", "impression"), (F.col("event") == "click", "attribution")]).groupBy("event_class").agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("n_amount")),
  """
SELECT event_class, count(*) AS n, count(amount) AS n_amount FROM (
  SELECT CASE event_type WHEN 'purchase' THEN 'funnel' WHEN 'view' THEN 'impression' WHEN 'click' THEN 'attribution' ELSE 'action' END AS event_class, NULL AS amount FROM events
  UNION ALL SELECT 'funnel', o_totalprice FROM orders) GROUP BY 1""")

q("e03_dedup_events", lambda t: S.dedup_events(t("events").withColumn("day", F.to_date("ts")), ["user_id", "day", "event_type"], "ts", "event_id").select("event_id"),
  "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) = 1")


def _touches(t):
    ev = t("events").withColumn("surface", F.when(~is_type("purchase"), F.concat("event_type", F.lit("-"), (F.col("event_id") % 5).cast("string")))).withColumn("day", F.to_date("ts"))
    return S.last_touch(ev, ["user_id", "day"], "ts", "event_id", is_type("purchase"), [("click", is_type("click")), ("view", is_type("view"))], "surface")


q("e04_last_touch", lambda t: _touches(t).filter(is_type("purchase")).select("event_id", "attributed"), """
WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CASE WHEN event_type <> 'purchase' THEN event_type || '-' || (event_id % 5) END AS surface FROM events),
a AS (SELECT *, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN surface END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN event_type IN ('view', 'purchase') THEN surface END IGNORE NULLS) OVER w AS v
      FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, coalesce(surface, c, v, 'Unknown') AS attributed FROM a WHERE event_type = 'purchase'""")

q("e05_fill_null_key", lambda t: W.fill_by_rank(t("events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), F.when(~is_type("error"), F.col("event_id") % 50).alias("store_id"), (F.col("event_id") % 6).alias("event_rank")),
    ["user_id", "day"], ["ts", "event_id"], "store_id", "event_rank", "store_final").select("event_id", "store_final"), """
WITH e AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day, CASE WHEN event_type <> 'error' THEN event_id % 50 END AS store_id, event_id % 6 AS r FROM events),
k AS (SELECT *, CASE WHEN store_id IS NOT NULL THEN r END AS kr FROM e),
f AS (SELECT *, last_value(store_id IGNORE NULLS) OVER p AS ps, last_value(kr IGNORE NULLS) OVER p AS pr, first_value(store_id IGNORE NULLS) OVER n AS ns, first_value(kr IGNORE NULLS) OVER n AS nr FROM k
  WINDOW p AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN store_id IS NOT NULL THEN store_id WHEN pr >= r THEN ps WHEN nr <= r THEN ns ELSE 0 END AS store_final FROM f""")

q("e06_flag_after_first", lambda t: S.flag_after_first(sess(t), SKEY, "ts", is_type("purchase"), "pre_purchase").select("event_id", "pre_purchase"),
  f"WITH {sess_sql()} SELECT event_id, CASE WHEN ts > min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id, event_date, session_num) THEN 0 ELSE 1 END AS pre_purchase FROM s")


def _rollup(t):
    return S.session_rollup(sess(t), SKEY, "ts", "event_type", "event_id", {k: is_type(k) for k in ("view", "click", "purchase")}, entity="event_type", value="value", prior=(["user_id"], "purchase"))


_ROLL = f"""{sess_sql()},
  r AS (SELECT user_id, event_date, session_num, count(*) AS n_events, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(event_type, (ts, event_id)) AS first_event, arg_max(event_type, (ts, event_id)) AS last_event,
         max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS has_view, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS has_click, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS has_purchase,
         count(DISTINCT event_type) AS n_entities, sum(value) AS total_value FROM s GROUP BY 1, 2, 3)"""

q("e07_session_rollup", _rollup, f"""
WITH {_ROLL} SELECT *, CAST(floor((epoch_us(end_ts) - epoch_us(start_ts)) / 1000000) AS BIGINT) AS duration_seconds,
  CASE WHEN has_purchase = 1 THEN 'purchase' WHEN has_click = 1 THEN 'click' WHEN has_view = 1 THEN 'view' ELSE 'none' END AS deepest_stage,
  CASE WHEN sum(has_purchase) OVER (PARTITION BY user_id ORDER BY start_ts, event_date, session_num ROWS UNBOUNDED PRECEDING) - has_purchase > 0 THEN 1 ELSE 0 END AS prior_purchase FROM r""", "total_value")

_RUNS = f"""{sess_sql()},
  c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS chg FROM s WINDOW w AS (PARTITION BY user_id, event_date, session_num ORDER BY ts, event_id)),
  g AS (SELECT *, CAST(sum(chg) OVER (PARTITION BY user_id, event_date, session_num ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM c)"""

q("e08_first_action", lambda t: S.first_action(sess(t), SKEY, ["ts", "event_id"], "event_type", lambda a, b: [
    ((a == "view") & (b == "click"), "browse and click"), (a == "purchase", "direct purchase"), (a.isin("view", "click") & b.isNull(), "single look")], "other"), f"""
WITH {_RUNS}, p AS (SELECT user_id, event_date, session_num, max(CASE WHEN run_id = 1 THEN event_type END) AS first_event, max(CASE WHEN run_id = 2 THEN event_type END) AS next_event FROM g GROUP BY 1, 2, 3)
SELECT *, CASE WHEN first_event = 'view' AND next_event = 'click' THEN 'browse and click' WHEN first_event = 'purchase' THEN 'direct purchase' WHEN first_event IN ('view', 'click') AND next_event IS NULL THEN 'single look' ELSE 'other' END AS first_action FROM p""")

_KC = ", ".join(f"count(CASE WHEN event_type = '{k}' THEN 1 END) AS n_{k}, min(CASE WHEN event_type = '{k}' THEN sec END) AS s_to_first_{k}, avg(CASE WHEN event_type = '{k}' THEN 1.0 ELSE 0 END) AS share_{k}" for k in KINDS)
q("e09_session_features", lambda t: S.session_features(sess(t), SKEY, "ts", "event_type", KINDS, (30, 120)), f"""
WITH {sess_sql()}, x AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id, event_date, session_num))) / 1000000.0 AS sec FROM s)
SELECT user_id, event_date, session_num, count(*) AS n_events, max(sec) AS duration_s, {_KC}, count(CASE WHEN sec <= 30 THEN 1 END) AS n_first_30s, count(CASE WHEN sec <= 120 THEN 1 END) AS n_first_120s,
  CASE WHEN max(sec) > 0 THEN count(*) / (max(sec) / 60.0) END AS events_per_minute FROM x GROUP BY 1, 2, 3""", "duration_s events_per_minute " + " ".join(f"s_to_first_{k} share_{k}" for k in KINDS))

q("e10_inter_event_stats", lambda t: S.inter_event_stats(t("events"), ["user_id"], "ts", "event_id"), """
SELECT user_id, count(*) AS n_gaps, avg(g) AS mean_gap, min(g) AS min_gap, max(g) AS max_gap, stddev_pop(g) AS sd_gap, quantile_cont(g, 0.5) AS median_gap FROM (
  SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS g FROM events) WHERE g IS NOT NULL GROUP BY 1""", "mean_gap min_gap max_gap sd_gap median_gap", 3)

q("e11_event_bigrams", lambda t: S.event_bigrams(sess(t), SKEY, ["ts", "event_id"], "event_type"),
  f"WITH {sess_sql()} SELECT event_type || '>' || nx AS bigram, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id, event_date, session_num ORDER BY ts, event_id) AS nx FROM s) WHERE nx IS NOT NULL GROUP BY 1")
q("e11_bigram_features", lambda t: S.bigram_features(sess(t), SKEY, ["ts", "event_id"], "event_type", [("view", "click"), ("click", "purchase")]), f"""
WITH {sess_sql()} SELECT user_id, event_date, session_num, count(CASE WHEN event_type = 'view' AND nx = 'click' THEN 1 END) AS view_click, count(CASE WHEN event_type = 'click' AND nx = 'purchase' THEN 1 END) AS click_purchase
FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id, event_date, session_num ORDER BY ts, event_id) AS nx FROM s) GROUP BY 1, 2, 3""")

q("e12_first_position", lambda t: S.first_position(sess(t), SKEY, ["ts", "event_id"], {"click": is_type("click"), "big": F.col("value") > 50}), f"""
WITH {sess_sql()} SELECT user_id, event_date, session_num, min(CASE WHEN event_type = 'click' THEN rn END) AS pos_click, min(CASE WHEN value > 50 THEN rn END) AS pos_big
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_date, session_num ORDER BY ts, event_id) AS rn FROM s) GROUP BY 1, 2, 3""")


def _sessions(t):
    """One row per session with a single-column id and the unit's first day."""
    roll = sess(t).groupBy(*SKEY).agg(F.min("ts").alias("start_ts"), F.max(F.when(is_type("purchase"), 1).otherwise(0)).alias("bought"))
    roll = roll.withColumn("session_id", F.concat_ws("-", "user_id", F.date_format("event_date", "yyyyMMdd"), "session_num"))
    return roll.join(first_events(t).select("user_id", "t0"), "user_id")


_SESSIONS = f"""{sess_sql()}, {EXPOSURE_SQL.strip()},
  ss AS (SELECT s.user_id, event_date, session_num, min(ts) AS start_ts, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought,
           s.user_id || '-' || strftime(event_date, '%Y%m%d') || '-' || session_num AS session_id, min(t0) AS t0 FROM s JOIN x ON x.user_id = s.user_id GROUP BY 1, 2, 3)"""
_BUCKETS = ((0, 6), (7, 13), (14, 20), (21, 27))
q("e13_nth_sessions", lambda t: C.nth_sessions(_sessions(t), "user_id", "start_ts", "session_id", "t0"), f"""
WITH {_SESSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, session_id) AS k, date_diff('day', CAST(t0 AS DATE), CAST(start_ts AS DATE)) AS d FROM ss)
SELECT user_id, {", ".join(f"max(CASE WHEN k = {i} THEN session_id END) AS session_{i}" for i in (1, 2, 3))},
  {", ".join(f"arg_max(session_id, (start_ts, session_id)) FILTER (d BETWEEN {a} AND {b}) AS last_d{a}_{b}" for a, b in _BUCKETS)} FROM n GROUP BY 1""")

q("e14_bucket_counts", lambda t: C.bucket_counts(_sessions(t).withColumn("day", F.datediff(F.to_date("start_ts"), F.to_date("t0"))), "user_id", "session_id", "day"), f"""
WITH {_SESSIONS}, n AS (SELECT *, date_diff('day', CAST(t0 AS DATE), CAST(start_ts AS DATE)) AS d FROM ss)
SELECT user_id, {", ".join(f"count(DISTINCT CASE WHEN d BETWEEN {a} AND {b} THEN session_id END) AS sessions_d{a}_{b}" for a, b in _BUCKETS)} FROM n GROUP BY 1""")


def _unstack(t):
    wide = C.nth_sessions(_sessions(t), "user_id", "start_ts", "session_id", "t0", buckets=())
    ev = sess(t).select("user_id", "event_id", F.concat_ws("-", "user_id", F.date_format("event_date", "yyyyMMdd"), "session_num").alias("session_id"))
    return C.unstack_sessions(wide, "user_id", ["session_1", "session_2", "session_3"], ev, "session_id").select("user_id", "session_label", "event_id")


q("e15_unstack_sessions", _unstack, f"""
WITH {_SESSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, session_id) AS k FROM ss)
SELECT s.user_id, 'session_' || k AS session_label, s.event_id FROM s JOIN n ON n.user_id = s.user_id AND n.event_date = s.event_date AND n.session_num = s.session_num WHERE k <= 3""")



def _stages():
    return {"visit": F.lit(True), "view": is_type("view"), "click": is_type("click"), "buy": is_type("purchase")}


q("e16_funnel", lambda t: C.funnel(t("events").withColumn("day", F.to_date("ts")), _stages(), "user_id", ["day"]), """
WITH c AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS a1, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS a2, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS a3,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS a4 FROM events GROUP BY 1)
SELECT day, 1 AS stage_no, 'visit' AS stage, a1 AS entities, a1 / nullif(a1, 0) AS step_rate, a1 / nullif(a1, 0) AS overall_rate FROM c
UNION ALL SELECT day, 2, 'view', a2, a2 / nullif(a1, 0), a2 / nullif(a1, 0) FROM c UNION ALL SELECT day, 3, 'click', a3, a3 / nullif(a2, 0), a3 / nullif(a1, 0) FROM c
UNION ALL SELECT day, 4, 'buy', a4, a4 / nullif(a3, 0), a4 / nullif(a1, 0) FROM c""", "step_rate overall_rate")

_WF = ", ".join(f"max(CASE WHEN e.event_type = '{k}' AND e.ts > t0 AND e.ts <= t0 + INTERVAL {d} DAY THEN 1 ELSE 0 END) AS {k}_d{d}" for k in ("click", "purchase") for d in (1, 7, 14, 28))
q("e17_window_flags", lambda t: C.window_flags(first_events(t).select("user_id", "t0"), t("events"), "user_id", "t0", "ts", [1, 7, 14, 28], {"click": is_type("click"), "purchase": is_type("purchase")}),
  f"WITH {EXPOSURE_SQL} SELECT x.user_id, t0, {_WF} FROM x JOIN events e ON e.user_id = x.user_id GROUP BY 1, 2")

q("e18_horizon_flags", lambda t: C.horizon_flags(first_events(t).join(t("events").filter(is_type("purchase")).groupBy("user_id").agg(F.min("ts").alias("first_buy")), "user_id", "left"), "first_buy", "t0", {"1h": 1, "24h": 24, "7d": 168, "30d": 720})
  .select("user_id", "had_1h", "had_24h", "had_7d", "had_30d"), f"""
WITH {EXPOSURE_SQL} SELECT x.user_id, {", ".join(f"CASE WHEN fb BETWEEN t0 AND t0 + INTERVAL {h} HOUR THEN 1 ELSE 0 END AS had_{n}" for n, h in (("1h", 1), ("24h", 24), ("7d", 168), ("30d", 720)))}
FROM x LEFT JOIN (SELECT user_id, min(ts) AS fb FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON b.user_id = x.user_id""")

q("e19_cohorts", lambda t: C.stack_cohorts([C.define_cohort(t("events"), "user_id", "ts", "event_id", is_type("signup"), "signup"), C.define_cohort(t("events"), "user_id", "ts", "event_id", F.col("value") > 90, "big spender")]),
  "SELECT user_id, min(ts) AS cohort_ts, 'signup' AS cohort FROM events WHERE event_type = 'signup' GROUP BY 1 UNION ALL SELECT user_id, min(ts), 'big spender' FROM events WHERE value > 90 GROUP BY 1")

q("e20_retention", lambda t: C.retention(first_events(t), t("events"), "user_id", "t0", "ts", 14, ["arm"]), f"""
WITH {EXPOSURE_SQL}, a AS (SELECT DISTINCT arm, x.user_id, date_diff('day', CAST(t0 AS DATE), CAST(e.ts AS DATE)) AS day FROM x JOIN events e ON e.user_id = x.user_id WHERE e.ts >= t0 AND e.ts <= t0 + INTERVAL 15 DAY),
z AS (SELECT arm, count(*) AS cohort_size FROM x GROUP BY 1), g AS (SELECT arm, cohort_size, unnest(generate_series(0, 14)) AS day FROM z),
r AS (SELECT g.arm, CAST(g.day AS INTEGER) AS day, cohort_size, count(a.user_id) AS active FROM g LEFT JOIN a ON a.arm = g.arm AND a.day = g.day GROUP BY 1, 2, 3)
SELECT *, active / cohort_size AS rate, lag(active / cohort_size) OVER (PARTITION BY arm ORDER BY day) - active / cohort_size AS drop_off FROM r""", "rate drop_off")

q("e21_period_flags", lambda t: C.period_flags(t("orders").withColumn("m", X.boundary_diff("MONTH", F.lit("1998-01-01").cast("date"), "o_orderdate")), "o_custkey", "m", range(0, 4)),
  f"""SELECT o_custkey, {", ".join(f"max(CASE WHEN date_diff('month', DATE '1998-01-01', o_orderdate) = {k} THEN 1 ELSE 0 END) AS m{k}" for k in range(4))} FROM orders GROUP BY 1""")

q("e22_rolling_active", lambda t: C.rolling_active(t("customer").select(F.col("c_custkey").alias("u"), arm_of("c_custkey").alias("arm")), t("orders").select(F.col("o_custkey").alias("u"), "o_orderdate"), "u", ["arm"], "o_orderdate", "1998-01-01", "1998-03-01"), """
WITH d AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-03-01', INTERVAL 1 DAY)) AS DATE) AS analysis_date),
m AS (SELECT analysis_date, CASE WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm, c_custkey,
        max(CASE WHEN o_orderkey IS NOT NULL THEN 1 ELSE 0 END) AS a FROM d CROSS JOIN customer
      LEFT JOIN orders ON o_custkey = c_custkey AND CAST(o_orderdate AS DATE) BETWEEN analysis_date - 28 AND analysis_date - 1 GROUP BY 1, 2, 3)
SELECT analysis_date, arm, count(*) AS total, CAST(sum(a) AS BIGINT) AS active, sum(a) / count(*) AS active_rate FROM m GROUP BY 1, 2""", "active_rate")

_WEEKS = [("1999-01-04", "1999-01-10"), ("1999-01-11", "1999-01-17"), ("1999-01-18", "1999-01-24"), ("1999-02-01", "1999-02-28")]
q("e23_lapsed_cohort", lambda t: C.lapsed_cohort(t("customer").select(F.col("c_custkey").alias("u"), F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") * 2 % 1600).cast("int")).alias("born")),
    t("orders").select(F.col("o_custkey").alias("u"), "o_orderdate"), "u", "born", "o_orderdate", _WEEKS), f"""
WITH w(period_start, period_end) AS (VALUES {", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in _WEEKS)}),
l AS (SELECT period_start, period_end, c_custkey FROM w CROSS JOIN customer c WHERE DATE '1994-01-01' + CAST(c_custkey * 2 % 1600 AS INTEGER) + 365 <= period_start
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) BETWEEN period_start - 365 AND period_start - 1)),
o AS (SELECT l.*, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) BETWEEN period_start AND period_end) AS n FROM l)
SELECT period_start, period_end, count(*) AS lapsed, count(CASE WHEN n > 0 THEN 1 END) AS reconverted, CAST(sum(n) AS BIGINT) AS orders, count(CASE WHEN n > 0 THEN 1 END) / count(*) AS conversion_rate FROM o GROUP BY 1, 2""", "conversion_rate")

q("e24_lifecycle", lambda t: t("customer").select("c_custkey").join(t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("f"), F.max("o_orderdate").alias("l")), F.col("c_custkey") == F.col("o_custkey"), "left")
  .select("c_custkey", P.lifecycle("f", "l", F.lit("2001-08-01").cast("date"), F.when(F.col("c_custkey") % 2 == 0, 1)).alias("state")), """
SELECT c_custkey, CASE WHEN f IS NULL AND c_custkey % 2 <> 0 THEN 'Unrecognized' WHEN f IS NULL THEN 'New' WHEN date_diff('day', f, DATE '2001-08-01') BETWEEN 1 AND 28 THEN 'P0' WHEN date_diff('day', l, DATE '2001-08-01') BETWEEN 29 AND 89 THEN 'Dormant'
  WHEN date_diff('day', l, DATE '2001-08-01') >= 90 THEN 'Churned' WHEN date_diff('day', l, DATE '2001-08-01') <= 28 THEN 'Active' END AS state
FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS f, CAST(max(o_orderdate) AS DATE) AS l FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")

_BANDS = ((0, 7), (8, 14), (15, 30), (31, 60), (61, 90), (91, 180))
q("e25_order_features", lambda t: P.order_features(t("orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "2000-01-01"), f"""
WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2000-01-01'),
g AS (SELECT *, date_diff('day', p, d) AS gap, date_diff('day', d, DATE '2000-01-01') AS ago FROM f),
w AS (SELECT o_custkey, wk - row_number() OVER (PARTITION BY o_custkey ORDER BY wk) AS isl FROM (SELECT DISTINCT o_custkey, date_diff('day', DATE '1990-01-01', CAST(date_trunc('week', d) AS DATE)) / 7 AS wk FROM g)),
k AS (SELECT o_custkey, max(n) AS longest_streak, count(*) AS n_streaks, CAST(sum(n) AS BIGINT) AS active_weeks FROM (SELECT o_custkey, isl, count(*) AS n FROM w GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT o_custkey, count(*) AS n_orders, count(DISTINCT d) AS order_days, sum(o_totalprice) AS spend, date_diff('day', min(d), DATE '2000-01-01') AS period_days, min(ago) AS recency_days, avg(gap) AS mean_gap, min(gap) AS min_gap, max(gap) AS max_gap, stddev_samp(gap) AS sd_gap,
  {", ".join(f"count(CASE WHEN ago BETWEEN {x} AND {y} THEN 1 END) AS orders_{x}_{y}d" for x, y in _BANDS)}, count(CASE WHEN ago > 180 THEN 1 END) AS orders_over_180d, count(CASE WHEN ago <= 90 THEN 1 END) AS orders_late, count(CASE WHEN ago > 90 THEN 1 END) AS orders_early,
  count(DISTINCT o_orderpriority) AS n_merchants, quantile_cont(gap, 0.5) AS median_gap FROM g GROUP BY 1)
SELECT a.*, longest_streak, n_streaks, active_weeks, n_orders / nullif(period_days / 7.0, 0) AS orders_per_week,
  CASE WHEN n_orders / nullif(period_days / 7.0, 0) >= 2 THEN 'high' WHEN n_orders / nullif(period_days / 7.0, 0) >= 1 THEN 'medium' WHEN n_orders / nullif(period_days / 30.0, 0) >= 1 THEN 'low' ELSE 'very low' END AS frequency,
  CASE WHEN sd_gap <= 7 THEN 'weekly' WHEN sd_gap <= 14 THEN 'biweekly' WHEN sd_gap <= 21 THEN 'somewhat' ELSE 'sporadic' END AS regularity,
  CASE WHEN orders_late > orders_early THEN 'increasing' WHEN orders_late < orders_early THEN 'declining' ELSE 'stable' END AS trend FROM a JOIN k USING (o_custkey)""", "spend mean_gap sd_gap median_gap orders_per_week", 3)


def _items(t):
    """Order lines with customer, merchant, category and order time."""
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    od = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = t("part").select("p_partkey", "p_type")
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(pt, F.col("l_partkey") == F.col("p_partkey"))


_ITEMS = "i AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_extendedprice, o_custkey, o_orderdate, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
_SHARES = f"""{_ITEMS}, m AS (SELECT o_custkey, l_suppkey, count(*) AS orders, sum(l_extendedprice) AS spend FROM i GROUP BY 1, 2),
  ms AS (SELECT *, orders * 100.0 / sum(orders) OVER (PARTITION BY o_custkey) AS order_share, spend * 100.0 / nullif(sum(spend) OVER (PARTITION BY o_custkey), 0) AS spend_share FROM m),
  mf AS (SELECT *, CASE WHEN orders >= 3 AND order_share >= 40 THEN 'frequent and large' WHEN orders >= 3 THEN 'frequent' WHEN order_share >= 40 THEN 'large share' ELSE 'other' END AS favorite FROM ms)"""
q("e26_merchant_shares", lambda t: P.merchant_shares(_items(t), "o_custkey", "l_suppkey", "l_extendedprice"), f"WITH {_SHARES} SELECT * FROM mf", "spend order_share spend_share", 3)
q("e26_affinity", lambda t: P.affinity(_items(t), "o_custkey", "l_suppkey", "p_type", "l_extendedprice"), f"""
WITH {_SHARES}, a AS (SELECT o_custkey, CAST(sum(orders) AS BIGINT) AS n_orders, count(*) AS n_merchants, sum(spend) AS spend, count(CASE WHEN favorite <> 'other' THEN 1 END) AS n_favorites, arg_min(l_suppkey, (-orders, -spend, l_suppkey)) AS top_merchant,
  max(order_share) AS top_share, avg(order_share) AS mean_share FROM mf GROUP BY 1)
SELECT a.*, n_categories, CASE WHEN n_merchants >= 10 THEN 'high' WHEN n_merchants >= 5 THEN 'medium' WHEN n_merchants >= 2 THEN 'low' ELSE 'single' END AS diversity,
  CASE WHEN top_share >= 60 THEN 'loyalist' WHEN n_merchants >= 10 THEN 'explorer' WHEN n_categories = 1 THEN 'category focused' WHEN n_merchants <= 3 THEN 'few favorites' ELSE 'balanced' END AS ordering_type
FROM a JOIN (SELECT o_custkey, count(DISTINCT p_type) AS n_categories FROM i GROUP BY 1) USING (o_custkey)""", "spend top_share mean_share", 3)

q("e27_favorites", lambda t: P.favorites(_items(t).withColumn("dow", X.day_of_week("o_orderdate")).withColumn("meal", F.col("l_orderkey") % 4), "o_custkey", "p_type", "l_suppkey", "dow", "meal")
  .select("o_custkey", F.array_join("top_categories", "|").alias("top_categories"), F.array_join(F.transform("top_merchants", lambda x: x.cast("string")), "|").alias("top_merchants"), "usual_dow", "usual_meal"), f"""
WITH {_ITEMS}, c AS (SELECT o_custkey, p_type, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, p_type) AS rn FROM i GROUP BY 1, 2),
m AS (SELECT o_custkey, l_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, l_suppkey) AS rn FROM i GROUP BY 1, 2),
d AS (SELECT o_custkey, dayofweek(o_orderdate) AS usual_dow, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, dayofweek(o_orderdate)) AS rn FROM i GROUP BY 1, 2),
e AS (SELECT o_custkey, l_orderkey % 4 AS usual_meal, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, l_orderkey % 4) AS rn FROM i GROUP BY 1, 2)
SELECT cc.o_custkey, top_categories, top_merchants, usual_dow, usual_meal FROM (SELECT o_custkey, string_agg(p_type, '|' ORDER BY rn) AS top_categories FROM c WHERE rn <= 3 GROUP BY 1) cc
JOIN (SELECT o_custkey, string_agg(CAST(l_suppkey AS VARCHAR), '|' ORDER BY rn) AS top_merchants FROM m WHERE rn <= 10 GROUP BY 1) mm USING (o_custkey) JOIN d USING (o_custkey) JOIN e USING (o_custkey) WHERE d.rn = 1 AND e.rn = 1""")

q("e28_lookback_features", lambda t: P.lookback_features(
    t("events").filter(is_type("purchase")).select("user_id", F.to_date("ts").alias("snap")).distinct(), t("events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value"), "user_id", "snap", "day", [7, 14],
    {"events": ("count", None, None), "clicks": ("count", None, is_type("click")), "value": ("sum", "value", None)}), """
WITH n AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS snap FROM events WHERE event_type = 'purchase'),
f AS (SELECT n.user_id, snap, event_type, value, date_diff('day', CAST(ts AS DATE), snap) AS ago FROM n JOIN events e ON e.user_id = n.user_id AND CAST(ts AS DATE) BETWEEN snap - 14 AND snap - 1),
a AS (SELECT user_id, snap, count(CASE WHEN ago <= 7 THEN 1 END) AS events_7d, count(CASE WHEN ago <= 7 AND event_type = 'click' THEN 1 END) AS clicks_7d, sum(CASE WHEN ago <= 7 THEN value END) AS value_7d,
  count(*) AS events_14d, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks_14d, sum(value) AS value_14d FROM f GROUP BY 1, 2)
SELECT * FROM n LEFT JOIN a USING (user_id, snap)""", "value_7d value_14d")

q("e29_stage_recency", lambda t: P.stage_recency(t("events").groupBy("user_id").agg(F.max("ts").alias("t0")), t("events"), "user_id", "t0", "ts", {"view": is_type("view"), "purchase": is_type("purchase")}), """
WITH x AS (SELECT user_id, max(ts) AS t0 FROM events GROUP BY 1)
SELECT x.user_id, x.t0, date_diff('day', CAST(max(CASE WHEN event_type = 'view' THEN ts END) AS DATE), CAST(t0 AS DATE)) AS days_since_view, count(CASE WHEN event_type = 'view' THEN 1 END) AS n_view,
  date_diff('day', CAST(max(CASE WHEN event_type = 'purchase' THEN ts END) AS DATE), CAST(t0 AS DATE)) AS days_since_purchase, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS n_purchase
FROM x LEFT JOIN events e ON e.user_id = x.user_id AND e.ts < t0 GROUP BY 1, 2""")
q("e29_stage_recency_exposures", lambda t: P.stage_recency(t("orders").join(t("events").select(F.col("user_id").alias("o_custkey")).distinct(), "o_custkey").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 20).alias("k")).distinct().select("user_id", F.expr("TIMESTAMP_NTZ '2024-01-02' + make_dt_interval(CAST(k AS INT))").alias("t0")), t("events"), "user_id", "t0", "ts", {"view": is_type("view"), "purchase": is_type("purchase")}, whole_days=True), """
WITH x AS (SELECT DISTINCT o_custkey AS user_id, TIMESTAMP '2024-01-02' + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS t0 FROM orders WHERE o_custkey IN (SELECT user_id FROM events)),
e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type FROM events)
SELECT x.user_id, x.t0, date_diff('day', max(d) FILTER (event_type = 'view'), CAST(t0 AS DATE)) AS days_since_view, count(*) FILTER (event_type = 'view') AS n_view, count(DISTINCT d) FILTER (event_type = 'view') AS n_days_view,
  min(d) FILTER (event_type = 'view') AS first_day_view, max(d) FILTER (event_type = 'view') AS last_day_view, CAST(count(*) FILTER (event_type = 'view') > 0 AS INTEGER) AS has_view,
  date_diff('day', max(d) FILTER (event_type = 'purchase'), CAST(t0 AS DATE)) AS days_since_purchase, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(DISTINCT d) FILTER (event_type = 'purchase') AS n_days_purchase,
  min(d) FILTER (event_type = 'purchase') AS first_day_purchase, max(d) FILTER (event_type = 'purchase') AS last_day_purchase, CAST(count(*) FILTER (event_type = 'purchase') > 0 AS INTEGER) AS has_purchase
FROM x LEFT JOIN e ON e.user_id = x.user_id AND e.d < CAST(t0 AS DATE) GROUP BY 1, 2""")


def _one_unit(t):
    """All line items as exposures of a single unit, one a minute, and all events as its own."""
    x = t("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k")).distinct()
    x = x.select(F.lit(1).alias("u"), F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, CAST(k % 40000 AS INT))").alias("t0"))
    return x, t("events").select(F.lit(1).alias("u"), "ts", "event_type", "event_id", "value")


q("e29_stage_recency_one_unit", lambda t: P.stage_recency(_one_unit(t)[0], _one_unit(t)[1], "u", "t0", "ts", {"buy": is_type("purchase")}, hot_rows=20000), """
WITH x AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS k FROM lineitem), e AS (SELECT ts, sum(n) OVER (ORDER BY ts) AS n FROM (SELECT ts, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1))
SELECT CAST(1 AS INTEGER) AS u, t0, date_diff('day', CAST(ts AS DATE), CAST(t0 AS DATE)) AS days_since_buy, CAST(coalesce(n, 0) AS BIGINT) AS n_buy
FROM (SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(k % 40000 AS INTEGER)) AS t0 FROM x) ASOF LEFT JOIN e ON t0 > ts""")
q("e45_redemption_one_unit", lambda t: P.redemption(_one_unit(t)[0].withColumn("arm", F.pmod(F.minute("t0"), F.lit(2))), _one_unit(t)[1].withColumn("code", F.col("event_type")), t("events").filter(is_type("purchase")).select(F.col("event_type").alias("code")), "u", "t0", "ts", "event_id", "code", ["arm"], hot_rows=20000), """
WITH x AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS k FROM lineitem), e AS (SELECT ts, sum(n) OVER (ORDER BY ts) AS n FROM (SELECT ts, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)), a AS (SELECT count(*) AS n FROM events WHERE event_type = 'purchase'),
r AS (SELECT minute(t0) % 2 AS arm, (SELECT n FROM a) - coalesce(n, 0) AS later FROM (SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(k % 40000 AS INTEGER)) AS t0 FROM x) ASOF LEFT JOIN e ON t0 > ts)
SELECT CAST(arm AS INTEGER) AS arm, CAST(1 AS BIGINT) AS exposed, CAST(sum(later) > 0 AS BIGINT) AS redeemers, CAST(sum(later) AS BIGINT) AS redeemed_orders, CAST(sum(later) > 0 AS DOUBLE) AS redemption_rate FROM r GROUP BY 1""")


def _messages(t):
    return t("events").select("user_id", F.concat(F.lit("camp"), (F.col("event_id") % 4).cast("string")).alias("campaign"), (F.col("event_id") % 700).alias("message_id"), "ts")


q("e30_message_sequence", lambda t: P.message_sequence(_messages(t), "user_id", "campaign", "message_id", "ts"), """
WITH m AS (SELECT user_id, 'camp' || (event_id % 4) AS campaign, event_id % 700 AS message_id, min(ts) AS first_sent FROM events GROUP BY 1, 2, 3)
SELECT user_id, campaign, message_id, first_sent, dense_rank() OVER (PARTITION BY user_id, campaign ORDER BY first_sent) AS message_no,
  date_diff('minute', lag(first_sent) OVER (PARTITION BY user_id, campaign ORDER BY first_sent, message_id), first_sent) AS minutes_since_prev FROM m""")


def _sent(t):
    from cohortspark.operators.ordered import OrderedScan, bfill

    scan = OrderedScan(t("events"), ["user_id"], ["ts", "event_id"]).derive(_v=F.when(is_type("view"), F.col("ts")), _b=F.when(is_type("purchase"), F.col("ts")))
    return scan.add(visit=bfill("_v", strict=True), order=bfill("_b", strict=True)).result().filter(is_type("click")).withColumn("campaign", F.col("event_id") % 4)


q("e31_post_send_rates", lambda t: P.post_send_rates(_sent(t), ["campaign"], "ts", {"visit": "visit", "order": "order"}, [1, 4, 24]), f"""
WITH n AS (SELECT *, min(CASE WHEN event_type = 'view' THEN ts END) OVER w AS visit, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS "order" FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id % 4 AS campaign, count(*) AS n_sent, {", ".join(f'''avg(CASE WHEN "{k}" <= ts + INTERVAL {h} HOUR THEN 1.0 ELSE 0 END) AS {k}_{h}h''' for k in ("visit", "order") for h in (1, 4, 24))}
FROM n WHERE event_type = 'click' GROUP BY 1""", "visit_1h visit_4h visit_24h order_1h order_4h order_24h")

q("e32_tag_flags", lambda t: P.tag_flags(_items(t).select("o_custkey", "p_type"), "o_custkey", "p_type", {"cheap": ["%ECONOMY%", "%PROMO%"], "plain": ["standard%"]}),
  f"""WITH {_ITEMS} SELECT o_custkey, max(CASE WHEN p_type ILIKE '%ECONOMY%' OR p_type ILIKE '%PROMO%' THEN 1 ELSE 0 END) AS has_cheap, max(CASE WHEN p_type ILIKE 'standard%' THEN 1 ELSE 0 END) AS has_plain,
  max(CASE WHEN p_type ILIKE '%ECONOMY%' OR p_type ILIKE '%PROMO%' OR p_type ILIKE 'standard%' THEN 0 ELSE 1 END) AS has_other FROM i GROUP BY 1""")

q("e33_overlap", lambda t: P.array_overlap(P.overlap(t("part").withColumn("words", F.split("p_name", " ")), [("p_name", "ring"), ("p_name", "red"), ("p_type", "eco")]), "words", F.array(F.lit("ring"), F.lit("widget")), "word")
  .select("p_partkey", "overlap_count", "has_overlap", "word_count", "has_word"), """
SELECT p_partkey, CAST(contains(lower(p_name), 'ring') AS INTEGER) + CAST(contains(lower(p_name), 'red') AS INTEGER) + CAST(contains(lower(p_type), 'eco') AS INTEGER) AS overlap_count,
  CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red') OR contains(lower(p_type), 'eco') THEN 1 ELSE 0 END AS has_overlap,
  len(list_intersect(string_split(p_name, ' '), ['ring', 'widget'])) AS word_count, CAST(list_has_any(string_split(p_name, ' '), ['ring', 'widget']) AS INTEGER) AS has_word FROM part""")


def _deliveries(t):
    li = t("lineitem").join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select("l_suppkey", F.abs(F.datediff("l_shipdate", "o_orderdate")).alias("actual"), (F.col("l_quantity") * 10).alias("quote"))


_DELIV = "dl AS (SELECT l_suppkey, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS actual, l_quantity * 10 AS quote FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
q("e34_eta_accuracy", lambda t: P.eta_accuracy(_deliveries(t), ["l_suppkey"], "quote", "actual", (0, 5, 10, 20), 560),
  f"""WITH {_DELIV} SELECT l_suppkey, count(*) AS n, {", ".join(f"avg(CASE WHEN actual <= quote + {s} THEN 1.0 ELSE 0 END) AS within_{s}" for s in (0, 5, 10, 20))} FROM dl GROUP BY 1 HAVING count(*) >= 560""", "within_0 within_5 within_10 within_20")

q("e35_latest_in_bin", lambda t: P.latest_in_bin(t("events"), ["event_type"], "ts", "event_id", 3600).select("event_id", "bin_start"),
  "SELECT event_id, date_trunc('hour', ts) AS bin_start FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1")

q("e36_bins", lambda t: P.qcut(t("customer").select("c_custkey", "c_acctbal", X.bin_edges("c_acctbal", [0, 1000, 5000], ["debt", "low", "mid", "high"]).alias("band"), X.width_bin("c_acctbal", 50).alias("bin50")), "c_acctbal", 4, "quartile").drop("c_acctbal"), """
WITH e AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, CAST(floor(c_acctbal / 50) * 50 AS BIGINT) AS bin50,
  CASE WHEN c_acctbal <= a THEN 1 WHEN c_acctbal <= b THEN 2 WHEN c_acctbal <= c THEN 3 ELSE 4 END AS quartile FROM customer, e""")

q("e37_ratio_to_baseline", lambda t: P.ratio_to_baseline(t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "event_type", "day", "view", ["n", "total"]), """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT d.*, d.n / nullif(b.n, 0) AS n_ratio, d.total / nullif(b.total, 0) AS total_ratio FROM d LEFT JOIN (SELECT * FROM d WHERE event_type = 'view') b ON b.day = d.day""", "total n_ratio total_ratio")

q("e38_population_overlap", lambda t: C.population_overlap(t("events").filter(is_type("purchase")).select("user_id", F.to_date("ts").alias("day")), t("events").filter(is_type("error")).select("user_id", F.to_date("ts").alias("day")), "user_id", ["day"]), """
WITH a AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'error')
SELECT coalesce(a.day, b.day) AS day, count(a.user_id) AS n_a, count(b.user_id) AS n_b, count(CASE WHEN a.user_id IS NOT NULL AND b.user_id IS NOT NULL THEN 1 END) AS n_both,
  count(CASE WHEN a.user_id IS NOT NULL AND b.user_id IS NOT NULL THEN 1 END) / nullif(count(a.user_id), 0) AS share_of_a FROM a FULL JOIN b ON a.day = b.day AND a.user_id = b.user_id GROUP BY 1""", "share_of_a")

q("e39_size_impact", lambda t: P.size_impact(unit_orders(t).withColumn("one", F.lit(1)).withColumn("conv", (F.col("n_orders") > 10).cast("int")), "c_mktsegment", "one", "conv", {"BUILDING": 0.05, "MACHINERY": 0.1}), f"""
WITH {UNITS_SQL}, g AS (SELECT c_mktsegment, count(*) AS exposed, CAST(sum(CASE WHEN n_orders > 10 THEN 1 ELSE 0 END) AS BIGINT) AS converted, CASE c_mktsegment WHEN 'BUILDING' THEN 0.05 WHEN 'MACHINERY' THEN 0.1 ELSE 0 END AS lift FROM units GROUP BY c_mktsegment)
SELECT c_mktsegment, exposed, converted, exposed / sum(exposed) OVER () AS exposed_share, converted / exposed AS rate, lift, exposed * (converted / exposed) * lift AS extra_conversions FROM g""", "exposed_share rate lift extra_conversions")


def _milestones(t, which):
    table, spread = S.between_milestones(t("events"), ["user_id"], "ts", "event_type", is_type("signup"), is_type("purchase"), 20)
    return table if which == "table" else spread


_SPAN = """sp AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS a, min(CASE WHEN event_type = 'purchase' THEN ts END) AS b FROM events GROUP BY 1),
  sv AS (SELECT * FROM sp WHERE a < b)"""
q("e40_between_milestones", lambda t: _milestones(t, "table"), f"""
WITH {_SPAN}, i AS (SELECT e.* FROM events e JOIN sv ON sv.user_id = e.user_id WHERE e.ts > a AND e.ts < b)
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_keys, count(*) / (SELECT count(*) FROM i) AS event_share, count(DISTINCT user_id) / (SELECT count(*) FROM sv) AS key_share FROM i GROUP BY 1 ORDER BY n DESC, event_type LIMIT 20""", "event_share key_share")
q("e40_milestone_hours", lambda t: _milestones(t, "spread"), f"""
WITH {_SPAN}, h AS (SELECT (epoch_us(b) - epoch_us(a)) / 3600000000.0 AS h FROM sv), c AS (SELECT CASE WHEN h < 1 THEN '<1h' WHEN h < 6 THEN '<6h' WHEN h < 24 THEN '<24h' ELSE '>=24h' END AS bucket FROM h)
SELECT bucket, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM c GROUP BY 1""", "share")

q("e41_sessions_before_first", lambda t: C.sessions_before_first(_sessions(t), t("events").filter(is_type("purchase")).select("user_id", F.col("ts").alias("buy_ts")), "user_id", "start_ts", "buy_ts"), f"""
WITH {_SESSIONS}, f AS (SELECT user_id, min(ts) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT ss.user_id, count(CASE WHEN CAST(start_ts AS DATE) = CAST(b AS DATE) THEN 1 END) AS same_day_sessions, count(CASE WHEN CAST(start_ts AS DATE) <> CAST(b AS DATE) THEN 1 END) AS earlier_sessions
FROM ss JOIN f ON f.user_id = ss.user_id WHERE start_ts <= b GROUP BY 1""")

q("e42_entities_by_outcome", lambda t: S.entities_by_outcome(sess(t).withColumn("store", F.col("event_id") % 7), SKEY, "store", is_type("purchase"), is_type("view")), f"""
WITH {sess_sql()}, p AS (SELECT max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS converted, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id % 7 END) AS n FROM s GROUP BY user_id, event_date, session_num)
SELECT converted, count(*) AS n_sessions, avg(n) AS mean_entities, max(n) AS max_entities FROM p GROUP BY 1""", "mean_entities")
q("e42_funnel_anomalies", lambda t: S.funnel_anomalies(sess(t), SKEY, is_type("purchase"), is_type("view")),
  f"WITH {sess_sql()} SELECT user_id, event_date, session_num, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS n_outcome, count(CASE WHEN event_type = 'view' THEN 1 END) AS n_viewed FROM s GROUP BY 1, 2, 3 HAVING count(CASE WHEN event_type = 'purchase' THEN 1 END) > 0 AND count(CASE WHEN event_type = 'view' THEN 1 END) = 0")

q("e43_error_rates", lambda t: S.error_rates(sess(t), SKEY, is_type("error")), f"""
WITH {sess_sql()}, p AS (SELECT count(CASE WHEN event_type = 'error' THEN 1 END) AS e FROM s GROUP BY user_id, event_date, session_num)
SELECT count(*) AS n_sessions, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END) AS error_session_share, avg(e) AS mean_errors, quantile_cont(e, 0.5) AS median_errors FROM p""", "error_session_share mean_errors median_errors")
q("e43_error_breakdown", lambda t: S.error_breakdown(t("events").withColumn("surface", F.col("event_id") % 3).withColumn("detail", F.col("event_id") % 5), is_type("error"), ["surface", "detail"], ["surface"]),
  "SELECT event_id % 3 AS surface, event_id % 5 AS detail, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY event_id % 3) AS share FROM events WHERE event_type = 'error' GROUP BY 1, 2", "share")

q("e44_status_rates", lambda t: P.status_rates(unit_orders(t).select("arm", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "on").otherwise("off").alias("push"), F.when(F.col("c_acctbal") > 5000, "on").otherwise("off").alias("sms")), ["arm"], "c_custkey", ["push", "sms"]), f"""
WITH {UNITS_SQL} SELECT arm, count(*) AS n_units, avg(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0 END) AS push_rate, avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0 END) AS sms_rate, avg(CASE WHEN c_custkey % 3 = 0 OR c_acctbal > 5000 THEN 1.0 ELSE 0 END) AS any_rate FROM units GROUP BY 1""", "push_rate sms_rate any_rate")


def _redeem(t):
    o = t("orders").select(F.col("o_custkey").alias("u"), "o_orderdate", "o_orderkey", (F.col("o_orderkey") % 20).alias("code"))
    exposed = t("customer").select(F.col("c_custkey").alias("u"), arm_of("c_custkey").alias("arm"), F.lit("1999-01-01").cast("timestamp_ntz").alias("t0"))
    promos = t("nation").filter("n_regionkey = 0").select(F.col("n_nationkey").cast("bigint").alias("code"))
    return P.redemption(exposed, o, promos, "u", "t0", "o_orderdate", "o_orderkey", "code", ["arm"])


q("e45_redemption", _redeem, """
WITH p AS (SELECT CASE WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm, c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderkey % 20 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)) AS n FROM customer)
SELECT arm, count(*) AS exposed, count(CASE WHEN n > 0 THEN 1 END) AS redeemers, CAST(sum(n) AS BIGINT) AS redeemed_orders, count(CASE WHEN n > 0 THEN 1 END) / count(*) AS redemption_rate FROM p GROUP BY 1""", "redemption_rate")

q("e46_group_runs", lambda t: S.group_runs(sess(t), SKEY, ["ts", "event_id"], ["event_type"]).select("event_id", "run_id"), f"WITH {_RUNS} SELECT event_id, run_id FROM g")

q("e47_daily_rollup", lambda t: S.daily_rollup(_rollup(t).withColumn("duration_band", X.bin_edges("duration_seconds", [60, 3600, 14400], ["<1m", "<1h", "<4h", ">=4h"])).withColumn("day_part", X.day_part(X.zone_shift("start_ts", "America/Los_Angeles"))),
    "event_date", ["deepest_stage", "duration_band", "day_part"], {"n": F.count(F.lit(1)), "events": F.sum("n_events")}), f"""
WITH {_ROLL}, z AS (SELECT *, epoch_us(end_ts) // 1000000 - epoch_us(start_ts) // 1000000 AS x, floor((epoch_us(end_ts) - epoch_us(start_ts)) / 1000000) AS d, hour(start_ts - INTERVAL 8 HOUR) AS h FROM r)
SELECT event_date, CASE WHEN has_purchase = 1 THEN 'purchase' WHEN has_click = 1 THEN 'click' WHEN has_view = 1 THEN 'view' ELSE 'none' END AS deepest_stage, CASE WHEN d < 60 THEN '<1m' WHEN d < 3600 THEN '<1h' WHEN d < 14400 THEN '<4h' ELSE '>=4h' END AS duration_band,
  CASE WHEN h < 5 THEN 'late night' WHEN h < 11 THEN 'morning' WHEN h < 14 THEN 'lunch' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'dinner' ELSE 'night' END AS day_part, count(*) AS n, CAST(sum(n_events) AS BIGINT) AS events FROM z GROUP BY 1, 2, 3, 4""")


def _active_days(t):
    return t("events").select(F.to_date("ts").alias("day"), "event_type", "user_id")


def _states(t):
    """Numbers given in two steps, as a daily job would: first half of the month, then the rest."""
    days = _active_days(t)
    numbers = D.entity_numbers(days, "user_id", D.entity_numbers(days.filter("day < DATE'2024-01-16'"), "user_id"))
    return D.daily_distinct_state(days, numbers, "day", ["event_type"], "user_id")


q("e47_distinct_28_days", lambda t: D.rolling_distinct(_states(t), "day", ["event_type"], "2024-01-05", "2024-02-10", 28, "users"), """
WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT d.day, event_type, count(DISTINCT user_id) AS users FROM d JOIN events ON CAST(ts AS DATE) BETWEEN d.day - 27 AND d.day GROUP BY 1, 2""")
q("a03_distinct_from_days", lambda t: D.distinct_from_state(_states(t), ["event_type"], "users").unionByName(D.distinct_from_state(_states(t), [], "users").withColumn("event_type", F.lit("all"))), """
SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT user_id) FROM events""")

q("e48_mix_shift", lambda t: P.mix_shift(_items(t).withColumn("arm", arm_of("o_custkey")), "l_suppkey", "p_type", "arm", "l_quantity", "l_extendedprice").drop("baseline"), f"""
WITH {_ITEMS}, v AS (SELECT l_suppkey, CASE WHEN o_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm, p_type, sum(l_quantity) AS volume FROM i GROUP BY 1, 2, 3),
b AS (SELECT l_suppkey, p_type, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY avg(l_extendedprice) DESC) AS baseline_rank FROM i GROUP BY 1, 2)
SELECT l_suppkey, p_type, arm, volume, rank() OVER (PARTITION BY l_suppkey, arm ORDER BY volume DESC) AS arm_rank, volume / sum(volume) OVER (PARTITION BY l_suppkey, arm) AS share, baseline_rank FROM v JOIN b USING (l_suppkey, p_type)""", "share")

q("e49_threshold_shares", lambda t: P.threshold_shares(P.eta_accuracy(_deliveries(t), ["l_suppkey"], "quote", "actual", (0, 20)).withColumn("half", F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd")), ["half"], ["within_0", "within_20"], [0.3, 0.25, 0.2]), f"""
WITH {_DELIV}, p AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS half, avg(CASE WHEN actual <= quote THEN 1.0 ELSE 0 END) AS w0, avg(CASE WHEN actual <= quote + 20 THEN 1.0 ELSE 0 END) AS w20 FROM dl GROUP BY l_suppkey)
SELECT half, metric, level, avg(CASE WHEN v >= level THEN 1.0 ELSE 0 END) AS share FROM (SELECT half, 'within_0' AS metric, w0 AS v FROM p UNION ALL SELECT half, 'within_20', w20 FROM p) CROSS JOIN (VALUES (0.3), (0.25), (0.2)) l(level) GROUP BY 1, 2, 3""", "level share")


def _daily_load(t):
    path = io.scratch_path(t.spark, "sessions")
    io.upsert_partition(_rollup(t).select("user_id", "session_num", "n_events", "deepest_stage", "event_date"), path, "event_date")
    return share_of_total(t.spark.read.parquet(path), ["event_date", "deepest_stage"], ["event_date"])


q("e47_daily_load", _daily_load, f"""
WITH {_ROLL}, d AS (SELECT event_date, CASE WHEN has_purchase = 1 THEN 'purchase' WHEN has_click = 1 THEN 'click' WHEN has_view = 1 THEN 'view' ELSE 'none' END AS deepest_stage FROM r)
SELECT event_date, deepest_stage, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY event_date) AS share FROM d GROUP BY 1, 2""", "share")

q("flagship_purchase_lift", lambda t: purchase_lift(t("events")).select("treatment_n", "treatment_x", "control_n", "control_x", "rate_1", "rate_2", "rate_diff", "rel_lift", "z"), f"""
WITH {_ROLL}, c AS (SELECT count(CASE WHEN user_id % 2 = 1 THEN 1 END) AS treatment_n, CAST(sum(CASE WHEN user_id % 2 = 1 THEN has_purchase END) AS BIGINT) AS treatment_x, count(CASE WHEN user_id % 2 = 0 THEN 1 END) AS control_n, CAST(sum(CASE WHEN user_id % 2 = 0 THEN has_purchase END) AS BIGINT) AS control_x FROM r),
p AS (SELECT *, treatment_x / treatment_n AS rate_1, control_x / control_n AS rate_2, (treatment_x + control_x) / (treatment_n + control_n) AS pool FROM c)
SELECT treatment_n, treatment_x, control_n, control_x, rate_1, rate_2, rate_1 - rate_2 AS rate_diff, (rate_1 - rate_2) / rate_2 AS rel_lift, (rate_1 - rate_2) / sqrt(pool * (1 - pool) * (1 / treatment_n + 1 / control_n)) AS z FROM p""", "rate_1 rate_2 rate_diff rel_lift z")

