"""Frames and SQL pieces the registered queries share."""

from pyspark.sql import functions as F

from cohortspark.operators.sessions import sessionize


def arm_of(c):
    """Deterministic arm of a unit id: odd ids are treatment."""
    return F.when(F.col(c) % 2 == 1, "treatment").otherwise("control")


def sess(t, gap=720, per_day=True):
    return sessionize(t("events"), ["user_id"], "ts", "event_id", gap, per_day)


SKEY = ["user_id", "event_date", "session_num"]


def sess_sql(gap=720):
    return f"""
  lagged AS (SELECT *, CAST(ts AS DATE) AS event_date,
                    lag(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS prev_ts FROM events),
  s AS (SELECT event_id, ts, user_id, event_type, value, props, event_date,
               CAST(sum(CASE WHEN prev_ts IS NULL OR date_diff('minute', prev_ts, ts) >= {gap} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id, event_date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS session_num
        FROM lagged)"""


def unit_orders(t):
    """Per customer: arm, orders, spend (0 when there are none) and segment."""
    o = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    c = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return c.fillna(0, subset=["n_orders", "spend"]).withColumn("arm", arm_of("c_custkey"))


UNITS_SQL = """
  units AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(spend, 0) AS spend,
                   CASE WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm
            FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY 1) o
              ON c_custkey = o_custkey)"""


def order_history(t):
    """Customer states in time: each order day opens a state that lasts to the day before the next one."""
    from cohortspark.operators.ordered import OrderedScan, lead

    day = t("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("start_day")).agg(
        F.max_by("o_orderpriority", "o_orderkey").alias("state"))
    scan = OrderedScan(day, ["o_custkey"], ["start_day"]).add(_next=lead("start_day"))
    return scan.derive(end_day=F.date_sub("_next", 1)).result().drop("_next")


HISTORY_SQL = """
  d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS start_day, arg_max(o_orderpriority, o_orderkey) AS state FROM orders GROUP BY 1, 2),
  scd AS (SELECT *, CAST(lead(start_day) OVER (PARTITION BY o_custkey ORDER BY start_day) - INTERVAL 1 DAY AS DATE) AS end_day FROM d)"""


def first_events(t):
    """Exposure of each user: the first event."""
    return t("events").groupBy("user_id").agg(F.min("ts").alias("t0")).withColumn("arm", arm_of("user_id"))


EXPOSURE_SQL = """
  x AS (SELECT user_id, min(ts) AS t0, CASE WHEN user_id % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm FROM events GROUP BY user_id)"""
