"""The end-to-end question: do sessions of the treatment arm purchase more often?"""

from pyspark.sql import functions as F

from cohortspark.operators.sessions import session_rollup, sessionize
from cohortspark.operators.stats import ztest_prop
from cohortspark.plans.common import SKEY, arm_of


def purchase_lift(events, gap_minutes=720):
    """Sessions, purchasing sessions, rates, absolute and relative lift, z and p of treatment against control."""
    rolled = session_rollup(sessionize(events, ["user_id"], "ts", "event_id", gap_minutes), SKEY, "ts", "event_type", "event_id",
                            {"view": F.col("event_type") == "view", "purchase": F.col("event_type") == "purchase"})
    arm = rolled.withColumn("arm", arm_of("user_id"))
    t, c = F.col("arm") == "treatment", F.col("arm") == "control"
    counts = arm.agg(F.count(F.when(t, 1)).alias("treatment_n"), F.sum(F.when(t, F.col("has_purchase"))).alias("treatment_x"),
                     F.count(F.when(c, 1)).alias("control_n"), F.sum(F.when(c, F.col("has_purchase"))).alias("control_x"))
    out = ztest_prop(counts, "treatment_x", "treatment_n", "control_x", "control_n")
    return out.withColumn("rel_lift", F.col("rate_diff") / F.nullif(F.col("rate_2"), F.lit(0.0)))
