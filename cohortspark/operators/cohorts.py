"""Cohort, funnel, retention and activity operators."""

from pyspark.sql import functions as F

from cohortspark.functions.exprs import classify, plus
from cohortspark.operators.aggs import distinct_entities, union_sources
from cohortspark.operators.joins import spread_join, window_join
from cohortspark.operators.ordered import OrderedScan, lag, lead, null_safe_join, row_number, running_sum
from cohortspark.operators.windows import first_per

#: default day buckets since the start: whole weeks of seven days
WEEK_BUCKETS = ((0, 6), (7, 13), (14, 20), (21, 27))


def define_cohort(events, unit, ts, tiebreak, condition, label):
    """First qualifying event per unit."""
    return first_per(events.filter(condition), [unit], [ts, tiebreak]).select(
        unit, F.col(ts).alias("cohort_ts"), F.lit(label).alias("cohort"))


def stack_cohorts(cohorts):
    return union_sources(cohorts)


def nth_sessions(sessions, unit, start, session_id, origin, n=3, buckets=WEEK_BUCKETS, hot_rows=None):
    """Ids of the first n sessions per unit and of the latest session in each day bucket since ``origin``."""
    scan = OrderedScan(sessions, [unit], [start, session_id], hot_rows=hot_rows).add(_n=row_number())
    day = F.datediff(F.to_date(start), F.to_date(origin))
    order = F.struct(F.col(start), F.col(session_id))
    aggs = [F.max(F.when(F.col("_n") == i, F.col(session_id))).alias(f"session_{i}") for i in range(1, n + 1)]
    aggs += [F.max_by(F.when(day.between(lo, hi), F.col(session_id)), F.when(day.between(lo, hi), order)).alias(f"last_d{lo}_{hi}")
             for lo, hi in buckets]
    return scan.result().groupBy(unit).agg(*aggs)


def bucket_counts(sessions, unit, session_id, day, buckets=WEEK_BUCKETS):
    """Distinct sessions per day bucket."""
    per = sessions.select(unit, session_id, F.col(day).alias("_d")).distinct()
    in_bucket = per.groupBy(unit, session_id).agg(
        *[F.max(F.when(F.col("_d").between(lo, hi), 1).otherwise(0)).alias(f"sessions_d{lo}_{hi}") for lo, hi in buckets])
    return in_bucket.groupBy(unit).agg(*[F.sum(f"sessions_d{lo}_{hi}").alias(f"sessions_d{lo}_{hi}") for lo, hi in buckets])


def unstack_sessions(wide, unit, columns, events, session_id):
    """Wide session-id columns to (unit, label, session) rows, joined to the events of those sessions."""
    long = wide.unpivot([unit], list(columns), "session_label", session_id).filter(F.col(session_id).isNotNull())
    return long.join(events, [unit, session_id])


def funnel(df, stages, entity, by=()):
    """Distinct entities per ordered stage with step and overall conversion, in long form."""
    wide = distinct_entities(df, by, entity, stages)
    names = list(stages)
    rows = [F.struct(F.lit(i + 1).alias("stage_no"), F.lit(n).alias("stage"), F.col(n).alias("entities"),
                     (F.col(n) / F.nullif(F.col(names[max(i - 1, 0)]), F.lit(0))).alias("step_rate"),
                     (F.col(n) / F.nullif(F.col(names[0]), F.lit(0))).alias("overall_rate")) for i, n in enumerate(names)]
    return wide.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def stage_ratio(df, by, stage_no, value, name="step_rate"):
    """Stage-to-stage ratio of an aggregate table (one row per group and stage)."""
    totals = df.groupBy(*by, stage_no).agg(F.sum(value).alias(value))
    scan = OrderedScan(totals, by, [stage_no]).add(_p=lag(value))
    return scan.derive(**{name: F.col(value) / F.nullif(F.col("_p"), F.lit(0))}).result().drop("_p")


def window_flags(base, events, unit, t0, ts, windows, stages):
    """0/1 flag per (stage, day window) after entry, from one window join at the longest window."""
    event_cols = events.select(unit, F.col(ts).alias("_ts"), *[F.when(c, 1).otherwise(0).alias(f"_s_{n}") for n, c in stages.items()])
    entry = base.select(unit, F.col(t0).alias("_t0"))
    inside = window_join(entry, event_cols, unit, "_t0", "_ts", lo=0, hi=max(windows) * 86400)
    hit = {f"{n}_d{w}": (F.col(f"_s_{n}") == 1) & (F.col("_ts") <= plus("_t0", days=w)) for n in stages for w in windows}
    per = inside.groupBy(unit, "_t0").agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in hit.items()])
    out = base.join(per.withColumnRenamed("_t0", t0), [unit, t0], "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in hit})


def horizon_flags(df, first_ts, t0, horizons):
    """``had_<name>`` = 1 when the first event lies within the horizon (hours) after t0."""
    return df.withColumns({f"had_{n}": F.when(F.col(first_ts).between(F.col(t0), plus(t0, hours=h)), 1).otherwise(0)
                           for n, h in horizons.items()})


def retention(base, activity, unit, t0, ts, days, by=()):
    """Units active on day d since the start, with the rate and the drop from the previous day."""
    acts = activity.select(unit, F.col(ts).alias("_ts"))
    start = base.select(*dict.fromkeys([unit, t0, *by]))
    inside = window_join(start, acts, unit, t0, "_ts", lo=0, hi=(days + 1) * 86400, include_lo=True)
    day = F.datediff(F.to_date("_ts"), F.to_date(t0)).alias("day")
    active = inside.select(unit, *by, day).filter(F.col("day") <= days).distinct().groupBy(*by, "day").agg(F.count(F.lit(1)).alias("active"))
    sizes = start.select(unit, *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("cohort_size"))
    grid = sizes.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(int(days)))))
    full = grid.join(active, [*by, "day"], "left").withColumn("active", F.coalesce("active", F.lit(0)))
    full = full.withColumn("rate", F.col("active") / F.col("cohort_size"))
    scan = OrderedScan(full, list(by), ["day"]).add(_p=lag("rate"))
    return scan.derive(drop_off=F.col("_p") - F.col("rate")).result().drop("_p")


def period_flags(df, unit, month_no, months):
    """``m<k>`` = 1 when the unit was active in month k (months are not cumulative)."""
    return df.groupBy(unit).agg(*[F.max(F.when(F.col(month_no) == k, 1).otherwise(0)).alias(f"m{k}") for k in months])


def rolling_active(entities, activity, unit, by, day, start, end, window=28, hot_rows=None):
    """Entities active in the ``window`` days before each date, by group.

    A unit's days are merged to stretches without a gap: a day adds one where no other covers the day after it, and
    takes one away where its cover ends and no later day goes on. So every activity day is two rows at most, whatever
    the window, and a sweep over the dates adds them up.
    """
    days = activity.filter(F.col(unit).isNotNull()).select(unit, F.to_date(day).alias("_d")).filter(F.col("_d").isNotNull()).distinct()
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    near = OrderedScan(days, [unit], ["_d"], hot_rows=hot_rows).add(_p=lag("_d"), _n=lead("_d")).result()
    begins = F.col("_p").isNull() | (F.datediff("_d", "_p") > window)
    ends = F.col("_n").isNull() | (F.datediff("_n", "_d") > window)
    step = lambda when, after, by_: F.when(when, F.struct(F.greatest(F.date_add("_d", after), lo).alias("day"), F.lit(by_).alias("step")))
    steps = near.select(unit, F.explode(F.array_compact(F.array(step(begins, 1, 1), step(ends, window + 1, -1)))).alias("x"))
    steps = steps.select(unit, F.col("x.day").alias("analysis_date"), "x.step").filter(F.col("analysis_date") <= hi)
    groups = entities.select(unit, *by).distinct()
    changes = steps.join(groups, unit).withColumnRenamed("step", "_step")
    sizes = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    grid = sizes.withColumn("analysis_date", F.explode(F.sequence(lo, hi)))
    moves = changes.groupBy("analysis_date", *by).agg(F.sum("_step").alias("_step")).filter("_step <> 0")
    out = null_safe_join(grid, moves, ["analysis_date", *by]).withColumn("_step", F.coalesce("_step", F.lit(0)))
    out = OrderedScan(out, list(by), ["analysis_date"]).add(active=running_sum("_step")).result()
    return out.withColumn("active_rate", F.col("active") / F.col("total")).select("analysis_date", *by, "total", "active", "active_rate")


def lapsed_cohort(entities, orders, unit, created, order_day, periods, days=365):
    """Per period: entities at least ``days`` old with no order in the ``days`` days before it, how many of them order
    within the period, and their orders.

    ``periods`` is a list of (first_day, last_day) strings. A lapse is a gap between neighbouring orders, so each gap
    lists only the periods that fall into it; entities are not crossed with periods.
    """
    od = orders.select(unit, F.to_date(order_day).alias("_d")).groupBy(unit, "_d").agg(F.count(F.lit(1)).alias("_n"))
    born = entities.select(unit, F.to_date(created).alias("_born")).distinct()
    points = od.select(unit, "_d").unionByName(born.select(unit, F.lit("1900-01-01").cast("date").alias("_d")))
    nxt = OrderedScan(points, [unit], ["_d"]).add(_next=lead("_d")).result()
    spans = F.array(*[F.struct(F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for a, b in periods])
    quiet = nxt.join(born, unit).withColumn("p", F.explode(F.filter(spans, lambda p: (
        (F.date_add(F.col("_d"), days) < p["a"]) & (F.col("_next").isNull() | (F.col("_next") >= p["a"]))
        & (F.date_add(F.col("_born"), days) <= p["a"])))))
    lapsed = quiet.select(unit, F.col("p.a").alias("period_start"), F.col("p.b").alias("period_end"))
    in_period = od.withColumn("p", F.explode(F.filter(spans, lambda p: (F.col("_d") >= p["a"]) & (F.col("_d") <= p["b"]))))
    in_period = in_period.groupBy(unit, F.col("p.a").alias("period_start")).agg(F.sum("_n").alias("_orders"))
    joined = lapsed.join(in_period, [unit, "period_start"], "left")
    out = joined.groupBy("period_start", "period_end").agg(
        F.count(F.lit(1)).alias("lapsed"), F.count("_orders").alias("reconverted"), F.coalesce(F.sum("_orders"), F.lit(0)).alias("orders"))
    return out.withColumn("conversion_rate", F.col("reconverted") / F.col("lapsed"))


def population_overlap(a, b, unit, by=()):
    """Sizes of both populations, of their intersection, and its share of a."""
    both = a.select(*by, unit).distinct().withColumn("_a", F.lit(1)).join(
        b.select(*by, unit).distinct().withColumn("_b", F.lit(1)), [*by, unit], "full")
    out = both.groupBy(*by).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
                                F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_both"))
    return out.withColumn("share_of_a", F.col("n_both") / F.nullif(F.col("n_a"), F.lit(0)))


def sessions_before_first(sessions, conversions, unit, start, conv_ts, hot_rows=None):
    """Sessions up to the unit's first conversion, split by same day or earlier days."""
    first = conversions.groupBy(unit).agg(F.min(conv_ts).alias("_first"))
    upto = spread_join(sessions, first, unit, "inner", hot_rows).filter(F.col(start) <= F.col("_first"))
    same = F.to_date(start) == F.to_date("_first")
    return upto.groupBy(unit).agg(F.count(F.when(same, 1)).alias("same_day_sessions"), F.count(F.when(~same, 1)).alias("earlier_sessions"))


def cohort_label(first_ts, rules, default="other"):
    return classify(rules(F.col(first_ts)), default)
