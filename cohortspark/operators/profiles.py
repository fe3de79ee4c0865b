"""Customer, merchant, message and service-quality profiles."""

from functools import reduce

from pyspark.sql import functions as F

from cohortspark.functions.exprs import boundary_diff, classify, ilike_any, plus, safe_div, time_slice
from cohortspark.operators.aggs import mode_of, percentiles, top_n_array
from cohortspark.operators.joins import spread_join
from cohortspark.operators.lineage import durable
from cohortspark.operators.ordered import OrderedScan, key_sum, lag, running_max, running_min, running_sum
from cohortspark.operators.windows import first_per, ranks, streaks


def lifecycle(first, last, as_of, known=None):
    """New / Unrecognized / P0 / Dormant / Churned / Active from first and last order day, tested in that order."""
    first, last = F.to_date(first), F.to_date(last)
    age, idle = F.datediff(as_of, first), F.datediff(as_of, last)
    rules = [] if known is None else [(first.isNull() & known.isNull(), "Unrecognized")]
    return classify(rules + [(first.isNull(), "New"), (age.between(1, 28), "P0"), (idle.between(29, 89), "Dormant"),
                             (idle >= 90, "Churned"), (idle <= 28, "Active")])


# Upper bounds in days of the recency bands counted before the as-of day.
RECENCY_BANDS = ((0, 7), (8, 14), (15, 30), (31, 60), (61, 90), (91, 180))


def order_features(orders, key, order_id, ts, value, merchant, as_of, hot_rows=None):
    """Frequency, gaps, recency bands, weekly streaks, trend and regularity up to the as-of day."""
    day = F.lit(as_of).cast("date")
    frame = orders.filter(F.to_date(ts) <= day).withColumn("_d", F.to_date(ts))
    frame = OrderedScan(frame, [key], [ts, order_id], hot_rows=hot_rows).add(_p=lag("_d")).result()
    frame = frame.withColumns({"_gap": F.datediff("_d", "_p"), "_ago": F.datediff(day, F.col("_d")),
                               "_week": F.floor((F.unix_date("_d") - 4) / 7)})
    frame = durable(frame.select(key, "_d", "_gap", "_ago", "_week", value, merchant))  # four folds read it
    bands = [F.count(F.when(F.col("_ago").between(lo, hi), 1)).alias(f"orders_{lo}_{hi}d") for lo, hi in RECENCY_BANDS]
    last = RECENCY_BANDS[-1][1]
    out = frame.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_distinct("_d").alias("order_days"), F.sum(value).alias("spend"),
        F.datediff(day, F.min("_d")).alias("period_days"), F.min("_ago").alias("recency_days"),
        F.avg("_gap").alias("mean_gap"), F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"), F.stddev_samp("_gap").alias("sd_gap"),
        *bands, F.count(F.when(F.col("_ago") > last, 1)).alias(f"orders_over_{last}d"),
        F.count(F.when(F.col("_ago") <= 90, 1)).alias("orders_late"), F.count(F.when(F.col("_ago") > 90, 1)).alias("orders_early"))
    merchants = frame.select(key, merchant).distinct().groupBy(key).agg(F.count(merchant).alias("n_merchants"))
    runs = streaks(frame, [key], "_week", hot_rows=hot_rows).groupBy(key).agg(
        F.max("length").alias("longest_streak"), F.count(F.lit(1)).alias("n_streaks"), F.sum("length").alias("active_weeks"))
    median = percentiles(frame, [key], "_gap", [0.5], ["median_gap"], hot_rows=hot_rows)
    out = out.join(merchants, key).join(runs, key).join(median, key, "left")
    weekly, monthly = safe_div("n_orders", F.col("period_days") / 7.0), safe_div("n_orders", F.col("period_days") / 30.0)
    return out.withColumns({
        "orders_per_week": weekly,
        "frequency": classify([(weekly >= 2, "high"), (weekly >= 1, "medium"), (monthly >= 1, "low")], "very low"),
        "regularity": classify([(F.col("sd_gap") <= 7, "weekly"), (F.col("sd_gap") <= 14, "biweekly"), (F.col("sd_gap") <= 21, "somewhat")], "sporadic"),
        "trend": classify([(F.col("orders_late") > F.col("orders_early"), "increasing"),
                           (F.col("orders_late") < F.col("orders_early"), "declining")], "stable")})


def merchant_shares(orders, key, merchant, value, hot_rows=None):
    """Orders, spend, shares, rank and favourite type per (key, merchant)."""
    per = orders.groupBy(key, merchant).agg(F.count(F.lit(1)).alias("orders"), F.sum(value).alias("spend"))
    totals = per.groupBy(key).agg(F.sum("orders").alias("_o"), F.sum("spend").alias("_s"))
    per = per.join(totals, key).withColumns({"order_share": F.col("orders") * 100.0 / F.col("_o"), "spend_share": safe_div(F.col("spend") * 100.0, "_s")}).drop("_o", "_s")
    many, big = F.col("orders") >= 3, F.col("order_share") >= 40
    return per.withColumn("favorite", classify([(many & big, "frequent and large"), (many, "frequent"), (big, "large share")], "other"))


def affinity(orders, key, merchant, category, value):
    """Per key: merchants, categories, top merchant, concentration, diversity class and ordering type."""
    per = merchant_shares(orders, key, merchant, value)
    cats = orders.select(key, category).distinct().groupBy(key).agg(F.count(category).alias("n_categories"))
    best = F.struct(-F.col("orders"), -F.col("spend"), F.col(merchant))
    out = per.groupBy(key).agg(
        F.sum("orders").alias("n_orders"), F.count(F.lit(1)).alias("n_merchants"), F.sum("spend").alias("spend"),
        F.count(F.when(F.col("favorite") != "other", 1)).alias("n_favorites"), F.min_by(merchant, best).alias("top_merchant"),
        F.max("order_share").alias("top_share"), F.avg("order_share").alias("mean_share")).join(cats, key)
    n = F.col("n_merchants")
    return out.withColumns({
        "diversity": classify([(n >= 10, "high"), (n >= 5, "medium"), (n >= 2, "low")], "single"),
        "ordering_type": classify([(F.col("top_share") >= 60, "loyalist"), (n >= 10, "explorer"),
                                   (F.col("n_categories") == 1, "category focused"), (n <= 3, "few favorites")], "balanced")})


def favorites(orders, key, category, merchant, dow, meal, n_categories=3, n_merchants=10):
    """Top categories and merchants as arrays, modal day of week and meal time."""
    def top(column, n, name):
        counts = orders.groupBy(key, column).agg(F.count(F.lit(1)).alias("_n"))
        return top_n_array(counts, [key], column, ["-_n", column], n, name)

    return (top(category, n_categories, "top_categories").join(top(merchant, n_merchants, "top_merchants"), key)
            .join(mode_of(orders, [key], dow, "usual_dow"), key).join(mode_of(orders, [key], meal, "usual_meal"), key))


def lookback_features(snapshots, events, unit, snap, ts, windows, metrics, hot_rows=None):
    """``<metric>_<w>d`` over the w days before each snapshot day; ``metrics`` = {name: (agg, value or None, condition or
    None)} with count, sum or avg. NULL where the unit has no event in the longest window.

    Events fold to days and are summed up once per unit; a snapshot reads the running totals at the start of each window
    and at its end, so no snapshot is paired with events.
    """
    unknown = {kind for kind, _, _ in metrics.values()} - {"count", "sum", "avg"}
    if unknown:
        raise ValueError(f"running totals do not give {sorted(unknown)}")
    folds = {"_n": F.count(F.lit(1))}
    for i, (_, value, cond) in enumerate(metrics.values()):
        x = F.lit(1) if value is None else F.col(value)
        x = x if cond is None else F.when(cond, x)
        folds[f"_n{i}"] = F.count(x)
        folds[f"_s{i}"] = F.sum(x.cast("double") if value is None else x)
    days = events.filter(F.col(unit).isNotNull()).groupBy(unit, F.to_date(ts).alias("_day")).agg(*[e.alias(n) for n, e in folds.items()]).filter(F.col("_day").isNotNull())
    points = snapshots.select(unit, snap).filter(F.col(unit).isNotNull() & F.col(snap).isNotNull()).distinct()
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.date_sub(F.to_date(snap), w + 1).alias("d")) for w in (0, *windows)])
    points = points.withColumn("_x", F.explode(places)).select(unit, F.col(snap).alias("_snap"), F.col("_x.w").alias("_w"), F.col("_x.d").alias("_day"))
    scan = OrderedScan(days.withColumn("_w", F.lit(-1)).unionByName(points, allowMissingColumns=True), [unit], ["_day", "_w", "_snap"], hot_rows=hot_rows)
    totals = scan.add(**{f"_t{n}": running_sum(n) for n in folds}).result().filter("_w >= 0")
    at = lambda n, w: F.max(F.when(F.col("_w") == w, F.coalesce(F.col(f"_t{n}"), F.lit(0))))
    read = totals.groupBy(unit, F.col("_snap").alias(snap)).agg(*[at(n, w).alias(f"{n}@{w}") for n in folds for w in (0, *windows)])
    inside = lambda n, w: F.col(f"`{n}@0`") - F.col(f"`{n}@{w}`")
    out = []
    for w in windows:
        for i, (name, (kind, value, _)) in enumerate(metrics.items()):
            n, s = inside(f"_n{i}", w), inside(f"_s{i}", w)
            out.append((n if kind == "count" else F.when(n > 0, s if kind == "sum" else s / n)).alias(f"{name}_{w}d"))
    return snapshots.join(read.filter(inside("_n", max(windows)) > 0).select(unit, snap, *out), [unit, snap], "left")


def stage_recency(base, events, unit, t0, ts, stages, whole_days=False, hot_rows=None):
    """Per exposure (unit, t0): days since and number of each stage's events before t0.

    With ``whole_days`` only events up to the day before t0 count, events are folded to days first, and each stage also
    gets ``has_``, ``first_day_``, ``last_day_`` and ``n_days_``. Events and exposures are stacked and scanned once in
    time order, each exposure reading what has run up; none is paired with events.
    """
    exposures = base.select(unit, t0).distinct()
    events = events.filter(F.col(unit).isNotNull() & F.col(ts).isNotNull())
    kind = "date" if whole_days else "timestamp_ntz"
    marks = exposures.filter(F.col(unit).isNotNull() & F.col(t0).isNotNull()).select(unit, F.col(t0).cast(kind).alias("_at"), F.lit(0).alias("_kind"), F.col(t0).alias("_t0"))
    rows = events.groupBy(unit, F.col(ts).cast(kind).alias("_at")).agg(*[F.count(F.when(c, 1)).alias(f"_n_{n}") for n, c in stages.items()]).withColumn("_kind", F.lit(1))
    scan = OrderedScan(marks.unionByName(rows, allowMissingColumns=True), [unit], ["_at", "_kind", "_t0"], hot_rows=hot_rows)
    scan.derive(**{f"_d_{n}": F.when(F.col(f"_n_{n}") > 0, F.col("_at")) for n in stages}, **{f"_o_{n}": F.when(F.col(f"_n_{n}") > 0, 1) for n in stages})
    ops = {}
    for n in stages:
        ops |= {f"n_{n}": running_sum(f"_n_{n}"), f"last_day_{n}": running_max(f"_d_{n}")}
        if whole_days:
            ops |= {f"n_days_{n}": running_sum(f"_o_{n}"), f"first_day_{n}": running_min(f"_d_{n}")}
    found = scan.add(**ops).result().filter("_kind = 0")
    found = found.withColumns({f"days_since_{n}": F.datediff(F.to_date("_t0"), F.to_date(f"last_day_{n}")) for n in stages})
    kinds = ["days_since", "n", "n_days", "first_day", "last_day"] if whole_days else ["days_since", "n"]
    names = [f"{k}_{n}" for n in stages for k in kinds]
    counts = [c for c in names if c.startswith("n_")]
    out = spread_join(base, found.select(F.col(unit), F.col("_t0").alias(t0), *names), [unit, t0], "left", hot_rows, null_safe=True)
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    return out.withColumns({f"has_{n}": (F.col(f"n_{n}") > 0).cast("int") for n in stages}) if whole_days else out


def message_sequence(messages, unit, campaign, message_id, sent, hot_rows=None):
    """Rank of each message in its unit and campaign by first send time, and minutes since the previous message."""
    first = messages.groupBy(unit, campaign, message_id).agg(F.min(sent).alias("first_sent"))
    ranked = ranks(first, [unit, campaign], "first_sent", rank="_r", dense="message_no", hot_rows=hot_rows).drop("_r")
    scan = OrderedScan(ranked, [unit, campaign], ["first_sent", message_id], hot_rows=hot_rows).add(_p=lag("first_sent"))
    return scan.derive(minutes_since_prev=boundary_diff("MINUTE", "_p", "first_sent")).result().drop("_p")


def post_send_rates(messages, by, sent, outcomes, windows):
    """Share of messages followed by each outcome within each window (hours)."""
    aggs = [F.count(F.lit(1)).alias("n_sent")]
    for name, ts in outcomes.items():
        for w in windows:
            hit = (F.col(ts) >= F.col(sent)) & (F.col(ts) <= plus(sent, hours=w))
            aggs.append(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias(f"{name}_{w}h"))
    return messages.groupBy(*by).agg(*aggs)


def tag_flags(tags, entity, tag, rules):
    """One-hot ``has_<category>`` per entity from ordered (pattern list, category) rules."""
    label = classify([(ilike_any(tag, patterns), name) for name, patterns in rules.items()], "other")
    names = list(rules) + ["other"]
    coded = tags.select(entity, label.alias("_c"))
    return coded.groupBy(entity).agg(*[F.max(F.when(F.col("_c") == n, 1).otherwise(0)).alias(f"has_{n}") for n in names])


def overlap(df, pairs, name="overlap"):
    """Count and flag of preferences found in the content; ``pairs`` = [(text column, needle column or literal)]."""
    hits = [F.when(F.coalesce(F.contains(F.lower(F.col(a)), F.lower(b if not isinstance(b, str) else F.lit(b))), F.lit(False)), 1).otherwise(0) for a, b in pairs]
    total = reduce(lambda x, y: x + y, hits)
    return df.withColumns({f"{name}_count": total, f"has_{name}": F.when(total > 0, 1).otherwise(0)})


def array_overlap(df, a, b, name="overlap"):
    return df.withColumns({f"{name}_count": F.size(F.array_intersect(a, b)), f"has_{name}": F.arrays_overlap(a, b).cast("int")})


def eta_accuracy(df, by, quote, actual, slacks=(0, 5, 10, 20), min_n=1):
    """Share of deliveries within the quote plus each slack; groups below ``min_n`` rows are left out."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(F.col(actual) <= F.col(quote) + s, 1.0).otherwise(0.0)).alias(f"within_{s}") for s in slacks])
    return out.filter(F.col("n") >= min_n)


def latest_in_bin(df, keys, ts, tiebreak, seconds=300):
    """Latest row per key and time bin."""
    binned = df.withColumn("bin_start", time_slice(ts, seconds))
    return first_per(binned, list(keys) + ["bin_start"], [f"-{ts}", f"-{tiebreak}"])


def qcut(df, value, q, name="quantile", hot_rows=None):
    """Quantile label 1..q by exact quantile edges (right-closed), as edges on the value."""
    from cohortspark.operators.joins import with_totals

    probs = [i / q for i in range(1, q)]
    edges = percentiles(df, [], value, probs, [f"_e{i}" for i in range(1, q)], hot_rows=hot_rows)
    framed = with_totals(df, edges)
    label = classify([(F.col(value) <= F.col(f"_e{i}"), i) for i in range(1, q)], q)
    return framed.withColumn(name, F.when(F.col(value).isNotNull(), label)).drop(*edges.columns)


def ratio_to_baseline(df, cohort, period, base, metrics):
    """Each cohort's metric over the baseline cohort's in the same period."""
    ref = df.filter(F.col(cohort) == base).select(period, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    out = df.join(ref, period, "left")
    return out.withColumns({f"{m}_ratio": safe_div(m, f"_b_{m}") for m in metrics}).drop(*[f"_b_{m}" for m in metrics])


def size_impact(df, segment, exposed, converted, lift):
    """Exposed, share, rate and extra conversions if the relative ``lift`` (literal or {segment: lift}) held."""
    from cohortspark.operators.joins import with_totals

    seg = df.groupBy(segment).agg(F.sum(exposed).alias("exposed"), F.sum(converted).alias("converted"))
    seg = with_totals(seg, df.agg(F.sum(exposed).alias("_all")))
    factor = classify([(F.col(segment) == k, float(v)) for k, v in lift.items()], 0.0) if isinstance(lift, dict) else F.lit(float(lift))
    rate = safe_div("converted", "exposed")
    return seg.select(segment, "exposed", "converted", safe_div("exposed", "_all").alias("exposed_share"), rate.alias("rate"),
                      factor.alias("lift"), (F.col("exposed") * rate * factor).alias("extra_conversions"))


def status_rates(df, by, unit, status_cols, on_value="on"):
    """Share of units per status switched on and with any of them on."""
    per = df.groupBy(*by, unit).agg(*[F.max(F.when(F.col(c) == on_value, 1).otherwise(0)).alias(c) for c in status_cols])
    any_on = F.greatest(*[F.col(c) for c in status_cols]) if len(status_cols) > 1 else F.col(status_cols[0])
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in status_cols],
                                F.avg(any_on.cast("double")).alias("any_rate"))


def redemption(exposed, orders, promos, unit, t0, ts, order_id, code, by, hot_rows=None):
    """Exposed units, units with a later order using an eligible code, their orders, and the redemption rate. An exposure
    counts the unit's orders less those before it, from one scan of both; none is paired with orders."""
    eligible = orders.join(promos.select(code).distinct(), code, "left_semi").filter(F.col(unit).isNotNull() & F.col(ts).isNotNull())
    eligible = eligible.groupBy(unit, F.col(ts).cast("timestamp_ntz").alias("_at")).agg(F.count(F.lit(1)).alias("_orders")).withColumn("_kind", F.lit(1))
    marks = exposed.groupBy(*by, unit, F.col(t0).cast("timestamp_ntz").alias("_at")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_kind", F.lit(0))
    scan = OrderedScan(marks.unionByName(eligible, allowMissingColumns=True), [unit], ["_at", "_kind", *by], hot_rows=hot_rows)
    read = scan.add(_before=running_sum("_orders"), _all=key_sum("_orders")).result().filter("_kind = 0")
    later = F.coalesce("_all", F.lit(0)) - F.coalesce("_before", F.lit(0))
    later = F.when(F.col(unit).isNotNull() & F.col("_at").isNotNull(), later * F.col("_rows")).otherwise(0)
    per = read.groupBy(*by, unit).agg(F.sum(later).alias("_n"))
    out = per.groupBy(*by).agg(F.count(F.lit(1)).alias("exposed"), F.count(F.when(F.col("_n") > 0, 1)).alias("redeemers"), F.sum("_n").alias("redeemed_orders"))
    return out.withColumn("redemption_rate", F.col("redeemers") / F.col("exposed"))


def mix_shift(df, group, item, arm, volume, baseline):
    """Rank and share of items within (group, arm) against the item's dense rank by a baseline volume in the group. The
    source is read once and folded to (group, arm, item); all else reads that."""
    cells = durable(df.groupBy(group, arm, item).agg(F.sum(volume).alias("volume"), F.sum(baseline).alias("_s"), F.count(baseline).alias("_n")))
    totals = cells.groupBy(group, arm).agg(F.sum("volume").alias("_t"))
    per = ranks(cells.select(group, arm, item, "volume"), [group, arm], "volume", descending=True, rank="arm_rank", dense="_d").drop("_d")
    per = per.join(totals, [group, arm]).withColumn("share", safe_div("volume", "_t")).drop("_t")
    base = cells.groupBy(group, item).agg((F.sum("_s") / F.sum("_n")).alias("baseline"))
    base = ranks(base, [group], "baseline", descending=True, rank="_r", dense="baseline_rank").drop("_r")
    return per.join(base, [group, item])


def threshold_shares(df, by, metrics, levels):
    """Share of entities with each metric at or above each level, in long form."""
    names = {f"{m}@{lv}": (m, lv) for m in metrics for lv in levels}
    wide = df.groupBy(*by).agg(*[F.avg(F.when(F.col(m) >= lv, 1.0).otherwise(0.0)).alias(n) for n, (m, lv) in names.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(lv)).alias("level"), F.col(f"`{n}`").alias("share")) for n, (m, lv) in names.items()]))
    return wide.select(*by, rows.alias("r")).select(*by, "r.*")


