"""Event-log and session operators."""

from pyspark.sql import functions as F

from cohortspark.functions.exprs import boundary_diff, classify, micros
from cohortspark.operators.aggs import distinct_entities, percentiles, share_of_total, union_sources
from cohortspark.operators.joins import spread_join, with_totals
from cohortspark.operators.ordered import OrderedScan, ffill, lag, lead, row_number, running_sum
from cohortspark.operators.windows import first_per, top_n


def union_events(sources, rules=None, name="event_class", default="action"):
    """Stack event sources to one schema and label each row by the first matching rule."""
    events = union_sources(sources)
    return events.withColumn(name, classify(rules, default)) if rules else events


def dedup_events(events, keys, ts, tiebreak):
    """First event per key."""
    return first_per(events, keys, [ts, tiebreak])


def sessionize(events, key, ts, tiebreak, gap_minutes=30, per_day=True, hot_rows=None):
    """Number sessions per key (and day): a new one starts with no earlier event or after ``gap_minutes`` minute
    boundaries. Rows at one timestamp share a session. Adds event_date, session_num, session_start."""
    frame = events.withColumn("event_date", F.to_date(ts))
    keys = list(key) + (["event_date"] if per_day else [])
    scan = OrderedScan(frame, keys, [ts, tiebreak], hot_rows=hot_rows).add(_prev=lag(ts))
    fresh = F.col("_prev").isNull() | (boundary_diff("MINUTE", "_prev", ts) >= gap_minutes)
    scan.derive(_new=F.when(fresh, 1).otherwise(0), _start=F.when(fresh, F.col(ts)))
    scan.add(session_num=running_sum("_new"), session_start=ffill("_start"))
    return scan.result().withColumn("session_num", F.col("session_num").cast("int")).drop("_prev", "_new", "_start")


def last_touch(events, keys, ts, tiebreak, is_target, touches, surface, name="attributed", unknown="Unknown", hot_rows=None):
    """Attribute target events to the latest earlier touch of the same key.

    ``touches`` is a priority list of (label, condition), e.g. click before impression; a target's own surface wins.
    """
    order = [ts, tiebreak]
    scan = OrderedScan(events, keys, order, hot_rows=hot_rows)
    scan.derive(**{f"_t{i}": F.when(cond | is_target, F.col(surface)) for i, (_, cond) in enumerate(touches)})
    scan.add(**{f"_a{i}": ffill(f"_t{i}") for i in range(len(touches))})
    found = F.coalesce(F.col(surface), *[F.col(f"_a{i}") for i in range(len(touches))], F.lit(unknown))
    scan.derive(**{name: F.when(is_target, found).otherwise(F.col(surface))})
    return scan.result().drop(*[f"_{p}{i}" for p in "ta" for i in range(len(touches))])


def flag_after_first(df, keys, ts, pred, name="pre_flag"):
    """1 up to the key's first matching event, 0 for rows after it."""
    first = df.filter(pred).groupBy(*keys).agg(F.min(ts).alias("_first"))
    out = spread_join(df, first, keys)
    return out.withColumn(name, F.when(F.col(ts) > F.col("_first"), 0).otherwise(1)).drop("_first")


def session_rollup(events, keys, ts, event, tiebreak, stages, entity=None, value=None, prior=None):
    """One row per session: events, stage flags, deepest stage, first/last event, duration, distinct counts.

    ``stages`` is an ordered {name: condition}; ``prior`` = (entity key list, stage) adds a flag telling whether an
    earlier session of that entity reached the stage.
    """
    order = F.struct(F.col(ts), F.col(tiebreak))
    aggs = [F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
            F.min_by(event, order).alias("first_event"), F.max_by(event, order).alias("last_event")]
    aggs += [F.max(F.when(c, 1).otherwise(0)).alias(f"has_{n}") for n, c in stages.items()]
    aggs += [F.count_distinct(entity).alias("n_entities")] if entity else []
    aggs += [F.sum(value).alias("total_value")] if value else []
    out = events.groupBy(*keys).agg(*aggs)
    out = out.withColumn("duration_seconds", F.floor((micros("end_ts") - micros("start_ts")) / 1000000))
    names = list(stages)
    deepest = classify([(F.col(f"has_{n}") == 1, n) for n in reversed(names)], "none")
    out = out.withColumn("deepest_stage", deepest)
    if prior:
        entity_keys, stage = prior
        scan = OrderedScan(out, entity_keys, ["start_ts"] + [k for k in keys if k not in entity_keys])
        scan.add(_done=running_sum(f"has_{stage}"))
        out = scan.derive(**{f"prior_{stage}": F.when(F.col("_done") - F.col(f"has_{stage}") > 0, 1).otherwise(0)}).result().drop("_done")
    return out


def group_runs(df, keys, order, change_cols, name="run_id", hot_rows=None):
    """Number runs of consecutive rows with equal ``change_cols``."""
    now = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in change_cols])
    scan = OrderedScan(df.withColumn("_sig", now), keys, order, hot_rows=hot_rows).add(_was=lag("_sig"))
    scan.derive(_chg=F.when(F.col("_was").isNull() | (F.col("_was") != F.col("_sig")), 1).otherwise(0))
    return scan.add(**{name: running_sum("_chg")}).result().drop("_sig", "_was", "_chg")


def first_action(df, keys, order, event, rules, default="other", hot_rows=None):
    """Class of a session's first action from its first and second event group.

    ``rules`` is a function (first, next) -> list of (condition, label).
    """
    runs = group_runs(df, keys, order, [event], hot_rows=hot_rows).filter(F.col("run_id") <= 2)
    pair = runs.groupBy(*keys).agg(F.max(F.when(F.col("run_id") == 1, F.col(event))).alias("first_event"),
                                   F.max(F.when(F.col("run_id") == 2, F.col(event))).alias("next_event"))
    return pair.withColumn("first_action", classify(rules(F.col("first_event"), F.col("next_event")), default))


def session_features(events, keys, ts, event, kinds, early_seconds=(30, 120)):
    """Wide features per session: counts per kind, seconds to the first of each kind, early events, pace, ratios."""
    starts = events.groupBy(*keys).agg(F.min(ts).alias("_t0"))
    timed = spread_join(events, starts, keys, "inner").withColumn("_s", (micros(ts) - micros("_t0")) / 1000000.0)
    aggs = [F.count(F.lit(1)).alias("n_events"), F.max("_s").alias("duration_s")]
    for k in kinds:
        aggs += [F.count(F.when(F.col(event) == k, 1)).alias(f"n_{k}"), F.min(F.when(F.col(event) == k, F.col("_s"))).alias(f"s_to_first_{k}")]
    aggs += [F.count(F.when(F.col("_s") <= s, 1)).alias(f"n_first_{s}s") for s in early_seconds]
    out = timed.groupBy(*keys).agg(*aggs)
    out = out.withColumn("events_per_minute", F.when(F.col("duration_s") > 0, F.col("n_events") / (F.col("duration_s") / 60.0)))
    return out.withColumns({f"share_{k}": F.col(f"n_{k}") / F.col("n_events") for k in kinds})


def inter_event_stats(events, keys, ts, tiebreak, hot_rows=None):
    """Mean, min, max, population sd and median of the seconds between neighbouring events."""
    scan = OrderedScan(events.select(*keys, ts, tiebreak), keys, [ts, tiebreak], hot_rows=hot_rows).add(_prev=lag(ts))
    gaps = scan.derive(gap_s=(micros(ts) - micros("_prev")) / 1000000.0).result().filter(F.col("gap_s").isNotNull())
    stats = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), F.avg("gap_s").alias("mean_gap"),
                                    F.min("gap_s").alias("min_gap"), F.max("gap_s").alias("max_gap"),
                                    F.stddev_pop("gap_s").alias("sd_gap"))
    return stats.join(percentiles(gaps, keys, "gap_s", [0.5], ["median_gap"], hot_rows=hot_rows), list(keys))


def event_bigrams(events, keys, order, event, hot_rows=None):
    """Counts of event -> next event transitions within the keys."""
    scan = OrderedScan(events, keys, order, hot_rows=hot_rows).add(_next=lead(event))
    pairs = scan.result().filter(F.col("_next").isNotNull())
    return pairs.groupBy(F.concat_ws(">", F.col(event), F.col("_next")).alias("bigram")).agg(F.count(F.lit(1)).alias("n"))


def bigram_features(events, keys, order, event, selected, hot_rows=None):
    """Per key, counts of the selected transitions as columns ``a_b``."""
    scan = OrderedScan(events, keys, order, hot_rows=hot_rows).add(_next=lead(event))
    return scan.result().groupBy(*keys).agg(
        *[F.count(F.when((F.col(event) == a) & (F.col("_next") == b), 1)).alias(f"{a}_{b}") for a, b in selected])


def first_position(events, keys, order, conditions, hot_rows=None):
    """1-based position of the first row meeting each condition."""
    scan = OrderedScan(events, keys, order, hot_rows=hot_rows).add(_pos=row_number())
    return scan.result().groupBy(*keys).agg(*[F.min(F.when(c, F.col("_pos"))).alias(f"pos_{n}") for n, c in conditions.items()])


def between_milestones(events, keys, ts, event, start, end, top=20, buckets=(1, 6, 24)):
    """Events strictly between the first ``start`` and the first later ``end`` milestone of each key.

    Returns (top events with share of events and of keys, distribution of hours between the milestones).
    """
    firsts = events.groupBy(*keys).agg(F.min(F.when(start, F.col(ts))).alias("_a"), F.min(F.when(end, F.col(ts))).alias("_b"))
    spans = firsts.filter(F.col("_a") < F.col("_b"))
    inside = spread_join(events, spans, keys, "inner").filter((F.col(ts) > F.col("_a")) & (F.col(ts) < F.col("_b")))
    counts = inside.groupBy(event, *keys).agg(F.count(F.lit(1)).alias("_n")).groupBy(event).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_keys"))
    sums = with_totals(with_totals(counts, inside.agg(F.count(F.lit(1)).alias("_ev"))), spans.agg(F.count(F.lit(1)).alias("_ks")))
    table = top_n(sums.select(event, F.col("n").cast("bigint").alias("n"), "n_keys", (F.col("n") / F.col("_ev")).alias("event_share"),
                              (F.col("n_keys") / F.col("_ks")).alias("key_share")), ["-n", event], top)
    hours = (micros("_b") - micros("_a")) / 3600000000.0
    label = classify([(hours < b, f"<{b}h") for b in buckets], f">={buckets[-1]}h")
    spread = share_of_total(spans.select(label.alias("bucket")), ["bucket"])
    return table, spread


def entities_by_outcome(sessions_events, session, entity, outcome, viewed):
    """Mean and maximum of distinct entities viewed per session, by session outcome."""
    per = sessions_events.groupBy(*session).agg(F.max(F.when(outcome, 1).otherwise(0)).alias("converted"),
                                                F.count_distinct(F.when(viewed, F.col(entity))).alias("_n"))
    return per.groupBy("converted").agg(F.count(F.lit(1)).alias("n_sessions"), F.avg("_n").alias("mean_entities"), F.max("_n").alias("max_entities"))


def funnel_anomalies(sessions_events, session, outcome, viewed):
    """Sessions that contradict the funnel: the outcome happened but nothing was viewed."""
    per = sessions_events.groupBy(*session).agg(F.count(F.when(outcome, 1)).alias("n_outcome"), F.count(F.when(viewed, 1)).alias("n_viewed"))
    return per.filter((F.col("n_outcome") > 0) & (F.col("n_viewed") == 0))


def error_rates(events, session, is_error):
    """Sessions, share with an error, mean and median errors per session."""
    per = events.groupBy(*session).agg(F.count(F.when(is_error, 1)).alias("_e"))
    median = percentiles(per, [], "_e", [0.5], ["median_errors"])
    base = per.agg(F.count(F.lit(1)).alias("n_sessions"), F.avg(F.when(F.col("_e") > 0, 1.0).otherwise(0.0)).alias("error_session_share"),
                   F.avg("_e").alias("mean_errors"))
    return with_totals(base, median)


def error_breakdown(events, is_error, by, within=()):
    return share_of_total(events.filter(is_error), by, within)


def daily_rollup(events, date, dims, aggs):
    """Daily aggregate table; write it with ``upsert_partition`` on the date."""
    return events.groupBy(date, *dims).agg(*[e.alias(n) for n, e in aggs.items()])


def stage_counts(events, by, entity, stages):
    return distinct_entities(events, by, entity, stages)
