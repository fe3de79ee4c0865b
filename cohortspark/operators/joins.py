"""Enrichment, window, as-of, SCD, proximity and text joins. No operator here builds a Cartesian product."""

from functools import reduce

from pyspark.sql import functions as F, types as T

from cohortspark.functions.exprs import boundary_diff, classify, micros
from cohortspark.operators.lineage import durable
from cohortspark.operators.ordered import HOT_ROWS, OrderedScan, bfill, ffill, hot_keys, null_safe_join, running_max


def _list(keys):
    return [keys] if isinstance(keys, str) else list(keys)


# ---------------------------------------------------------------- equi joins


def natural_full_join(a, b):
    """Full outer join on every shared column name, keys coalesced."""
    shared = [c for c in a.columns if c in set(b.columns)]
    if not shared:
        raise ValueError("the frames share no column")
    return a.join(b, shared, "full")


def join_on_str(a, b, key_a, key_b, how="inner", hot_rows=None):
    """Equi join of ids of different types, compared as trimmed strings; b's key column is dropped. In inner and left
    joins the rows of a's hot ids meet b in many tasks."""
    left = a.withColumn("_k", F.trim(F.col(key_a).cast("string")))
    right = b.withColumn("_k", F.trim(F.col(key_b).cast("string"))).drop(key_b)
    joined = spread_join(left, right, ["_k"], how, hot_rows) if how in ("inner", "left") else left.join(right, "_k", how)
    return joined.drop("_k")


def semi_join(a, b, on):
    return a.join(b.select(*_list(on)), on, "left_semi")


def anti_join(a, b, on):
    return a.join(b.select(*_list(on)), on, "left_anti")


def with_totals(df, totals, prefix=""):
    """Attach a one-row totals frame as scalar subqueries: no join, no shuffle of ``df``."""
    whole = df.withColumn("_tot", totals.select(F.struct(*totals.columns)).scalar())
    return whole.select(*df.columns, *[F.col(f"_tot.{c}").alias(f"{prefix}{c}") for c in totals.columns])


def spine_cross(entities, start, end, name="day", step="INTERVAL 1 DAY"):
    """Entity x day spine, generated inside each row; start/end are dates or date columns."""
    as_date = lambda x: x if not isinstance(x, str) else F.lit(x).cast("date")
    return entities.withColumn(name, F.explode(F.sequence(as_date(start), as_date(end), F.expr(step))))


def _salted(big, small, keys, hot_rows=None):
    """Both sides with a ``_salt`` column: rows of big's hot keys are spread by a hash of the row over as many parts as
    their number asks for, and small repeats its rows of just those keys once per part. Without hot keys the sides come
    back as they are."""
    table = hot_keys(big, keys, hot_rows)
    if table is None:
        return big, small, list(keys)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    parts = table.select(*keys, F.ceil(F.lit(2) * F.col("_rows") / F.lit(max(1, limit))).cast("int").alias("_parts"))
    plain = [f.name for f in big.schema.fields if not isinstance(f.dataType, T.MapType)]
    salt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*plain), F.col("_parts")).cast("int"))
    big = null_safe_join(big, parts, keys).withColumn("_salt", salt).drop("_parts")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    small = null_safe_join(small, parts, keys).withColumn("_salt", F.explode(salts)).drop("_parts")
    return big, small, list(keys) + ["_salt"]


def spread_join(big, small, keys, how="left", hot_rows=None, null_safe=False):
    """Equi join of a large side to a side with few rows per key; hot keys of the large side meet in many tasks.
    ``null_safe``: NULL keys meet NULL keys."""
    b, s, on = _salted(big, small, _list(keys), hot_rows)
    return (null_safe_join(b, s, on, how) if null_safe else b.join(s, on, how)).drop("_salt")


# ---------------------------------------------------------------- time joins


def window_join(base, events, key, t0, ts, lo=0, hi=None, how="inner", include_lo=False, include_hi=True, hot_rows=None):
    """Events with t0+lo < ts <= t0+hi (seconds) on the same key.

    With both ends given the time is part of the equi key (buckets as wide as the window), so a key with many base
    rows and many events only meets itself inside two buckets; event rows of a hot key are spread over many tasks.
    Event columns other than the key are appended.
    """
    key = _list(key)
    extra = [c for c in events.columns if c not in key]
    clash = set(extra) & set(base.columns)
    if clash:
        raise ValueError(f"rename event columns {sorted(clash)}")
    start = micros(t0) + F.lit(int(lo * 1000000)) if lo is not None else None
    e, b, on = _salted(events, base, key, hot_rows)
    if lo is not None and hi is not None:
        width = max(1, int((hi - lo) * 1000000))
        stop = micros(t0) + F.lit(int(hi * 1000000))
        b = b.withColumn("_bucket", F.explode(F.sequence(F.floor(start / width), F.floor(stop / width))))
        e = e.withColumn("_bucket", F.floor(micros(ts) / width))
        on = on + ["_bucket"]
    joined = b.join(e, on, "inner")
    if lo is not None:
        joined = joined.filter((micros(ts) >= start) if include_lo else (micros(ts) > start))
    if hi is not None:
        stop = micros(t0) + F.lit(int(hi * 1000000))
        joined = joined.filter((micros(ts) <= stop) if include_hi else (micros(ts) < stop))
    joined = joined.select(*base.columns, *extra)
    if how == "inner":
        return joined
    hit = joined.select(*key, t0).distinct()
    return joined.unionByName(base.join(hit, key + [t0], "left_anti"), allowMissingColumns=True)


def lookback_join(base, events, key, t0, ts, days, gap_days=1, how="inner"):
    """Events between t0 - days and t0 - gap_days, both ends included (calendar days when t0 and ts are dates)."""
    return window_join(base, events, key, t0, ts, lo=-days * 86400, hi=-gap_days * 86400, how=how, include_lo=True)


def asof_prior(base, events, key, t, ts, cols, strict=True, tiebreak=(), prefix="prior_", hot_rows=None):
    """For each base row the latest event of the same key before t (``strict``) or up to t.

    Both sides are stacked and scanned once in time order, so nothing is paired up; ``tiebreak`` names event columns
    that settle equal event times (largest wins).
    """
    key, cols = _list(key), _list(cols)
    ties = [F.col(c) for c in tiebreak]
    event_rank, base_rank = (1, 0) if strict else (0, 1)
    marks = base.select(*key, F.col(t).alias("_t"), F.lit(base_rank).alias("_kind"), F.struct(*base.columns).alias("_row"))
    marks = marks.withColumns({f"_x{i}": F.lit(None).cast(events.schema[c].dataType) for i, c in enumerate(tiebreak)})
    marks = marks.withColumn("_rec", F.lit(None).cast(events.select(F.struct(*cols).alias("r")).schema["r"].dataType))
    recs = events.filter(F.col(ts).isNotNull()).select(
        *key, F.col(ts).alias("_t"), F.lit(event_rank).alias("_kind"),
        F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"),
        *[c.alias(f"_x{i}") for i, c in enumerate(ties)], F.struct(*cols).alias("_rec"))
    order = ["_t", "_kind"] + [f"_x{i}" for i in range(len(ties))]
    scan = OrderedScan(marks.unionByName(recs), key, order, hot_rows=hot_rows).add(_hit=ffill("_rec"))
    found = scan.result().filter(F.col("_row").isNotNull())
    return found.select("_row.*", *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in cols])


def scd_current(scd, start, end, as_of):
    """Rows valid on ``as_of`` (open end = still valid)."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return scd.filter((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day)))


def scd_asof(base, scd, key, t, start, end, cols, tiebreak=(), prefix="", hot_rows=None):
    """Record valid at t: t in [start, coalesce(end, infinity)]; among several the latest start wins.

    One scan finds the latest started record. Only where that one has already ended while an older record still runs
    (overlapping history) is the range join needed, for just those (key, t).
    """
    key, cols = _list(key), _list(cols)
    record = scd.select(*key, F.col(start).cast("timestamp_ntz").alias("_s"), F.col(end).cast("timestamp_ntz").alias("_e"),
                        *[F.col(c).alias(f"_v_{c}") for c in cols], *[F.col(c).alias(f"_y_{c}") for c in tiebreak])
    record = record.withColumn("_until", F.coalesce("_e", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")))
    values = ["_s", "_until"] + [f"_v_{c}" for c in cols]
    when = F.col(t).cast("timestamp_ntz")
    marks = base.select(*key, when.alias("_t"), F.lit(1).alias("_kind"), F.struct(*base.columns).alias("_row"))
    rec_type = record.select(F.struct(*values).alias("r")).schema["r"].dataType
    marks = marks.withColumns({"_rec": F.lit(None).cast(rec_type),
                               **{f"_y_{c}": F.lit(None).cast(scd.schema[c].dataType) for c in tiebreak}})
    recs = record.select(*key, F.col("_s").alias("_t"), F.lit(0).alias("_kind"),
                         F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"),
                         F.struct(*values).alias("_rec"), *[f"_y_{c}" for c in tiebreak])
    order = ["_t", "_kind"] + [f"_y_{c}" for c in tiebreak]
    scan = OrderedScan(marks.unionByName(recs), key, order, hot_rows=hot_rows)
    found = scan.add(_hit=ffill("_rec"), _reach=running_max(F.col("_rec._until"))).result()
    found = found.filter(F.col("_row").isNotNull())
    covers = F.coalesce(F.col("_hit._until") >= F.col("_t"), F.lit(False))
    older = found.filter(~covers & (F.col("_reach") >= F.col("_t"))).select(*key, "_t").distinct()
    rank = F.struct("_s", *[f"_y_{c}" for c in tiebreak])
    rescued = (
        older.join(record, key).filter((F.col("_s") <= F.col("_t")) & (F.col("_t") <= F.col("_until")))
        .groupBy(*key, "_t").agg(F.max_by(F.struct(*values), rank).alias("_old"))
    )
    out = found.join(rescued, key + ["_t"], "left")
    pick = F.when(covers, F.col("_hit")).otherwise(F.col("_old"))
    out = out.withColumn("_pick", pick)
    return out.select("_row.*", *[F.col(f"_pick._v_{c}").alias(f"{prefix}{c}") for c in cols])


def proximity_join(a, b, key, ta, tb, tol_minutes, how="inner"):
    """Pairs of one key at most ``tol_minutes`` minute boundaries apart, either way round."""
    reach = (tol_minutes + 1) * 60
    near = window_join(a, b, key, ta, tb, lo=-reach, hi=reach, include_lo=True)
    near = near.filter(F.abs(boundary_diff("MINUTE", ta, tb)) <= tol_minutes)
    if how == "inner":
        return near
    keys = _list(key) + [ta]
    return near.unionByName(a.join(near.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def nearest_in_time(a, b, key, ta, tb, tol_minutes, cols, tiebreak):
    """The single nearest b row per a row within the tolerance, by scans in both directions."""
    key, cols = _list(key), _list(cols)
    rec = F.struct(F.col(tb).alias("_tb"), *[F.col(c) for c in cols])
    best = b.groupBy(*key, F.col(tb).alias("_t")).agg(F.min_by(rec, F.col(tiebreak)).alias("_rec"))
    marks = a.select(*key, F.col(ta).alias("_t"), F.lit(1).alias("_kind"), F.struct(*a.columns).alias("_row"))
    marks = marks.withColumn("_rec", F.lit(None).cast(best.schema["_rec"].dataType))
    recs = best.select(*key, "_t", F.lit(0).alias("_kind"), F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"), "_rec")
    scan = OrderedScan(marks.unionByName(recs), key, ["_t", "_kind"]).add(_p=ffill("_rec"), _n=bfill("_rec"))
    out = scan.result().filter(F.col("_row").isNotNull())
    gap_p, gap_n = micros("_t") - micros("_p._tb"), micros("_n._tb") - micros("_t")
    pick = F.when(gap_n.isNull() | (gap_p <= gap_n), F.col("_p")).otherwise(F.col("_n"))
    out = out.withColumn("_pick", pick)
    ok = F.abs(boundary_diff("MINUTE", F.col("_t"), F.col("_pick._tb"))) <= tol_minutes
    out = out.withColumn("_pick", F.when(ok, F.col("_pick")))
    return out.select("_row.*", *[F.col(f"_pick.{c}").alias(f"near_{c}") for c in cols])


def nearest_value_join(a, b, va, vb, id_b, max_gap=None, hot_rows=None):
    """Nearest b per a row by numeric value, all rows of a kept: one ordered scan, no pairs.

    Ties go to the lower value, then to the lowest id. Candidate b rows are first reduced to one per distinct value.
    """
    best = b.filter(F.col(vb).isNotNull()).groupBy(F.col(vb).alias("_t")).agg(F.min(id_b).alias("_id"))
    best = best.select("_t", F.lit(0).alias("_kind"), F.struct(F.col("_t").alias("v"), F.col("_id").alias("id")).alias("_rec"))
    marks = a.select(F.col(va).alias("_t"), F.lit(1).alias("_kind"), F.struct(*a.columns).alias("_row"))
    marks = marks.withColumn("_rec", F.lit(None).cast(best.schema["_rec"].dataType))
    recs = best.withColumn("_row", F.lit(None).cast(marks.schema["_row"].dataType))
    scan = OrderedScan(marks.unionByName(recs), [], ["_t", "_kind"], hot_rows=hot_rows)
    out = scan.add(_p=ffill("_rec"), _n=bfill("_rec")).result().filter(F.col("_row").isNotNull())
    gap_p, gap_n = F.col("_t") - F.col("_p.v"), F.col("_n.v") - F.col("_t")
    pick = F.when(gap_n.isNull() | (gap_p <= gap_n), F.col("_p")).otherwise(F.col("_n"))
    out = out.withColumn("_pick", pick).withColumn("_gap", F.abs(F.col("_t") - F.col("_pick.v")))
    if max_gap is not None:
        limit = max_gap if not isinstance(max_gap, (int, float)) else F.lit(float(max_gap))
        out = out.withColumn("_pick", F.when(F.col("_gap") <= limit, F.col("_pick")))
    return out.select("_row.*", F.col("_pick.id").alias("match_id"), F.col("_pick.v").alias("match_value"),
                      F.when(F.col("_pick").isNotNull(), F.col("_gap")).alias("match_gap"))


def self_prior_join(df, key, ts, cols, tiebreak, prefix="prior_", hot_rows=None):
    """Each row with the previous row of its key: a window lag in place of a self join."""
    from cohortspark.operators.ordered import lag

    scan = OrderedScan(df, _list(key), [ts, tiebreak], hot_rows=hot_rows)
    return scan.add(**{f"{prefix}{c}": lag(c) for c in _list(cols)}).result()


def device_user_map(events, device, user, ts):
    """Device-user edges with first/last time and rows, and for each device its number of users and latest user."""
    edges = events.filter(F.col(device).isNotNull() & F.col(user).isNotNull()).groupBy(device, user).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n_events"))
    return edges.groupBy(device).agg(
        F.count(F.lit(1)).alias("n_users"), F.max_by(user, F.struct("last_seen", user)).alias("latest_user"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n_events").alias("n_events"))


# ---------------------------------------------------------------- text joins

#: lengths of the blocks texts are cut into; a pattern uses the longest it is sure to cover
_BLOCKS = (12, 6, 3, 2)


def contains_join(a, b, id_a, col_a, col_b):
    """Rows of a whose text contains (any letter case) the text of some row of b.

    Texts are cut into blocks of n characters. Wherever a pattern of 2n - 1 or more characters occurs, some of its grams
    of n characters are whole blocks: all those at places of one remainder modulo n. So for every remainder the pattern
    is indexed by the gram there that the fewest texts hold, or not at all if no text holds one of them. Only texts that
    hold such a gram are searched for the whole pattern. Patterns of one or two characters, which are at most as many as
    pairs of letters, are searched in every text.
    """
    pats = b.select(F.lower(F.col(col_b)).alias("_p")).filter(F.col("_p").isNotNull()).distinct()
    size = F.length("_p")
    pats = durable(pats.withColumns({"_pid": F.monotonically_increasing_id(), "_n": classify([(size >= 2 * n - 1, n) for n in _BLOCKS], 0)}))
    kinds = {r["_n"]: r["least"] for r in pats.groupBy("_n").agg(F.min(size).alias("least")).collect()}  # one row per block length
    if not kinds:
        return a.limit(0)
    if kinds.get(0) == 0:  # the empty text is in every text
        return a.filter(F.col(col_a).isNotNull())
    texts = a.select(F.col(id_a).alias("_id"), F.lower(F.col(col_a)).alias("_t")).filter(F.col("_t").isNotNull())
    hits = None
    if 0 in kinds:
        short = pats.filter("_n = 0").agg(F.collect_list("_p").alias("s")).scalar()
        hits = texts.withColumn("_short", short).filter(F.exists("_short", lambda p: F.contains(F.col("_t"), p))).select("_id")
    kinds = [n for n in kinds if n]
    if kinds:
        places = F.transform(F.sequence(F.lit(0), size - F.col("_n")), lambda i: F.struct(i.alias("i"), F.xxhash64(F.col("_n"), F.col("_p").substr(i + 1, F.col("_n"))).alias("g")))
        grams = pats.filter("_n > 0").select("_pid", "_n", F.explode(places).alias("x"))
        grams = durable(grams.select("_pid", "x.i", F.col("x.g").alias("_g"), (F.col("x.i") % F.col("_n")).alias("_rest")))
        cuts = [texts.select("_id", F.explode(F.regexp_extract_all("_t", F.lit(f"(?s).{{{n}}}"), F.lit(0))).alias("_b")).select("_id", F.xxhash64(F.lit(n), "_b").alias("_g")) for n in kinds]
        held = reduce(lambda x, y: x.unionByName(y), cuts)
        held = durable(held.join(grams.select("_g").distinct(), "_g").distinct())
        spread = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_texts"))
        ranked = grams.join(spread, "_g", "left").withColumn("_texts", F.coalesce("_texts", F.lit(0)))
        index = ranked.groupBy("_pid", "_rest").agg(F.min(F.struct("_texts", "i", "_g")).alias("_r")).filter("_r._texts > 0")
        found = held.join(index.select("_pid", F.col("_r._g").alias("_g")), "_g").select("_id", "_pid").distinct()
        found = found.join(pats.select("_pid", "_p"), "_pid").join(texts, "_id").filter(F.contains("_t", "_p")).select("_id")
        hits = found if hits is None else hits.unionByName(found)
    return a.join(hits.select(F.col("_id").alias(id_a)).distinct(), id_a, "left_semi")


# Fixed value: a character no text has a use for marks what is taken.
_TAKEN = "\uffff"


def _chars(text):
    return F.filter(F.split(text, ""), lambda c: c != "")


def jaro_winkler(a, b):
    """Jaro-Winkler similarity as a whole number 0..100 (prefix weight 0.1, up to 4 characters, for Jaro above 0.7), as
    one column expression. NULL if a text is NULL."""
    s, t = _column(a), _column(b)
    n, m = F.length(s), F.length(t)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2) - 1, F.lit(0)).cast("int")

    def take(acc, ch):
        # the first free equal character within reach; it is struck out in the rest of the text
        low = F.greatest(acc["i"] - reach, F.lit(1))
        at = F.instr(acc["free"].substr(low, acc["i"] + reach - low + 1), ch)
        place = low + at - 1
        free = F.when(at > 0, F.concat(acc["free"].substr(F.lit(1), place - 1), F.lit(_TAKEN), acc["free"].substr(place + 1, m))).otherwise(acc["free"])
        return F.struct(free.alias("free"), F.when(at > 0, F.concat(acc["seq"], ch)).otherwise(acc["seq"]).alias("seq"), (acc["i"] + 1).alias("i"))

    start = F.struct(t.alias("free"), F.lit("").alias("seq"), F.lit(1).alias("i"))
    same = [F.least(n, m) >= k for k in range(1, 5)]
    for k in range(4):
        same[k] = same[k] & (s.substr(1, k + 1) == t.substr(1, k + 1))
    prefix = sum((F.when(x, 1).otherwise(0) for x in same), F.lit(0))

    def value(r):
        hits = F.length(r["seq"])
        other = F.filter(_chars(t), lambda c, i: r["free"].substr(i + 1, F.lit(1)) == F.lit(_TAKEN))
        swaps = F.floor(F.size(F.filter(F.zip_with(_chars(r["seq"]), other, lambda x, y: x != y), lambda d: d)) / 2)
        jaro = F.when(hits == 0, 0.0).otherwise((hits / n + hits / m + (hits - swaps) / hits) / 3.0)
        jaro = F.when((n == 0) & (m == 0), 1.0).otherwise(jaro)
        return F.floor(F.when(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro)).otherwise(jaro) * 100 + 0.5).cast("long")

    return F.when(s.isNotNull() & t.isNotNull(), F.transform(F.array(F.aggregate(_chars(s), start, take)), value)[0])


def _column(x):
    return F.col(x) if isinstance(x, str) else x


# Letters from rare to common, so that shared rare letters decide first.
_COMMON_LAST = "zqxjkvbpygfwmucldrhsnioate "


def _signatures(df, name, mine, longest, tau):
    """One row per key of a text; mine is the side (0 or 1) whose length comes first in the pair of lengths.

    For every common beginning of l = 0..4 characters a score of tau asks for a Jaro of (tau - l / 10) / (1 - l / 10),
    hence for so many shared characters given both lengths. Texts that share m characters share the q first of them, in
    one order of all characters, within their first (length - m + q): any q of those are a key, with the beginning and
    both lengths. Where the character occurs once, its place goes along.
    """
    n = F.col(f"{name}_n")
    out = None
    for beginning in range(5):
        jaro = tau if tau <= 0.7 else max(0.7, (tau - 0.1 * beginning) / (1 - 0.1 * beginning))
        need = 3.0 * jaro - 1.0  # shared / own length + shared / other length
        low = F.ceil(n * F.lit(need - 1.0) - F.lit(1e-9)) if need > 1 else F.lit(1)
        high = F.least(F.floor(n / F.lit(need - 1.0) + F.lit(1e-9)), longest) if need > 1.0001 else longest
        low = F.greatest(low, F.lit(max(1, beginning))).cast("int")
        keys = df.filter((n >= beginning) & (low <= high)).withColumn("_m", F.explode(F.sequence(low, high.cast("int"))))
        shared = F.greatest(F.ceil(F.lit(need) / (F.lit(1.0) / n + F.lit(1.0) / F.col("_m")) - F.lit(1e-9)), F.lit(1)).cast("int")
        keys = keys.withColumn("_shared", shared).filter(F.col("_shared") <= F.least(n, F.col("_m")))
        keys = keys.withColumn("_q", F.least(F.lit(3 if beginning == 0 else 2), F.col("_shared")))
        keys = keys.withColumn("_first", F.slice(f"{name}_tok", F.lit(1), n - F.col("_shared") + F.col("_q")))
        rest = lambda i: F.slice("_first", i + 2, F.size("_first"))
        ones = F.transform("_first", lambda x: F.array(x))
        twos = F.flatten(F.transform("_first", lambda x, i: F.transform(rest(i), lambda y: F.array(x, y))))
        threes = F.flatten(F.transform("_first", lambda x, i: F.flatten(F.transform(rest(i), lambda y, j: F.transform(F.slice("_first", i + j + 3, F.size("_first")), lambda z: F.array(x, y, z))))))
        sets = F.when(F.col("_q") == 1, ones).when(F.col("_q") == 2, twos).otherwise(threes)
        lengths = (n, F.col("_m")) if mine == 0 else (F.col("_m"), n)
        keys = keys.withColumn("_set", F.explode(sets))
        key = F.xxhash64(F.lit(beginning), F.col(name).substr(1, beginning), *[x.cast("int") for x in lengths], F.transform("_set", lambda x: x["t"]))
        keys = keys.select(name, key.alias("_key"), F.transform("_set", lambda x: x["p"]).alias(f"{name}_at"), F.greatest(F.floor(F.greatest(*lengths) / 2) - 1, F.lit(0)).alias("_reach"))
        out = keys if out is None else out.unionByName(keys)
    return out


def fuzzy_candidates(a, b, col_a, col_b, threshold=90):
    """Pairs (_a, _b) of distinct lower-case texts that can reach the threshold; none that does is missed."""
    tau = (threshold - 0.5) / 100.0
    if tau <= 0:
        raise ValueError("the threshold must be positive")

    def bag(df, column, name):
        text = df.select(F.lower(F.col(column)).alias(name)).filter(F.length(name) > 0).distinct()
        chars = _chars(F.col(name))
        count = lambda c: F.size(F.filter(chars, lambda d: d == c))
        # (character and which of its occurrences, place if it is the only one), rare characters first
        coded = F.transform(chars, lambda c, i: F.struct(
            F.concat(F.lpad(F.instr(F.lit(_COMMON_LAST), c).cast("string"), 2, "0"), c, F.lit("#"), F.lpad(F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string"), 6, "0")).alias("t"),
            F.when(count(c) == 1, i).alias("p")))
        return text.select(name, F.length(name).alias(f"{name}_n"), F.array_sort(coded).alias(f"{name}_tok"))

    left, right = durable(bag(a, col_a, "_a")), durable(bag(b, col_b, "_b"))
    longest = [F.lit(x.agg(F.max(f"{n}_n").alias("n")).first()["n"] or 0) for x, n in ((left, "_a"), (right, "_b"))]
    pairs = _signatures(left, "_a", 0, longest[1], tau).join(_signatures(right, "_b", 1, longest[0], tau).drop("_reach"), "_key")
    near = F.forall(F.zip_with("_a_at", "_b_at", lambda x, y: F.abs(x - y)), lambda d: d.isNull() | (d <= F.col("_reach")))
    return pairs.filter(near).select("_a", "_b").distinct()


def fuzzy_join(a, b, col_a, col_b, threshold=90, score="similarity"):
    """Pairs of distinct lower-case texts with Jaro-Winkler >= threshold, joined to both sides."""
    pairs = fuzzy_candidates(a, b, col_a, col_b, threshold).withColumn(score, jaro_winkler("_a", "_b")).filter(F.col(score) >= threshold)
    out = a.withColumn("_a", F.lower(F.col(col_a))).join(pairs, "_a")
    return out.join(b.withColumn("_b", F.lower(F.col(col_b))), "_b").drop("_a", "_b")
