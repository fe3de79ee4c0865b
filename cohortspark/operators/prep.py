"""Feature preparation."""

import math
import re

from pyspark.sql import functions as F

from cohortspark.operators.joins import spread_join
from cohortspark.operators.lineage import durable
from cohortspark.operators.ordered import OrderedScan, row_number, running_sum


def prepare_features(df, covariates, label, keep=()):
    """Cast to double, NULL to 0, drop covariates without variance. Returns (frame, kept names)."""
    as_num = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in covariates}
    row = df.agg(*[F.var_samp(e).alias(c) for c, e in as_num.items()]).first()
    kept = [c for c in covariates if (row[c] or 0.0) > 0.0]
    return df.select(*keep, *[as_num[c].alias(c) for c in kept], F.col(label).cast("double").alias(label)), kept


#: rank error of the first pass, as a share of the rows
_SKETCH = 10_000


def exact_quantiles(df, probs):
    """{column: {p: interpolated percentile}} for ``probs`` = {column: [p, ...]}, exact, NULLs left out (None if a column
    has no value). Three jobs, whatever the number of columns: a sketch of all columns brackets every percentile; one
    aggregate counts what lies below each bracket and finds its neighbours; the few values inside are counted and
    ordered. A bracket holds about ``4 / _SKETCH`` of the rows."""
    asked = [(i, c, j, p) for i, (c, ps) in enumerate(probs.items()) for j, p in enumerate(ps)]
    if not asked:
        return {}
    v = {c: F.col(c).cast("double") for c in probs}
    near = lambda p: sorted({min(max(p + d / _SKETCH, 0.0), 1.0) for d in (-2, 2)})
    first = df.agg(*[F.count(v[c]).alias(f"n{i}") for i, c in enumerate(probs)],
                   *[F.percentile_approx(v[c], [near(p)[0], near(p)[-1]], _SKETCH).alias(f"b{i}_{j}") for i, c, j, p in asked]).first()
    asked = [(i, c, j, p, *first[f"b{i}_{j}"]) for i, c, j, p in asked if first[f"n{i}"]]
    out = {c: dict.fromkeys(ps) for c, ps in probs.items()}
    if not asked:
        return out
    low, high = (lambda c, lo: v[c] < F.lit(lo)), (lambda c, hi: v[c] > F.lit(hi))
    second = df.agg(*[e for i, c, j, p, lo, hi in asked for e in (
        F.count(F.when(low(c, lo), 1)).alias(f"below{i}_{j}"), F.max(F.when(low(c, lo), v[c])).alias(f"prev{i}_{j}"), F.min(F.when(high(c, hi), v[c])).alias(f"next{i}_{j}"))]).first()
    inside = F.array_compact(F.array(*[F.when(v[c].isNotNull() & ~low(c, lo) & ~high(c, hi), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v[c].alias("v"))) for i, c, j, p, lo, hi in asked]))
    counts = df.select(F.explode(inside).alias("x")).groupBy("x.i", "x.j", "x.v").agg(F.count(F.lit(1)).alias("_k"))
    base = F.create_map(*[x for i, c, j, p, lo, hi in asked for x in (F.lit(f"{i}_{j}"), F.lit(second[f"below{i}_{j}"]))])
    place = F.create_map(*[x for i, c, j, p, lo, hi in asked for x in (F.lit(f"{i}_{j}"), F.lit(p * (first[f"n{i}"] - 1)))])
    key = F.concat_ws("_", "i", "j")
    ranked = OrderedScan(counts, ["i", "j"], ["v"]).add(_upto=running_sum("_k")).derive(_upto=F.col("_upto") + base[key], _at=place[key]).result()
    found = ranked.groupBy("i", "j").agg(*[F.min(F.when(F.col("_upto") > f("_at"), F.col("v"))).alias(n) for n, f in (("lo", F.floor), ("hi", F.ceil))], F.max("_upto").alias("_upto"))
    rows = {(r["i"], r["j"]): r for r in found.collect()}  # one row per percentile
    for i, c, j, p, _, _ in asked:
        at, r = p * (first[f"n{i}"] - 1), rows[i, j]
        prev, after = second[f"prev{i}_{j}"], second[f"next{i}_{j}"]
        if math.floor(at) < second[f"below{i}_{j}"] - 1 or math.ceil(at) > r["_upto"]:
            raise ValueError(f"the sketch of {c} is off by more than it may be")
        lo = prev if math.floor(at) < second[f"below{i}_{j}"] else after if r["lo"] is None else r["lo"]
        hi = prev if math.ceil(at) < second[f"below{i}_{j}"] else after if r["hi"] is None else r["hi"]
        out[c][p] = lo + (hi - lo) * (at - math.floor(at))
    return out


def modes(df, cols):
    """{column: most common value}, the smallest of equals, None without values: one job for all columns."""
    if not cols:
        return {}
    counts = df.groupingSets([[c] for c in cols], *cols).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_k"))
    ids = {c: (1 << len(cols)) - 1 - (1 << (len(cols) - 1 - i)) for i, c in enumerate(cols)}
    best = counts.agg(*[F.min_by(F.col(c), F.when((F.col("_g") == ids[c]) & F.col(c).isNotNull(), F.struct(-F.col("_k"), F.col(c)))).alias(c) for c in cols])
    return best.first().asDict()


def impute(df, policy):
    """Fill NULLs per column by ``zero``, ``max+1``, ``mean``, ``median``, ``mode``, ``Unknown`` or a literal ("=value").
    Columns of one policy are worked out together."""
    simple = {c: p for c, p in policy.items() if p in ("max+1", "mean")}
    fills = df.agg(*[(F.max(c) + 1 if p == "max+1" else F.avg(c)).alias(c) for c, p in simple.items()]).first().asDict() if simple else {}
    fills |= {c: found[0.5] for c, found in exact_quantiles(df, {c: [0.5] for c, p in policy.items() if p == "median"}).items()}
    fills |= modes(df, [c for c, p in policy.items() if p == "mode"])
    for c, p in policy.items():
        if p == "zero":
            fills[c] = 0
        elif p == "Unknown":
            fills[c] = "Unknown"
        elif p.startswith("="):
            fills[c] = p[1:]
    done = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fills.items() if v is not None}
    return df.withColumns(done)


def winsorize(df, cols, lo=0.01, hi=0.99):
    """Clip each column to its exact lo/hi percentiles. Returns (frame, report with bounds and clipped counts). Columns
    without values stay as they are."""
    found = exact_quantiles(df, {c: [lo, hi] for c in cols})
    bounds = {c: (q[lo], q[hi]) for c, q in found.items() if q[lo] is not None}
    counts = df.agg(F.lit(0), *[F.count(F.when(F.col(c) < b[0], 1)).alias(f"l_{c}") for c, b in bounds.items()],
                    *[F.count(F.when(F.col(c) > b[1], 1)).alias(f"h_{c}") for c, b in bounds.items()]).first()
    rows = [(c, *bounds[c], counts[f"l_{c}"], counts[f"h_{c}"]) if c in bounds else (c, None, None, 0, 0) for c in cols]
    report = df.sparkSession.createDataFrame(rows, "column string, low double, high double, n_low long, n_high long")
    clipped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(b[0])), F.lit(b[1]))) for c, b in bounds.items()}
    return df.withColumns(clipped) if clipped else df, report


def _slug(value):
    return re.sub(r"[^0-9a-zA-Z]+", "_", str(value)).strip("_").lower()


def category_levels(df, cols, max_levels=200):
    """Distinct non-NULL levels per column in sorted order; refuses columns that are not categorical."""
    levels = {}
    for c in cols:
        rows = df.select(F.col(c).cast("string").alias("v")).filter("v is not null").distinct().orderBy("v").limit(max_levels + 1).collect()
        if len(rows) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        levels[c] = [r.v for r in rows]
    return levels


def one_hot(df, cols, drop_first=True, levels=None):
    """0/1 indicator columns ``<col>_<level>``; the first level is the reference when ``drop_first``."""
    levels = levels or category_levels(df, cols)
    out = {}
    for c in cols:
        for v in levels[c][1 if drop_first else 0:]:
            out[f"{c}_{_slug(v)}"] = F.when(F.col(c).cast("string") == v, 1).otherwise(0)
    return df.withColumns(out)


def filter_covariates(columns, target, rules):
    """Drop covariates that leak a target: ``rules`` = {target pattern: [covariate patterns to drop]}."""
    banned = [p for t, patterns in rules.items() if re.search(t, target) for p in patterns]
    return [c for c in columns if c != target and not any(re.search(p, c) for p in banned)]


def fit_levels(df, cols):
    """{column: (level, number)} tables of the levels seen in training, numbered from 0 in text order. The tables stay in
    Spark, so a column may have any number of levels."""
    out = {}
    for c in cols:
        levels = df.select(F.col(c).cast("string").alias("level")).filter("level IS NOT NULL").distinct()
        out[c] = durable(OrderedScan(levels, [], ["level"]).add(_n=row_number()).result().select("level", (F.col("_n") - 1).cast("int").alias("number")))
    return out


def apply_levels(model, df, hot_rows=None):
    """Adds ``<col>_idx``; levels not seen in training, and NULL, get the number after the last."""
    for c, table in model.items():
        numbers = table.select(F.col("level").alias("_level"), F.col("number").alias(f"{c}_idx"))
        coded = spread_join(df.withColumn("_level", F.col(c).cast("string")), numbers, ["_level"], "left", hot_rows).drop("_level")
        unseen = table.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
        df = coded.withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", unseen))
    return df
