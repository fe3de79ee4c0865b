"""Aggregations. Everything pre-aggregates on the map side; exact quantiles never gather a group in one task."""

from functools import reduce

from pyspark.sql import functions as F

from cohortspark.functions.exprs import col
from cohortspark.operators.joins import with_totals
from cohortspark.operators.ordered import value_ranks, OrderedScan, row_number


def cond_agg(df, by, specs):
    """Conditional aggregates: ``{alias: (kind, value, condition)}``, kind = count, sum, avg, min, max, flag or share."""
    out = []
    for alias, (kind, value, condition) in specs.items():
        hit = condition if condition is not None else F.lit(True)
        if kind == "count":
            expr = F.count(F.when(hit, F.lit(1) if value is None else col(value)))
        elif kind == "flag":
            expr = F.coalesce(F.max(F.when(hit, 1)), F.lit(0)).cast("int")
        elif kind == "share":
            expr = F.avg(F.when(hit, 1.0).otherwise(0.0))
        else:
            expr = getattr(F, kind)(F.when(hit, col(value)))
        out.append(expr.alias(alias))
    return df.groupBy(*by).agg(*out)


def flags(df, by, conditions):
    """0/1 flag per condition: did any row of the group meet it."""
    return cond_agg(df, by, {name: ("flag", None, cond) for name, cond in conditions.items()})


def distinct_entities(df, by, entity, conditions):
    """Distinct entities per condition and group.

    Rows are first folded to one row of flags per (group, entity), so the many COUNT(DISTINCT CASE ...) of one report
    cost a single shuffle instead of one expansion each.
    """
    per_entity = df.filter(F.col(entity).isNotNull()).groupBy(*by, entity).agg(
        *[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()])
    return per_entity.groupBy(*by).agg(*[F.sum(n).cast("bigint").alias(n) for n in conditions])


def count_distinct_keys(df, by, cols, name="n"):
    """Distinct combinations of several columns; combinations with a NULL part are not counted."""
    whole = df.dropna(subset=list(cols)).select(*by, *cols).distinct()
    return whole.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def percentiles(df, by, value, probs, names=None, hot_rows=None):
    """Exact interpolated percentiles per group from the ordered table of distinct values."""
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    ranked = value_ranks(df, value, by, hot_rows=hot_rows)
    aggs, outs = [], []
    for p, name in zip(probs, names):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(place), F.ceil(place)
        aggs += [F.min(F.when(F.col("_upto") > low, F.col(value))).cast("double").alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_upto") > high, F.col(value))).cast("double").alias(f"_hi_{name}")]
        part = F.lit(float(p)) * (F.col("_n_all") - 1)
        part = part - F.floor(part)
        outs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part).alias(name))
    return ranked.groupBy(*by).agg(F.max("_total").alias("_n_all"), *aggs).select(*by, *outs)


def approx_percentiles(df, by, value, probs, accuracy=10000):
    return df.groupBy(*by).agg(*[F.percentile_approx(value, F.lit(p), F.lit(accuracy)).alias(f"p{int(round(p * 100))}")
                                 for p in probs])


def mode_of(df, by, value, name="mode"):
    """Most common value per group, the smallest one among equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def first_by(value, order, tiebreak):
    return F.min_by(value, F.struct(col(order), col(tiebreak)))


def last_by(value, order, tiebreak):
    return F.max_by(value, F.struct(col(order), col(tiebreak)))


def moments(df, by, x, y=None):
    """n, mean, var, var_pop, sd, sd_pop of x and, with y, the sample covariance."""
    out = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.var_pop(x).alias("var_pop"),
           F.stddev_samp(x).alias("sd"), F.stddev_pop(x).alias("sd_pop")]
    if y:
        out.append(F.covar_samp(x, y).alias("cov"))
    return df.groupBy(*by).agg(*out)


def list_values(df, by, value, sep=",", name="values"):
    """Distinct values, sorted, joined to one string (the values are de-duplicated before they meet)."""
    distinct = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("string").alias("_v"), F.col(value).alias("_o")).distinct()
    rows = F.array_sort(F.collect_list(F.struct("_o", "_v")))
    return distinct.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["_v"]), sep).alias(name))


def top_n_array(df, by, value, order, n, name="top"):
    """Array of the n best values per group, in order. ``order`` is a list of "-x"/"x" names with a unique tail."""
    from cohortspark.operators.windows import top_n_per

    best = top_n_per(df, by, order, n, rank_name="_rk")
    item = value if isinstance(value, str) else F.struct(*value)
    return best.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rk", F.col(item).alias("v") if isinstance(item, str) else item.alias("v")))),
        lambda r: r["v"]).alias(name))


def share_of_total(df, by, within=(), weight=None):
    """Rows (or summed weight) per group and their share of the whole or of the enclosing group."""
    n = (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")
    counts = df.groupBy(*by).agg(n)
    if within:
        totals = df.groupBy(*within).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_t"))
        counts = counts.join(totals, list(within))
    else:
        counts = with_totals(counts, df.agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_t")))
    return counts.withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def entropy(df, by, category, name="entropy"):
    """Shannon entropy (nats) of a category within each group."""
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("_n"))
    # sum p ln p = (sum n ln n) / N - ln N, so one pass over the counts is enough
    total = F.sum("_n")
    return counts.groupBy(*by).agg(
        F.greatest(F.lit(0.0), F.log(total) - F.sum(F.col("_n") * F.log("_n")) / total).alias(name),
        F.count(F.lit(1)).alias("n_categories"))


def arm_pivot(df, by, arm, arms, aggs):
    """One column per arm and aggregate: ``<arm>_<name>``; the arms are given, so no extra pass finds them."""
    frame = df.groupBy(*by).pivot(arm, list(arms)).agg(*[e.alias(n) for n, e in aggs.items()])
    if len(aggs) == 1:
        only = next(iter(aggs))
        frame = frame.select(*by, *[F.col(f"`{a}`").alias(f"{a}_{only}") for a in arms])
    return frame


def pivot_table(df, index, columns, values, value_col, agg="sum"):
    """``values`` lists the column labels to keep (pass ``pivot_values`` to derive them)."""
    frame = df.groupBy(*index).pivot(columns, values).agg(getattr(F, agg)(value_col))
    return frame


def unpivot(df, ids, values, variable="metric", value="value"):
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, variable, value)


def rollup_totals(df, dims, aggs, total_label="all"):
    """Group rows plus the totals row in one pass; a totals row carries ``total_label`` in every dimension."""
    grouped = df.groupingSets([[F.col(d) for d in dims], []], *dims).agg(
        *[e.alias(n) for n, e in aggs.items()], *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    labels = [F.when(F.col(f"_g_{d}") == 1, F.lit(total_label)).otherwise(F.col(d).cast("string")).alias(d) for d in dims]
    return grouped.select(*labels, *aggs)


def cut_report(df, arm, cuts, aggs):
    """Metrics by arm for each cut and overall, as (cut, cut_value) rows from one GROUPING SETS pass."""
    sets = [[F.col(arm)]] + [[F.col(arm), F.col(c)] for c in cuts]
    grouped = df.groupingSets(sets, arm, *cuts).agg(
        *[e.alias(n) for n, e in aggs.items()], *[F.grouping(c).alias(f"_g_{c}") for c in cuts])
    name, label = F.lit("overall"), F.lit("all")
    for c in cuts:
        name = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(name)
        label = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(label)
    return grouped.select(arm, name.alias("cut"), label.alias("cut_value"), *aggs)


def union_sources(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames):
    return union_sources(frames).distinct()


def numbered(df, order, name="rn"):
    return OrderedScan(df, [], order).add(**{name: row_number()}).result()
