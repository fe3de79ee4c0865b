"""Window operators. Every ranking takes an explicit order; give it a unique last column."""

from pyspark.sql import Window, functions as F

from cohortspark.functions.exprs import md5_bucket64
from cohortspark.operators.joins import spread_join
from cohortspark.operators.ordered import (
    OrderedScan, bfill, ffill, key_sum, lag, row_number, running_sum, sort_columns, value_ranks,
)


def qualify(df, expr, predicate, name="_q"):
    """Filter on a window result: ``predicate`` receives the window column."""
    return df.withColumn(name, expr).filter(predicate(F.col(name))).drop(name)


def top_n_per(df, by, order, n, rank_name=None):
    """First n rows per group. Row-number filters are cut to n rows per input partition before the shuffle."""
    if not order:
        raise ValueError("top_n_per needs an order with a unique tiebreak")
    name = rank_name or "_rn"
    window = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*sort_columns(order))
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return out if rank_name else out.drop(name)


def first_per(df, keys, order):
    return top_n_per(df, keys, order, 1)


def ranks(df, by, value, descending=False, rank="rank", dense="dense_rank", hot_rows=None):
    """RANK and DENSE_RANK from the table of distinct values."""
    order = f"-{value}" if descending else value
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    scan = OrderedScan(counts, by, [order], hot_rows=hot_rows).add(**{"_upto": running_sum("_n"), dense: row_number()})
    table = scan.result().withColumn(rank, F.col("_upto") - F.col("_n") + 1).drop("_upto", "_n")
    return spread_join(df, table, list(by) + [value], hot_rows=hot_rows, null_safe=True)


def ntile_of(rn, total, n):
    """NTILE bucket of a 1-based row number."""
    base, extra = F.floor(total / n), total % n
    long = extra * (base + 1)
    return F.when(rn <= long, F.floor((rn - 1) / (base + 1)) + 1).otherwise(
        extra + F.floor((rn - 1 - long) / F.greatest(base, F.lit(1))) + 1).cast("int")


def ntile_bucket(df, order, n, by=(), name="bucket", hot_rows=None):
    """Exact NTILE over the whole table or per group."""
    order = [order] if isinstance(order, str) else list(order)
    scan = OrderedScan(df, list(by), order, hot_rows=hot_rows).add(_rn=row_number(), _all=key_sum(F.lit(1)))
    return scan.derive(**{name: ntile_of(F.col("_rn"), F.col("_all"), F.lit(n))}).result().drop("_rn", "_all")


def pct_rank(df, value, by=(), percent="percent_rank", cume="cume_dist", hot_rows=None):
    """PERCENT_RANK and CUME_DIST, ranked on distinct values and joined back. NULLs rank first, as one value."""
    keys = list(by) + [value]
    table = value_ranks(df, value, by, hot_rows=hot_rows, nulls=True)
    table = table.select(*keys,
                         F.when(F.col("_total") > 1, F.col("_before") / (F.col("_total") - 1)).otherwise(0.0).alias(percent),
                         (F.col("_upto") / F.col("_total")).alias(cume))
    return spread_join(df, table, keys, hot_rows=hot_rows, null_safe=True)


def lag_lead(df, keys, order, value, default=None, hot_rows=None):
    from cohortspark.operators.ordered import lead

    return OrderedScan(df, keys, order, hot_rows=hot_rows).add(
        **{f"prev_{value}": lag(value, default), f"next_{value}": lead(value, default)}).result()


def forward_fill(df, keys, order, cols, suffix="_filled", hot_rows=None):
    return OrderedScan(df, keys, order, hot_rows=hot_rows).add(**{f"{c}{suffix}": ffill(c) for c in cols}).result()


def backward_fill(df, keys, order, cols, suffix="_filled", hot_rows=None):
    return OrderedScan(df, keys, order, hot_rows=hot_rows).add(**{f"{c}{suffix}": bfill(c) for c in cols}).result()


def fill_by_rank(df, keys, order, value, rank, name, default=0, hot_rows=None):
    """Fill a NULL value from the previous known one if its rank >= mine, else from the next if its rank <= mine."""
    known = F.when(F.col(value).isNotNull(), F.col(rank))
    scan = OrderedScan(df, keys, order, hot_rows=hot_rows).derive(_kr=known)
    scan.add(_pv=ffill(value), _pr=ffill("_kr"), _nv=bfill(value), _nr=bfill("_kr"))
    pick = (F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_pr") >= F.col(rank), F.col("_pv"))
            .when(F.col("_nr") <= F.col(rank), F.col("_nv")).otherwise(F.lit(default)))
    return scan.derive(**{name: pick}).result().drop("_kr", "_pv", "_pr", "_nv", "_nr")


def over_partition(df, keys, aggs, hot_rows=None):
    """Unordered window aggregates as an aggregate joined back: a hot group is combined before it is shuffled, and its
    rows meet the result in many tasks."""
    table = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return spread_join(df, table, list(keys), hot_rows=hot_rows, null_safe=True)


def running_share(df, order, value, by=(), total="running_total", share="running_share", hot_rows=None):
    scan = OrderedScan(df, list(by), order, hot_rows=hot_rows).add(**{total: running_sum(value), "_all": key_sum(value)})
    return scan.derive(**{share: F.col(total) / F.nullif(F.col("_all"), F.lit(0))}).result().drop("_all")


def streaks(df, key, period, hot_rows=None):
    """Runs of consecutive integer periods per key: start, end and length."""
    distinct = df.select(*key, period).filter(F.col(period).isNotNull()).distinct()
    scan = OrderedScan(distinct, key, [period], hot_rows=hot_rows).add(_rn=row_number())
    island = scan.derive(_island=F.col(period) - F.col("_rn")).result()
    return island.groupBy(*key, "_island").agg(
        F.min(period).alias("start_period"), F.max(period).alias("end_period"), F.count(F.lit(1)).alias("length")).drop("_island")


def hash_order(key, seed):
    """Repeatable random order of a key: md5 of key and seed."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def random_decile(df, key, seed=0, n=10, name="decile", hot_rows=None):
    """Equal random tenths, repeatable for a seed."""
    keyed = df.withColumn("_ho", hash_order(key, seed))
    return ntile_bucket(keyed, ["_ho", key], n, name=name, hot_rows=hot_rows).drop("_ho")


def sample_per_group(df, group, n, key, seed=0):
    """n random rows per group by seeded hash order (the sampling operator: the limit is the feature)."""
    keyed = df.withColumn("_ho", hash_order(key, seed))
    return top_n_per(keyed, group, ["_ho", key], n).drop("_ho")


def in_fraction(key, fraction, seed=0):
    """Whether a key belongs to the sampled ``fraction``: its first 32 md5 bits are below that share of 2**32."""
    bits = 2**32
    return md5_bucket64(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)))) < int(round(fraction * bits))


def sample_fraction(df, key, fraction, seed=0):
    """About ``fraction`` of the keys (to 1 in 2**32), the same ones on every run."""
    return df.filter(in_fraction(key, fraction, seed))


def limit_dimension(df, dim, n, weight=None):
    """Keep rows of the n largest dimension values (by rows or weight, then by name)."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    kept = df.groupBy(dim).agg(size.alias("_s")).orderBy(F.desc("_s"), dim).limit(n).select(dim)
    return df.join(kept, dim, "left_semi")


def order_by_labels(df, column, labels):
    """Sort by a given label order; unknown labels come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(labels) + 1), column)


def top_n(df, order, n):
    return df.orderBy(*sort_columns(order)).limit(n)
