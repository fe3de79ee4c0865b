"""Data-quality and profiling reports: each is one aggregate, whatever the number of columns."""

from pyspark.sql import functions as F, types as T

from cohortspark.operators.aggs import unpivot


def duplicates(df, keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def summary_report(df, specs):
    """Long report; ``specs`` = {name: "rows" | ("distinct", col) | ("non_null", col) | aggregate Column}."""
    aggs = []
    for name, spec in specs.items():
        if isinstance(spec, str) and spec == "rows":
            expr = F.count(F.lit(1))
        elif isinstance(spec, tuple):
            expr = F.count_distinct(spec[1]) if spec[0] == "distinct" else F.count(spec[1])
        else:
            expr = spec
        aggs.append(expr.cast("double").alias(name))
    return unpivot(df.agg(*aggs), [], list(specs))


def missing_profile(df, columns=None):
    columns = columns or df.columns
    aggs = [F.count(F.lit(1)).cast("double").alias("_rows")]
    aggs += [(F.count(F.lit(1)) - F.count(c)).cast("double").alias(c) for c in columns]
    wide = df.agg(*aggs)
    long = wide.unpivot(["_rows"], list(columns), "column", "n_missing")
    return long.select("column", F.col("n_missing").cast("bigint").alias("n_missing"),
                       (F.col("n_missing") / F.nullif(F.col("_rows"), F.lit(0.0))).alias("missing_share"))


def infer_feature_types(df, columns=None, max_categories=20):
    """continuous / categorical / binary by type and approximate cardinality."""
    columns = columns or df.columns
    wide = df.agg(*[F.approx_count_distinct(c, 0.01).cast("double").alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "column", "n_distinct")
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    kind = (F.when(F.col("n_distinct") <= 2, "binary")
            .when(F.col("column").isin(numeric) & (F.col("n_distinct") > max_categories), "continuous")
            .otherwise("categorical"))
    return long.select("column", F.col("n_distinct").cast("bigint").alias("n_distinct"), kind.alias("kind"))


def filter_report(df, rules):
    """Rows each rule (name -> keep condition) removes, applied in order."""
    alive, aggs = F.lit(True), [F.count(F.lit(1)).cast("double").alias("input")]
    for name, keep in rules.items():
        ok = F.coalesce(keep, F.lit(False))
        aggs.append(F.count(F.when(alive & ~ok, 1)).cast("double").alias(f"removed_{name}"))
        alive = alive & ok
    aggs.append(F.count(F.when(alive, 1)).cast("double").alias("kept"))
    names = ["input"] + [f"removed_{n}" for n in rules] + ["kept"]
    return df.agg(*aggs).unpivot([], names, "step", "n").select("step", F.col("n").cast("bigint").alias("n"))


def apply_filters(df, rules):
    for keep in rules.values():
        df = df.filter(keep)
    return df


def target_summary(df, arm, targets):
    """Rows, positives, rate and spread of each target per arm."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for t in targets:
        aggs += [F.sum(F.col(t).cast("double")).alias(f"{t}_sum"), F.avg(F.col(t).cast("double")).alias(f"{t}_mean"),
                 F.stddev_samp(F.col(t).cast("double")).alias(f"{t}_sd")]
    wide = df.groupBy(arm).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_sum").alias("total"),
                                        F.col(f"{t}_mean").alias("mean"), F.col(f"{t}_sd").alias("sd")) for t in targets]))
    return wide.select(arm, F.col("_n").alias("n"), rows.alias("r")).select(arm, "n", "r.*")
