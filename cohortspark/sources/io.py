"""Sources and sinks."""

import datetime as dt
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F, types as T

__all__ = [
    "lowercase_columns", "read_table", "read_csv", "write_table", "infer_ddl", "create_and_populate", "write_csv",
    "materialize", "upsert_partition", "update_from", "preview", "run_sql", "split_statements", "run_script", "lookup",
    "date_spine", "scratch_path",
]


def lowercase_columns(df):
    names = [c.lower() for c in df.columns]
    _reject_duplicates(names)
    return df.toDF(*names)


def _reject_duplicates(names):
    seen = set()
    clash = sorted({n for n in names if n.lower() in seen or seen.add(n.lower())})
    if clash:
        raise ValueError(f"duplicate column names: {clash}")


def read_table(spark, path_or_name, lower=True, fmt="parquet", **options):
    """Read a path (contains a slash or a file suffix) or a catalog table."""
    if "/" in path_or_name or path_or_name.endswith(f".{fmt}"):
        df = spark.read.format(fmt).options(**options).load(path_or_name)
    else:
        df = spark.read.table(path_or_name)
    return lowercase_columns(df) if lower else df


def read_csv(spark, path, schema=None):
    reader = spark.read.option("header", True)
    return lowercase_columns(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))


def _concrete(df):
    """A column of only NULLs has no storage type; it becomes a string."""
    nulls = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    return df.withColumns({n: F.col(n).cast("string") for n in nulls}) if nulls else df


def write_table(df, path_or_name, mode="error", partition_by=(), fmt="parquet"):
    _reject_duplicates(df.columns)
    writer = _concrete(df).write.format(fmt).mode(mode).partitionBy(*partition_by)
    writer.save(path_or_name) if "/" in path_or_name else writer.saveAsTable(path_or_name)


_DDL = {
    T.StringType: "STRING", T.ByteType: "BIGINT", T.ShortType: "BIGINT", T.IntegerType: "BIGINT", T.LongType: "BIGINT",
    T.FloatType: "DOUBLE", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP_NTZ", T.TimestampNTZType: "TIMESTAMP_NTZ", T.BinaryType: "BINARY",
}


def _ddl_type(data_type):
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    if isinstance(data_type, T.ArrayType):
        return f"ARRAY<{_ddl_type(data_type.elementType)}>"
    if isinstance(data_type, T.MapType):
        return f"MAP<{_ddl_type(data_type.keyType)}, {_ddl_type(data_type.valueType)}>"
    if isinstance(data_type, T.StructType):
        return "STRUCT<" + ", ".join(f"{f.name}: {_ddl_type(f.dataType)}" for f in data_type.fields) + ">"
    return _DDL.get(type(data_type), "STRING")


def infer_ddl(df, name):
    """CREATE TABLE text for the frame's schema; integers widen to BIGINT, unknown types fall back to STRING."""
    _reject_duplicates(df.columns)
    columns = ",\n".join(f"  `{f.name.lower()}` {_ddl_type(f.dataType)}" for f in df.schema.fields)
    return f"CREATE TABLE {name} (\n{columns}\n) USING parquet"


def scratch_path(spark, label):
    """New path under the cluster's shared ``spark.checkpoint.dir``. Only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cohortspark-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _save_as_table(df, name, path):
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def create_and_populate(df, name, path=None):
    """Replace the table: schema from ``infer_ddl``, rows cast to it; ``path`` makes it external."""
    spark = df.sparkSession
    frame = _concrete(lowercase_columns(df))
    casts = [F.col(f.name).cast(_ddl_type(f.dataType)).alias(f.name) for f in frame.schema.fields]
    _save_as_table(frame.select(*casts), name, path)
    return spark.read.table(name)


def write_csv(df, path, mode="overwrite", single_file=False):
    """CSV with a header. ``single_file`` is for result tables of report size only."""
    out = _concrete(df)
    (out.coalesce(1) if single_file else out).write.mode(mode).option("header", True).csv(path)


def materialize(df, name, kind="table", path=None):
    """CTAS table, temp view, or drop."""
    spark = df.sparkSession if isinstance(df, DataFrame) else df
    if kind == "drop":
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        return None
    if kind == "view":
        df.createOrReplaceTempView(name)
    else:
        _save_as_table(df, name, path)
    return spark.read.table(name)


#: rows of one file of a partitioned table
ROWS_PER_FILE = 4_000_000


def upsert_partition(df, path, part_col, rows_per_file=ROWS_PER_FILE):
    """Replace exactly the partitions present in ``df``; the others stay. Safe to repeat. A partition is written as so
    many files as its rows ask for, each by a task of its own."""
    spark = df.sparkSession
    parts = df.groupBy(F.col(part_col).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / F.lit(int(rows_per_file))).alias("_parts"))
    sized = df.join(parts, F.col(part_col).eqNullSafe(F.col("_key")), "left")
    dealt = sized.repartition(F.col(part_col), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_parts")))
    dealt.select(*df.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path)
    return spark.read.parquet(path)


def update_from(target, updates, keys, cols, condition=None, order=None):
    """UPDATE ... FROM: set ``cols`` on rows with a match in ``updates``.

    ``order`` names the columns that tell updates of one key apart: the last one wins (end it with a unique column).
    Without it a key may have several updates only if they set the same values; else the query fails.
    ``condition`` is an optional boolean over target columns and the new values named ``new_<col>``.
    """
    value = F.struct(*[F.col(c).alias(f"new_{c}") for c in cols])
    if order:
        latest = F.max_by(value, F.struct(*[F.col(c) for c in order]))
    else:
        clash = F.min(value) != F.max(value)
        latest = F.when(clash, F.raise_error(F.lit("several updates for one key: name an order"))).otherwise(F.max(value))
    new = updates.groupBy(*keys).agg(latest.alias("_new"))
    joined = target.join(new, list(keys), "left")
    joined = joined.select("*", *[F.col(f"_new.new_{c}").alias(f"new_{c}") for c in cols])
    hit = F.col("_new").isNotNull()
    if condition is not None:
        hit = hit & F.coalesce(condition, F.lit(False))
    changed = {c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c) if c in target.columns else F.lit(None)) for c in cols}
    order = list(target.columns) + [c for c in cols if c not in target.columns]
    return joined.withColumns(changed).select(*order)


def preview(df, n, order=None):
    return (df.orderBy(*order) if order else df).limit(n)


_PLACE = re.compile(r"\{\{\s*(\w+)\s*\}\}|(?<!\{)\{(\w+)\}(?!\})")


def run_sql(spark, template, params=None, **frames):
    """Run a template: ``{{name}}`` / ``{name}`` become named parameters, frames are referable by their keyword."""
    params = params or {}
    sql = _PLACE.sub(lambda m: f":{m.group(1) or m.group(2)}", template)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(sql, args=params)


def split_statements(text):
    """Split on semicolons that are outside quotes and comments."""
    token = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)
    parts, start = [], 0
    for m in token.finditer(text):
        if m.group() == ";":
            parts.append(text[start:m.start()])
            start = m.end()
    parts.append(text[start:])
    bare = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
    return [p.strip() for p in parts if bare.sub("", p).strip()]


def run_script(spark, text):
    """Run every statement in order and return the last result."""
    result = None
    for statement in split_statements(text):
        result = spark.sql(statement)
    return result


def lookup(spark, rows, schema):
    """Inline lookup table; its size is the literal's, so joining it by broadcast is safe."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def date_spine(spark, start, end, step="1 day"):
    """One row per step from start to end inclusive."""
    start, end = [d.isoformat() if isinstance(d, dt.date) else d for d in (start, end)]
    return spark.sql(
        f"SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE), INTERVAL {step})) AS day", args={"a": start, "b": end}
    )
