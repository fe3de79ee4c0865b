"""Registry of queries over the given tables, each with the SQL another engine can check it by."""

from pyspark.sql import functions as F

from cohortspark.sources.io import read_table

QUERIES = {}
ORACLES = {}


class Tables:
    """Access to the tables of one folder: ``t("events")``."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name):
        return read_table(self.spark, f"{self.folder}/{name}.parquet")


def rounded(df, names, digits):
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names}) if names else df


def q(name, build, sql=None, floats="", digits=6):
    """Register a query. ``floats`` lists the result columns both engines round to ``digits``."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    names = floats.split()

    def run(spark, folder):
        return rounded(build(Tables(spark, folder)), names, digits)

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        text = sql.strip()
        if names:
            swaps = ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)
            text = f"SELECT * REPLACE ({swaps}) FROM ({text}) AS report"
        ORACLES[name] = text
