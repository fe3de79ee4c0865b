"""Window scans that survive hot keys and whole-table orders.

``OrderedScan`` gives the usual window results (lag, fill, running totals, row number) per key. A key whose rows fit one
task uses a plain Spark window. Keys with more rows, any number of them, and orders over a whole table are dealt by
ranges of (key, all order columns) with ``repartitionByRange`` and sorted inside each range; runs of consecutive rows of a
range are its cells. Tasks and files are as many as a shuffle has, whatever the number of cells. Rows are windowed
inside (key, cell), and what must cross a cell border comes from a carry table with one row per (key, cell), joined on
both. No border is searched, nothing is capped, and no row is dropped or sampled.
"""

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Window, functions as F

from cohortspark.operators.lineage import durable

#: rows one task may hold in a single window partition
HOT_ROWS = 4_000_000


def _name(order):
    return order.lstrip("-")


def sort_columns(order, reverse=False):
    """``"-x"`` sorts descending with NULLs last, ``"x"`` ascending with NULLs first; ``reverse`` is the exact opposite."""
    return [F.col(_name(o)).desc_nulls_last() if o.startswith("-") != reverse else F.col(_name(o)).asc_nulls_first() for o in order]


def key_hash(keys):
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df, keys, hot_rows=None):
    """Table of the keys with more than ``hot_rows`` rows: the key columns, ``_rows``, and ``_kid``, a number per key.

    None if there is no such key. It has at most one row per ``hot_rows`` rows of ``df``; keys are only counted where the
    frame has more rows than that, and counts are combined before they are shuffled."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if df.select(F.lit(1)).count() <= hot_rows:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > int(hot_rows))
    table = durable(counts.withColumn("_kid", F.monotonically_increasing_id()))
    return None if table.isEmpty() else table


def hot_hashes(df, keys, hot_rows=None):
    """Hashes of the keys with more than ``hot_rows`` rows."""
    table = hot_keys(df, keys, hot_rows)
    return [] if table is None else [r["h"] for r in table.select(key_hash(keys).alias("h")).collect()]


def null_safe_join(df, table, keys, how="left"):
    """Equi join in which NULL keys meet NULL keys; the table's key columns are dropped."""
    renamed = table.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_j_{k}"))
        on = same if on is None else on & same
    return df.join(renamed, on, how).drop(*[f"_j_{k}" for k in keys])


@dataclass
class _Op:
    kind: str
    value: Any = None
    default: Any = None


def row_number():
    return _Op("row_number")


def running_sum(value):
    return _Op("running_sum", value)


def running_max(value):
    return _Op("running_max", value)


def running_min(value):
    return _Op("running_min", value)


def lag(value, default=None):
    return _Op("lag", value, default)


def lead(value, default=None):
    return _Op("lead", value, default)


def ffill(value, strict=False):
    """Last non-NULL value up to the current row (``strict``: before it)."""
    return _Op("ffill_strict" if strict else "ffill", value)


def bfill(value, strict=False):
    return _Op("bfill_strict" if strict else "bfill", value)


def key_sum(value):
    return _Op("key_sum", value)


def key_max(value):
    return _Op("key_max", value)


def key_min(value):
    return _Op("key_min", value)


_ABOVE, _BELOW = "_cell_above", "_cell_below"
_IDS = ["_kid", "_cell"]


class OrderedScan:
    """Add window results to ``df`` step by step: ``scan.add(prev=lag("ts")).derive(gap=...).add(n=running_sum("gap"))``.

    ``order`` must be unique within a key for repeatable results, so give a tiebreak column. A key that holds more than
    ``hot_rows`` rows is cut into cells of about half as many.
    """

    def __init__(self, df, keys, order, hot_rows=None):
        self.keys, self.order = list(keys), list(order)
        if not self.order:
            raise ValueError("an ordered scan needs an order")
        self.hot_rows = HOT_ROWS if hot_rows is None else hot_rows
        self.columns = df.columns
        self.plain, self.cut = df, None
        if self.keys:
            table = hot_keys(df, self.keys, self.hot_rows)
            if table is not None:
                marked = null_safe_join(df, table.drop("_rows"), self.keys)
                self.plain = marked.filter(F.col("_kid").isNull()).drop("_kid")
                rows = table.agg(F.sum("_rows").alias("n")).first()["n"]
                self.cut = self._cells(marked.filter(F.col("_kid").isNotNull()), rows)
        else:
            rows = df.select(F.lit(1)).count()
            if rows > self.hot_rows:
                self.plain, self.cut = None, self._cells(df.withColumn("_kid", F.lit(0).cast("bigint")), rows)

    @property
    def split(self):
        return self.cut is not None

    @property
    def df(self):
        """The rows with the results so far; where keys were cut, with the number of each row's cell (-1: not cut)."""
        if not self.split:
            return self.plain
        cut = self.cut.drop("_kid")
        return cut if self.plain is None else self.plain.withColumn("_cell", F.lit(-1).cast("bigint")).unionByName(cut)

    def _cells(self, rows, count):
        """Rows with their cell, a run of at most half of ``hot_rows`` rows in the order of (key, order columns); its number
        is that of its first row. Written out, because every later step must see the same cells.

        A range holds many cells: with a task and a file per cell the driver would hear of each of them."""
        half = max(1, int(self.hot_rows) // 2)
        shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(2, min(-(-count // half), max(shuffled, -(-2 * count // HOT_ROWS))))
        by = [F.col("_kid").asc(), *sort_columns(self.order)]
        number = F.monotonically_increasing_id()  # the range's number, and below it 33 bits of the row's number inside
        dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_cell", number)
        return durable(dealt.withColumn("_cell", F.col("_cell") - F.col("_cell").bitwiseAND(2**33 - 1) % half))

    # ------------------------------------------------------------ windows

    def _inside(self, op, by, split):
        """The op within one window partition."""
        whole = Window.partitionBy(*(by or [F.lit(1)]))  # without keys: at most hot_rows rows
        ordered = whole.orderBy(*sort_columns(self.order))
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        value = op.value if not isinstance(op.value, str) else F.col(op.value)
        if op.kind == "row_number":
            return F.row_number().over(ordered).cast("bigint")
        if op.kind.startswith("running_"):
            return getattr(F, op.kind[8:])(value).over(upto)
        if op.kind.startswith("key_"):
            return getattr(F, op.kind[4:])(value).over(whole)
        if op.kind == "lag":
            return F.lag(value, 1, None if split else op.default).over(ordered)
        if op.kind == "lead":
            return F.lead(value, 1, None if split else op.default).over(ordered)
        # a frame that ends at UNBOUNDED FOLLOWING is re-read for every row, so backward fills run in reverse order
        frame = (Window.unboundedPreceding, -1 if op.kind.endswith("strict") else Window.currentRow)
        if op.kind.startswith("bfill"):
            ordered = whole.orderBy(*sort_columns(self.order, reverse=True))
        return F.last(value, ignorenulls=True).over(ordered.rowsBetween(*frame))

    _COMBINE = {
        "row_number": (_ABOVE, "sum"), "running_sum": (_ABOVE, "sum"), "running_max": (_ABOVE, "max"),
        "running_min": (_ABOVE, "min"), "lag": (_ABOVE, "last"), "lead": (_BELOW, "last"),
        "ffill": (_ABOVE, "last"), "ffill_strict": (_ABOVE, "last"), "bfill": (_BELOW, "last"),
        "bfill_strict": (_BELOW, "last"), "key_sum": ("_all", "sum"), "key_max": ("_all", "max"), "key_min": ("_all", "min"),
    }

    def _carry(self, ops):
        """One row per (key, cell): what the cell needs from the key's cells before and after it."""
        ranked = Window.partitionBy(*_IDS).orderBy(*sort_columns(self.order))
        values = {n: (F.lit(1) if op.kind == "row_number" else F.col(op.value) if isinstance(op.value, str) else op.value)
                  for n, op in ops.items()}
        hot = self.cut.select(*_IDS, F.row_number().over(ranked).alias("_rn"),
                              *[v.alias(f"_v_{n}") for n, v in values.items()])
        aggs = []
        for n, op in ops.items():
            v, kind = F.col(f"_v_{n}"), op.kind
            boxed, present = F.struct(v.alias("x")), F.lit(True)
            if kind.startswith(("ffill", "bfill")):
                present = v.isNotNull()
            if kind == "lag" or kind.startswith("ffill"):
                aggs.append(F.max_by(F.when(present, boxed), F.when(present, F.col("_rn"))).alias(f"_s_{n}"))
            elif kind == "lead" or kind.startswith("bfill"):
                aggs.append(F.min_by(F.when(present, boxed), F.when(present, F.col("_rn"))).alias(f"_s_{n}"))
            else:
                aggs.append(getattr(F, self._COMBINE[kind][1])(v).alias(f"_s_{n}"))
        summary = hot.groupBy(*_IDS).agg(*aggs)
        by = Window.partitionBy("_kid")
        above = by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        below = by.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
        frames = {_ABOVE: above, _BELOW: below, "_all": by}
        cols = []
        for n, op in ops.items():
            side, fold = self._COMBINE[op.kind]
            s = F.col(f"_s_{n}")
            folded = F.last(s, ignorenulls=True) if fold == "last" else getattr(F, fold)(s)
            cols.append(folded.over(frames[side]).alias(f"_c_{n}"))
        return summary.select(*_IDS, *cols)

    def _add_cut(self, ops):
        ranked = self.cut.withColumns({f"_i_{n}": self._inside(op, _IDS, True) for n, op in ops.items()})
        edge = Window.partitionBy(*_IDS).orderBy(*sort_columns(self.order))
        ranked = ranked.withColumns({"_first": F.row_number().over(edge) == 1,
                                     "_last": F.lead(F.lit(1)).over(edge).isNull()})
        joined = ranked.join(self._carry(ops), _IDS, "left")
        out = {}
        for n, op in ops.items():
            i, c = F.col(f"_i_{n}"), F.col(f"_c_{n}")
            if op.kind in ("lag", "lead"):
                at_edge = F.col("_first" if op.kind == "lag" else "_last")
                default = op.default if op.default is not None else None
                outside = F.when(c.isNull(), F.lit(default)).otherwise(c["x"])
                out[n] = F.when(at_edge, outside).otherwise(i)
            elif op.kind.startswith(("ffill", "bfill")):
                out[n] = F.coalesce(i, c["x"])
            elif op.kind in ("row_number", "running_sum"):
                out[n] = F.when(i.isNull() & c.isNull(), F.lit(None)).otherwise(
                    F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)))
            elif op.kind.startswith("key_"):
                out[n] = F.coalesce(c, i)
            else:
                out[n] = (F.greatest if op.kind == "running_max" else F.least)(i, c)
        kept = [c for c in self.cut.columns if c not in out]
        return joined.select(*kept, *[e.alias(n) for n, e in out.items()])

    # ------------------------------------------------------------ public

    def add(self, **ops):
        if self.plain is not None:
            self.plain = self.plain.withColumns({n: self._inside(op, self.keys, False) for n, op in ops.items()})
        if self.split:
            self.cut = self._add_cut(ops)
        return self

    def derive(self, **cols):
        self.plain = None if self.plain is None else self.plain.withColumns(cols)
        self.cut = self.cut.withColumns(cols) if self.split else None
        return self

    def result(self):
        return self.df.drop("_cell") if self.split else self.df


def value_ranks(df, value, by=(), weight=None, hot_rows=None, nulls=False):
    """Per distinct value: rows (or summed weight), rows before it, rows up to it, rows in total.

    Ties are pre-aggregated on the map side, so what is ordered is the table of distinct values. With ``nulls`` NULL is
    a value of its own, before all others.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (df if nulls else df.filter(F.col(value).isNotNull())).groupBy(*by, value).agg(n.alias("_n"))
    scan = OrderedScan(counts, list(by), [value], hot_rows=hot_rows)
    return scan.add(_upto=running_sum("_n"), _total=key_sum("_n")).result().withColumn(
        "_before", F.col("_upto") - F.col("_n"))


def global_row_number(df, order, by=(), name="_rn", hot_rows=None):
    return OrderedScan(df, list(by), order, hot_rows=hot_rows).add(**{name: row_number()}).result()
