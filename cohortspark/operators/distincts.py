"""Distinct counts that can be merged: entities get dense numbers, a day's entities are bitmaps over them.

A daily state has one row per day, cell and block of 32,768 numbers. Counts over any days or coarser cells come from the
union of bitmaps, without reading events again; exact, unlike sketches.
"""

from pyspark.sql import functions as F

from cohortspark.operators.ordered import OrderedScan, row_number


def entity_numbers(df, entity, known=None):
    """(entity, ``number``) for every entity of ``df``: 1, 2, 3, ... in order of the entity. With ``known``, an earlier
    result, its numbers stay and new entities follow them."""
    new = df.select(entity).filter(F.col(entity).isNotNull()).distinct()
    if known is None:
        return OrderedScan(new, [], [entity]).add(number=row_number()).result()
    last = known.agg(F.max("number").alias("n")).first()["n"] or 0
    new = OrderedScan(new.join(known, entity, "left_anti"), [], [entity]).add(number=row_number()).derive(number=F.col("number") + F.lit(last)).result()
    return known.select(entity, "number").unionByName(new)


def daily_distinct_state(events, numbers, date, dims, entity):
    """(date, dims, block, bitmap) of the entities of every day and cell."""
    n = F.col("number")
    coded = events.select(date, *dims, entity).distinct().join(numbers, entity)
    return coded.groupBy(date, *dims, F.bitmap_bucket_number(n).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bitmap"))


def distinct_from_state(state, by, name="n"):
    """Distinct entities per ``by`` from the state's rows: days and cells left out of ``by`` are merged."""
    merged = state.groupBy(*by, "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias(name))


def rolling_distinct(state, date, by, start, end, window=28, name="n"):
    """Distinct entities of the ``window`` days up to each date from start to end; dates without any are left out. A
    state row counts for ``window`` dates; events are not read."""
    first, last = F.greatest(F.col(date), F.lit(start).cast("date")), F.least(F.date_add(date, window - 1), F.lit(end).cast("date"))
    covered = state.filter(first <= last).withColumn("_as_of", F.explode(F.sequence(first, last))).drop(date)
    return distinct_from_state(covered.withColumnRenamed("_as_of", date), [date, *by], name)
