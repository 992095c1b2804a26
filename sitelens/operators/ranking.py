"""Ranks and running values inside groups of any size.

A window over ``partitionBy(key)`` works on each key in one task.  Here rows
are range-sorted by (key, order), so a key with a third of all rows spans many
tasks; the ranged rows are written once to the shared folder, with the number
of their range, so that the parts below all see the same ranges.  A window
inside each range is then completed with one row per (range, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def ranged(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` with ``_part``, the number of its range, and ``_place``, its row number in the range."""
    keys = [F.col(key).asc_nulls_first(), *order]
    parts = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "ranged")
    return parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))


def ranked(df: DataFrame, key: str, order: list[Column], name: str = "position") -> DataFrame:
    """``row_number()`` of each row inside its key."""
    rows = ranged(df, key, order)
    counts = rows.groupBy("_part", key).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_c_part"), F.col(key).alias("_c_key"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(counts, (F.col("_part") == F.col("_c_part")) & F.col(key).eqNullSafe(F.col("_c_key")))
    return out.select(*df.columns, (F.col("_before") + F.col("_place") - F.col("_first") + 1).cast("int").alias(name))


def with_previous(df: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``lag(value)`` inside each key: null on the first row of a key."""
    rows = ranged(df, key, order)
    local = Window.partitionBy("_part").orderBy("_place")
    rows = rows.withColumn("_same", F.lag(F.struct(key, value)).over(local))
    # of each range, the last row of each of its keys: what a key's first row in a later range follows
    ends = rows.groupBy("_part", key).agg(F.max_by(F.struct(value), F.col("_place")).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_part")
    ends = ends.select(F.col("_part").alias("_c_part"), F.col(key).alias("_c_key"), F.lag("_end").over(earlier).alias("_carried"))
    out = rows.join(ends, (F.col("_part") == F.col("_c_part")) & F.col(key).eqNullSafe(F.col("_c_key")))
    follows = F.col("_same").isNotNull() & F.col(f"_same.{key}").eqNullSafe(F.col(key))
    return out.select(*df.columns, F.when(follows, F.col(f"_same.{value}")).otherwise(F.col(f"_carried.{value}")).alias(name))


#: Rows of a key up to which Spark cuts each partition before a window's shuffle.
SHALLOW = 1_000


def paged(df: DataFrame, key: str, order: list[Column], offset: int, limit: int, name: str = "position") -> DataFrame:
    """The rows at ``offset`` < ``name`` <= ``offset + limit`` of each key, in ``order``.

    The first rows of each key are a plain window, which Spark cuts short in
    every partition.  A page far inside is found by counts: rows are dealt to
    ranges and written, and only the ranges of a key that hold a part of the page
    are sorted, so a page of a key with a third of all rows sorts a range or two.
    """
    within = (F.col(name) > offset) & (F.col(name) <= offset + limit)
    if offset + limit <= SHALLOW:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(within)
    rows, wanted = page_ranges(df, key, order, offset, limit)
    rows = rows.join(wanted, (F.col("_part") == F.col("_c_part")) & F.col(key).eqNullSafe(F.col("_c_key")))
    place = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    return rows.withColumn(name, (F.col("_before") + place).cast("int")).where(within).select(*df.columns, name)


def page_ranges(df: DataFrame, key: str, order: list[Column], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of their range (``_part``), and the ranges of each key that hold a part of the page."""
    rows = stored(df.repartitionByRange(F.col(key).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part", key).agg(F.count("*").alias("_n"))
    counts = counts.select(F.col("_part").alias("_c_part"), F.col(key).alias("_c_key"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows, counts.where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset)).select("_c_part", "_c_key", "_before")
