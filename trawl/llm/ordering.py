"""Numbering rows in order without bringing them, or those of one key, into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import stored


def dealt(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows, stored, with ``_part``, the number of their range of ``order``, and ``_row``.

    Ranges follow each other in ascending order, nulls first. ``_row`` tells equal rows apart and
    is the last thing that ranges lie between, so a key that many rows share is split. The rows
    are stored before they are dealt, as Spark samples them to find the ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = stored(rows.withColumn("_row", F.monotonically_increasing_id()), name)
    return stored(once.repartitionByRange(parts, *order, "_row").withColumn("_part", F.spark_partition_id()), name)


def starts(counts: DataFrame, part: str, n: str, to: str) -> DataFrame:
    """Adds the sum of ``n`` over all earlier parts; there are as few rows as ranges."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(to, F.coalesce(F.sum(n).over(before), F.lit(0)))


def numbered(rows: DataFrame, order: list[str], to: str, name: str) -> DataFrame:
    """The rows with their place in the order, from 0; equal rows follow each other."""
    placed = dealt(rows, order, name)
    parts = starts(placed.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n", "_start")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_row")) - 1
    return placed.withColumn("_in", inside).join(F.broadcast(parts), "_part").select(
        *rows.columns, (F.col("_start") + F.col("_in")).alias(to))
