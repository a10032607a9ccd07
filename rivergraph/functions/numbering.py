"""Consecutive numbers in an order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with `name`, from 0 in the order of the given columns (which should tell all rows apart). Rows are dealt by
    range and numbered inside their part; a part begins after the rows of the parts before it (one count a part)."""
    placed = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn(name, inside.cast("long")).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name,
        F.col(name) + F.col("_before")).drop("_part", "_p", "_before")
