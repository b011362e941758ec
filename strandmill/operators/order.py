"""Gapless numbers in a global order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import durable


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """Add ``name``, from 0, in the given order, which should end in a unique key.

    Rows are range-partitioned and written; a running sum over one row a partition tells where each begins.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = ranged.withColumn("_at", F.row_number().over(inside)).join(starts, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_part", "_before", "_at")
