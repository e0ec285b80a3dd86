"""Positions of rows in a total order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.sources.scratch import Scratch


def with_position(df: DataFrame, *order: Column, name: str = "pos", parts: int | None = None) -> DataFrame:
    """df with its rows numbered from 0 in the given order, which should leave no ties.

    Rows are dealt out by range; a table of how many rows the ranges before each hold (a row for each of `parts` ranges) is
    added to the number within the range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = Scratch(df.sparkSession, "order").table(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").count()
    offsets = counts.select(F.col("_part"), (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_in", number).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") + F.col("_before")).select(*df.columns, name)


def zipped(left: DataFrame, left_order: Column, right: DataFrame, right_order: Column) -> DataFrame:
    """Rows of equal position side by side, as many as the shorter table has."""
    return with_position(left, left_order).join(with_position(right, right_order), "pos")
