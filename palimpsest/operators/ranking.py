"""Positions within groups that may be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut


def position(df: DataFrame, group: list[str], order: list[str], part: Column, name: str) -> DataFrame:
    """Adds the position (from 0) of each row within its group in the given order.

    part must rise with the order: rows are ranked within (group, part), and shifted by the sizes of the parts before,
    which are counted by a partial aggregation. So a group of any size is spread over its parts, and the rows are
    shuffled once, as the join has the partitioning of the window. Rows of a null group or part get a null position.
    """
    whole = df.withColumn("__part", part)
    sizes = whole.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "__part", before.alias("__before"))
    ranked = whole.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order)))
    out = ranked.join(sizes, [*group, "__part"], "left").withColumn(name, F.col("__rank") - 1 + F.col("__before"))
    return out.select(*df.columns, name)


def position_by_range(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """position(), with ranges of (group, order) as parts: whatever the order's values are, no group is too large for a task."""
    ordered = cut(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()))
    return position(ordered, group, order, F.col("__range"), name).drop("__range")
