"""Places of rows in the order of their group, without a task that holds a whole group (``with_places``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def with_places(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, the place in the group from 0 by ``order`` (nulls first), and ``n``, the group's rows.

    Rows are dealt out by ranges of group and order and sorted inside them; what lies ahead of a range is summed over
    one row per group and range. A group of any size goes over many tasks, and so do rows that are equal in all of
    ``order``: they are told apart by where they were read. Adds the columns ``part``, ``row``, ``at`` and ``n``.
    """
    keys = [group, *order, "read_at"]
    dealt = rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("read_at")
    ranged = written(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), name)
    per = ranged.groupBy(group, "part").agg(F.min("row").alias("first"), F.count("*").alias("size"))
    whole = Window.partitionBy(group)
    ahead = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(per.select(group, "part", (ahead - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n")), f"{name}_runs")
    return ranged.join(runs, [group, "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("shift")
