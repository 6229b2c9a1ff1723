"""Connected components of links between long ids, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, written to the shared folder; each row keeps two ids, and the number of
rounds grows with the logarithm of the longest chain. The minima have one row per node, so a hub's links can be split
over tasks by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(links: DataFrame, both_ways: DataFrame, large: bool) -> DataFrame:
    """The links after a step, written; those before it are deleted."""
    mins = written(both_ways.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), "mins")
    if large:
        joined = both_ways.filter("v > u").join(mins, "u")
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = links.join(mins, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(mins.select("u", F.col("low").alias("v")))
    out = written(out.filter("u <> v").distinct(), "links")
    drop_written(mins)
    drop_written(links)
    return out


def _sum_up(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) to ``(node, root)`` for every node with a link; the root is the component's smallest node."""
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _sum_up(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = _star(now, both, large=True)
        now = _star(now, now, large=False)
        state, last = _sum_up(now), state
        if state == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
