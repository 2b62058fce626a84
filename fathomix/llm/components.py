"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomix.storage import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in edges (u, v); component is the smallest id reachable.

    Each round is written to the shared folder, so lineage stays short and lost executors cost one
    round.  The number of rounds grows with the logarithm of the longest path.  Minima are joined from
    written tables, so that a join on a hub can be split.
    """
    now = scratch.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.write(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        after = scratch.write(small.distinct())
        scratch.drop(now, low, large, low2)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
