"""Joins by range and nearness, and checks of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: About how many rows of both sides a task joins.
TASK_ROWS = 1 << 19


def nearest_following(left: DataFrame, right: DataFrame, keys: list[str], at: str, most: int, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, distance: for each left row the nearest right row of the same keys that comes 1 to
    ``most`` units later.

    Rows meet in buckets of that width, a left row in two of them, so that the join is on equal keys and a
    large group is spread over its buckets.
    """
    width = most
    bucket = lambda c: F.floor(F.col(c) / width)
    a = left.select(*keys, F.col(at).alias("__a"), F.col(left_id).alias("left_id")).withColumn("__b", F.explode(F.array(bucket("__a"), bucket("__a") + 1)))
    b = right.select(*keys, F.col(at).alias("__c"), F.col(right_id).alias("right_id")).withColumn("__b", bucket("__c"))
    gap = F.col("__c") - F.col("__a")
    near = a.join(b, [*keys, "__b"]).filter((gap >= 1) & (gap <= most))
    return near.groupBy("left_id").agg(F.min(F.struct(gap.alias("distance"), "right_id")).alias("m")).select("left_id", "m.right_id", "m.distance")


def innermost_container(points: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, point_id: str, span_id: str, width: int = 64, ends: tuple[str, str] | None = None) -> DataFrame:
    """point_id, span_id: for each point the shortest span of the same keys that contains its start and end.

    ``ends``: the columns of a span's start and end, if they have other names than a point's.  A span is listed at a level of its length, the least ``width`` * 4**level that is no shorter, in the two buckets of that width
    that it can reach into; a point looks into its bucket of each level that occurs.  So spans and points of one group meet only
    where they are near, and each row is repeated as often as there are levels.  Rows are counted first: large inputs are dealt to
    tasks of about ``TASK_ROWS``, unless a bucket holds many times that, which adaptive execution splits.
    """
    p = points.select(*keys, F.col(start).alias("ps"), F.col(end).alias("pe"), F.col(point_id).alias("point_id"))
    a, b = ends or (start, end)
    s = spans.select(*keys, F.col(a).alias("ss"), F.col(b).alias("se"), F.col(span_id).alias("span_id")).filter("se >= ss")
    level = F.greatest(F.ceil(F.log(4.0, F.greatest((F.col("se") - F.col("ss")).cast("double"), F.lit(1.0)) / width)), F.lit(0)).cast("int")
    size = lambda c: F.lit(float(width)) * F.pow(F.lit(4.0), c)
    s = s.withColumn("level", level)
    bucket = lambda c: F.floor(F.col(c) / size(F.col("level")))
    s = s.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket("ss"), bucket("se")))))
    held = dict(s.groupBy("level").count().collect())  # as many levels as the logarithm of the longest span at most
    rows, levels = p.count() * len(held) + sum(held.values()), list(held)
    p = p.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("bucket", bucket("ps"))
    near, tasks = [*keys, "level", "bucket"], -(-rows // TASK_ROWS)
    bounded = tasks > points.sparkSession.sparkContext.defaultParallelism and _largest_group(near, p, s) <= 4 * TASK_ROWS
    if bounded:
        p, s = p.repartition(tasks, *near), s.repartition(tasks, *near)
    inside = p.join(s, near).filter((F.col("ss") <= F.col("ps")) & (F.col("se") >= F.col("pe"))).select(*near, "point_id", F.struct((F.col("se") - F.col("ss")).alias("n"), "span_id").alias("m"))
    if bounded:
        # A point's best of a bucket where the rows met, then of its levels.
        inside = inside.groupBy(*near, "point_id").agg(F.min("m").alias("m")).repartition(tasks, "point_id")
    return inside.groupBy("point_id").agg(F.min("m").alias("m")).select("point_id", "m.span_id")


def _largest_group(by: list[str], *frames: DataFrame) -> int:
    """About how many rows the largest group of all frames has, by one pass with a sketch."""
    hashes = [df.select(F.xxhash64(*by).alias("h")) for df in frames]
    top = reduce(DataFrame.unionByName, hashes).agg(F.expr("approx_top_k(h, 1)").alias("top")).first()["top"]
    return top[0]["count"] if top else 0


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def enrich(results: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """results with the columns of their documents, if any; how they meet is left to the measured sizes."""
    return results.join(docs, key, "left")


def cascade(parent_keys: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Rows of child that are left when the parents of these keys are deleted."""
    return child.join(parent_keys.select(key).distinct(), key, "left_anti")


def per_group(rows: DataFrame, n: int, group: list[str], order: list) -> DataFrame:
    """The first n rows of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)
