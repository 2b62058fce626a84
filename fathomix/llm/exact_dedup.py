"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Texts are equal when identical after each run of white space is replaced by one space; null counts as
the empty text.  Of equal texts the row with the smallest id stays.

A frequent-items sketch of the Misra-Gries family proposes at most ``top_k`` digests.  Their counts are
verified, and the verified winners, a table of bounded size, are broadcast, so that rows of hot groups
never leave their map task.  All other digests are rarer than the sketch's error bound and meet in an
ordinary shuffle of (digest, id) rows; texts are not shuffled.

Defined cases: empty and null texts form one group; rows that repeat an id are all reported and the
group's size counts them all, each kept if its id is the smallest; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomix.storage import Scratch

TOP_K = 256
TRACKED = 4096
#: A proposed digest wins if it has at least this share of all rows.
HOT_SHARE = 0.0005
LEAST_HOT = 32


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", top_k: int = TOP_K, tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digests = scratch.write(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest")))
    winners = _winners(digests, top_k, tracked)
    marked = digests.join(F.broadcast(winners), "digest", "left")
    hot = marked.filter(F.col("keep_id").isNotNull() | F.col("group_size").isNotNull())
    cold = marked.filter(F.col("group_size").isNull()).drop("keep_id", "group_size")
    group = Window.partitionBy("digest")
    cold = cold.withColumns({"keep_id": F.min("doc_id").over(group), "group_size": F.count(F.lit(1)).over(group)})
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _winners(digests: DataFrame, top_k: int, tracked: int) -> DataFrame:
    """Digests proven frequent, with their smallest id and exact count; at most top_k rows."""
    row = digests.agg(F.count(F.lit(1)).alias("n"), F.expr(f"transform(approx_top_k(hex(digest), {top_k}, {tracked}), x -> x.item)").alias("items")).first()
    spark = digests.sparkSession
    proposed = spark.createDataFrame([(bytearray.fromhex(x),) for x in row["items"] or [] if x], "digest binary")
    counted = digests.join(F.broadcast(proposed), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return counted.filter(F.col("group_size") >= max(LEAST_HOT, row["n"] * HOT_SHARE))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their group of equal texts."""
    dropped = exact_groups(docs, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(dropped, doc_id, "left_anti").select(*docs.columns)
