"""Snapshots and changes: comparison, upserts, deletes, coalescing of change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """key, old_version, new_version and status: added, updated (a later version), unchanged or deleted."""
    both = old.select(key, F.col(version).alias("old_version")).join(new.select(key, F.col(version).alias("new_version")), key, "full")
    status = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "deleted").when(F.col("new_version") > F.col("old_version"), "updated").otherwise("unchanged")
    return both.withColumn("status", status)


def upsert(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key, that of the latest version; of equal versions the new row.  Aggregated before it shuffles."""
    columns = stored.columns
    every = stored.withColumn("__new", F.lit(0)).unionByName(new.select(*columns).withColumn("__new", F.lit(1)))
    latest = every.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "__new")).alias("row"))
    return latest.select("row.*")


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti").select(*stored.columns)


def active(rows: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return rows.filter(F.col(deleted_at).isNull())


def keep_latest(rows: DataFrame, n: int, order: str, *group: str) -> DataFrame:
    """The n newest rows, of each group if columns are named."""
    if not group:
        return rows.orderBy(F.desc(order)).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))).filter(F.col("__n") <= n).drop("__n")


def coalesced(events: DataFrame, *group: str | Column, path: str = "path", ts: str = "ts", kind: str = "type", event_id: str = "id") -> DataFrame:
    """One event for each path, or none: created and deleted is nothing; changes only are the last with the
    time of the first; created and then changed is the creation; else the last.

    Groups are summarised before they shuffle, whatever their size.
    """
    order = F.struct(ts, event_id)
    row = F.struct(*events.columns)
    keys = list(group) or [path]
    agg = events.groupBy(*keys).agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"), F.bool_and(F.col(kind) == "modify").alias("all_modify"), F.count(F.lit(1)).alias("n_events"))
    first, last = F.col("first"), F.col("last")
    out = F.when(F.col("all_modify"), last.withField(ts, first[ts])).when((first[kind] == "create") & (last[kind] == "modify"), first).otherwise(last)
    kept = agg.filter(~((first[kind] == "create") & (last[kind] == "delete") & (F.col("n_events") > 1)))
    return kept.select(out.alias("row"), "n_events").select("row.*", "n_events")


def events_by_path(events: DataFrame, path: str = "path", ts: str = "ts", kind: str = "type", event_id: str = "id", most: int = 10_000) -> DataFrame:
    """path, part, n_events and types: each path's event types in the order of time, in parts of at most ``most``.

    A path with very many events has several rows, so no row grows without bound.
    """
    n = F.row_number().over(Window.partitionBy(path).orderBy(ts, event_id)) - 1
    cut = events.withColumn("__n", n).withColumn("part", F.floor(F.col("__n") / most))
    out = cut.groupBy(path, "part").agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_list(F.struct("__n", kind))).alias("e"))
    return out.select(path, "part", "n_events", F.col(f"e.{kind}").alias("types"))


def latest_events(events: DataFrame, path: str = "path", ts: str = "ts", event_id: str = "id") -> DataFrame:
    """The last event of each path; aggregated before it shuffles."""
    row = F.max_by(F.struct(*events.columns), F.struct(ts, event_id))
    return events.groupBy(path).agg(row.alias("row")).select("row.*")


def mirror(rows: DataFrame, key: str, *columns: str, deleted_at: str = "deleted_at") -> DataFrame:
    """The searchable copy of a table: the columns of its active rows, so that inserts, updates, soft and hard
    deletes show in it as soon as it is derived again."""
    return active(rows, deleted_at).select(key, *columns)


def buffer_statistics(events: DataFrame, path: str = "path", ts: str = "ts", kind: str = "type", event_id: str = "id") -> DataFrame:
    """total_events, unique_paths, coalesced_events, compression_ratio and duration_s of a set of events."""
    per = events.groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.min_by(kind, F.struct(ts, event_id)).alias("a"), F.max_by(kind, F.struct(ts, event_id)).alias("b"), F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    gone = (F.col("a") == "create") & (F.col("b") == "delete") & (F.col("n") > 1)
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), F.count(F.lit(1)).alias("unique_paths"), F.count_if(~gone).alias("coalesced_events"), (F.timestamp_diff("MICROSECOND", F.min("t0"), F.max("t1")) / 1e6).alias("duration_s"))
    return out.withColumn("compression_ratio", F.when(F.col("total_events") > 0, (F.col("total_events") - F.col("coalesced_events")) / F.col("total_events")).otherwise(0.0))


def sessions(events: DataFrame, path: str, ts: str, gap: str, kind: str = "type", event_id: str = "id") -> DataFrame:
    """Change events coalesced within sessions of a path that a gap of time ends."""
    s = F.session_window(ts, gap)
    order = F.struct(ts, event_id)
    return events.groupBy(path, s.alias("session")).agg(F.count(F.lit(1)).alias("n_events"), F.min_by(kind, order).alias("first_type"), F.max_by(kind, order).alias("last_type"), F.min(ts).alias("start"), F.max(ts).alias("stop")).drop("session")
