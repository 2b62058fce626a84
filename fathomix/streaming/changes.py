"""Change events as streams: coalescing with event time, and applying batches to a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomix.functions.text import epoch_micros
from fathomix.operators.changes import coalesced
from fathomix.storage import Scratch

SCHEMA = "id long, path string, type string, ts timestamp, status string, retry_count int"
TYPES = ("create", "modify", "delete", "rename")


def source(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Validated change events from JSON files that arrive in a folder."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return events.filter(F.col("type").isin(*TYPES) & F.col("path").isNotNull() & F.col("ts").isNotNull())


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One coalesced change for each path and session; sessions end after a gap without events.

    Events that come later than the watermark are left out by the engine; everything earlier is state of
    one row for each open session.
    """
    watched = events.withWatermark("ts", late)
    order = F.struct("ts", "id")
    grouped = watched.groupBy("path", F.session_window("ts", gap)).agg(F.min_by("type", order).alias("a"), F.max_by("type", order).alias("b"), F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"), F.bool_and(F.col("type") == "modify").alias("m"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n_events"))
    created = (F.col("a") == "create") & (F.col("b") == "modify")
    kept = grouped.filter(~((F.col("a") == "create") & (F.col("b") == "delete") & (F.col("n_events") > 1)))
    return kept.select("path", F.when(created, F.col("first_id")).otherwise(F.col("last_id")).alias("id"), F.when(created, F.col("a")).otherwise(F.col("b")).alias("type"), F.when(F.col("m") | created, F.col("t0")).otherwise(F.col("t1")).alias("ts"), "n_events")


def retryable(events: DataFrame, most: int = 3, first_ms: int = 1000, longest_ms: int = 30_000) -> DataFrame:
    """Failed events that may be tried again, with the delay before the next attempt, doubled each time."""
    out = events.filter((F.col("status") == "FAILED") & (F.col("retry_count") < most))
    return out.withColumn("delay_ms", F.least(F.lit(first_ms) * F.pow(F.lit(2), "retry_count"), F.lit(longest_ms)).cast("long"))


class IndexTable:
    """The state of each path, as a table of versions; a batch writes the next version.

    The newest complete version is read from the folder, so a stream that starts again goes on from it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    @property
    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest one before a number."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], "path string, id long, type string, ts timestamp")
        return self.spark.read.parquet(f"{self.folder}/v{known[-1]}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Upserts and deletes of a micro-batch.  A batch that is run again writes the same version."""
        now = coalesced(batch.select("path", "id", "type", "ts")).select("path", "id", "type", "ts")
        kept = self.read(number).join(now.select("path"), "path", "left_anti")
        kept.unionByName(now.filter("type <> 'delete'")).write.mode("overwrite").parquet(f"{self.folder}/v{number}")


def apply_stream(events: DataFrame, index: IndexTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(index.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replay(events: DataFrame, batches: int = 4) -> DataFrame:
    """The index after a table of events has gone through apply_stream in batches of equal spans of event time."""
    spark = events.sparkSession
    scratch = Scratch(spark, "replay")
    micros = epoch_micros(F.col("ts"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    number = F.least(F.floor(F.lit(batches) * (micros - F.lit(low or 0)) / F.lit(max(1, (high or 0) - (low or 0)))), F.lit(batches - 1))
    rows = events.select("path", "id", "type", "ts", number.cast("int").alias("batch"))
    for b in range(batches):
        # Files are read in the order in which they were written, one a batch.
        rows.filter(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(f"{scratch.root}/in")
    index = IndexTable(spark, f"{scratch.root}/index")
    stream = spark.readStream.schema("path string, id long, type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{scratch.root}/in")
    query = apply_stream(stream, index, f"{scratch.root}/checkpoint")
    query.awaitTermination()
    return index.read()
