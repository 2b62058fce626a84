"""Backups of stored tables and their upkeep."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def backup(spark: SparkSession, folder: str, backups: str, name: str | None = None) -> str:
    """A copy of a folder of tables; complete when its marker is there."""
    name = name or f"backup-{time.time_ns():020d}"
    conf = spark._jsc.hadoopConfiguration()
    fs, source = _fs(spark, folder)
    to, target = _fs(spark, f"{backups.rstrip('/')}/{name}")
    to.mkdirs(target.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, target, False, conf)
    to.create(spark._jvm.org.apache.hadoop.fs.Path(target, "_backup_done")).close()
    return name


def backups_of(spark: SparkSession, backups: str) -> DataFrame:
    """name, bytes and created_ms of the complete backups."""
    fs, top = _fs(spark, backups)
    rows = []
    for s in fs.listStatus(top) if fs.exists(top) else []:
        mark = spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_backup_done")
        if fs.exists(mark):
            rows.append((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength(), fs.getFileStatus(mark).getModificationTime()))
    return spark.createDataFrame(rows, "name string, bytes long, created_ms long")


def clean_backups(spark: SparkSession, backups: str, keep: int = 5) -> list[str]:
    """Deletes all but the newest backups; the names of the deleted ones."""
    old = [r["name"] for r in backups_of(spark, backups).orderBy(F.desc("created_ms"), F.desc("name")).offset(keep).collect()]
    for name in old:
        fs, path = _fs(spark, f"{backups.rstrip('/')}/{name}")
        fs.delete(path, True)
    return old


def restore(spark: SparkSession, backups: str, name: str, folder: str) -> None:
    """Puts a backup in place of a folder; the folder is replaced only once the copy is complete."""
    fs, source = _fs(spark, f"{backups.rstrip('/')}/{name}")
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(source, "_backup_done")):
        raise ValueError(f"no complete backup {name}")
    to, target = _fs(spark, folder)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}.restored")
    to.delete(fresh, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, fresh, False, spark._jsc.hadoopConfiguration())
    to.delete(spark._jvm.org.apache.hadoop.fs.Path(fresh, "_backup_done"), False)
    to.delete(target, True)
    to.rename(fresh, target)


def compact(spark: SparkSession, folder: str, file_bytes: int = 128 << 20) -> int:
    """Rewrites a Parquet table into files of about so many bytes; the number of its files afterwards."""
    fs, path = _fs(spark, folder)
    n = max(1, -(-fs.getContentSummary(path).getLength() // file_bytes))
    fresh = f"{folder.rstrip('/')}.compacted"
    spark.read.parquet(folder).coalesce(int(n)).write.mode("overwrite").parquet(fresh)
    fs.delete(path, True)
    fs.rename(_fs(spark, fresh)[1], path)
    return sum(1 for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))


def column_statistics(rows: DataFrame) -> DataFrame:
    """column_name, n_null, n_distinct (about) and n_rows of every column, in one pass."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(rows.columns):
        aggregates += [F.count_if(F.col(c).isNull()).alias(f"null{i}"), F.approx_count_distinct(F.col(c)).alias(f"distinct{i}")]
    one = rows.agg(*aggregates)
    each = [F.struct(F.lit(c).alias("column_name"), F.col(f"null{i}").alias("n_null"), F.col(f"distinct{i}").alias("n_distinct"), F.col("n").alias("n_rows")) for i, c in enumerate(rows.columns)]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")
