"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: A table of so many bytes or fewer, as stored, may be broadcast.
SMALL_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a temporary one serves if driver and tasks are one process; on a cluster that is an error.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, "") or spark.sparkContext.getConf().get(CHECKPOINT_CONF, "")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fathomix-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share and that is deleted when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(p)
    files.deleteOnExit(p)
    return folder


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of any store that Spark reads, hidden ones too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Scratch:
    """Tables that cut lineage and survive lost executors.

    ``write`` stores a frame as Parquet in the shared folder and reads it back with its own schema, so
    that no action is needed to infer one.  ``drop`` frees tables that no later plan reads; those that a
    result still reads are deleted when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = temporary_folder(spark, name)
        self.n = 0
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def _path(self, path: str):
        """(file system, path) on the JVM."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = (out, path)
        return out

    def bytes(self, df: DataFrame) -> int:
        """The stored size of a table of this object."""
        files, path = self._path(self.tables[id(df)][1])
        return files.getContentSummary(path).getLength()

    def join_small(self, df: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
        """df joined with a table of this object, which is broadcast if its measured size allows that, else shuffled."""
        return df.join(F.broadcast(table) if self.bytes(table) <= SMALL_BYTES else table, on, how)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            found = self.tables.pop(id(df), None)
            if found:
                files, path = self._path(found[1])
                files.delete(path, True)

    def keep_only(self, *frames: DataFrame) -> None:
        """Frees all tables but these, which a result still reads."""
        kept = {id(df) for df in frames}
        self.drop(*(df for key, (df, _) in list(self.tables.items()) if key not in kept))
