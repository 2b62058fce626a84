"""Stored vectors: Parquet tables, and the binary form of a compressed sparse matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a block, of 8 bytes each.
BLOCK_CELLS = 1 << 18


def write_vectors(vectors: DataFrame, folder: str, doc_id: str) -> None:
    """(id, bucket, tf, weight) sorted within files, so that a bucket's rows are skipped by statistics."""
    vectors.repartition(doc_id).sortWithinPartitions(doc_id, "bucket").write.mode("overwrite").parquet(folder)


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def pack(rows: list[tuple[list[int], list[float]]]) -> bytes:
    """Rows (columns, values) as three lengths, float32 values, uint32 columns and uint32 row starts."""
    values = np.concatenate([np.zeros(0, "<f4"), *(np.asarray(vs, "<f4") for _, vs in rows)])
    columns = np.concatenate([np.zeros(0, "<u4"), *(np.asarray(cs, "<u4") for cs, _ in rows)])
    starts = np.concatenate([[0], np.cumsum([len(c) for c, _ in rows])]).astype("<u4")
    return np.array([len(values), len(columns), len(starts)], "<u4").tobytes() + values.tobytes() + columns.tobytes() + starts.tobytes()


def unpack(data: bytes) -> list[tuple[list[int], list[float]]]:
    n, m, k = np.frombuffer(data, "<u4", 3)
    values = np.frombuffer(data, "<f4", n, 12)
    columns = np.frombuffer(data, "<u4", m, 12 + 4 * n)
    starts = np.frombuffer(data, "<u4", k, 12 + 4 * n + 4 * m)
    return [(columns[a:b].tolist(), values[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)]


def export_blocks(rows: DataFrame, doc_id: str, most: int = BLOCK_CELLS) -> DataFrame:
    """ids and data of blocks of compressed rows; a block holds at most so many cells, or one row."""
    kind = rows.schema[doc_id].dataType.simpleString()

    def run(frames):
        for f in frames:
            sizes, first = f["columns"].map(len).tolist(), 0
            while first < len(f):
                last, cells = first + 1, sizes[first]
                while last < len(f) and cells + sizes[last] <= most:
                    cells, last = cells + sizes[last], last + 1
                part = f.iloc[first:last]
                yield pd.DataFrame({"ids": [part[doc_id].tolist()], "data": [pack(list(zip(part["columns"], part["values"], strict=True)))]})
                first = last

    return rows.select(doc_id, "columns", "values").mapInPandas(run, f"ids array<{kind}>, data binary")


def import_blocks(blocks: DataFrame, doc_id: str, kind: str = "bigint") -> DataFrame:
    """The compressed rows of blocks, a block's at a time."""

    def run(frames):
        for f in frames:
            for ids, data in zip(f["ids"], f["data"], strict=True):
                rows = unpack(data)
                yield pd.DataFrame({doc_id: list(ids), "columns": [r[0] for r in rows], "values": [r[1] for r in rows]})

    return blocks.mapInPandas(run, f"{doc_id} {kind}, columns array<int>, values array<double>")


def index_statistics(files: DataFrame, vectors: DataFrame, doc_id: str, dim: int) -> DataFrame:
    """n_files and an estimate of bytes in memory: 2 a path character, 8 a sparse cell, 4 a dense value."""
    paths = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(F.length(F.col(doc_id).cast("string"))), F.lit(0)).alias("chars")).withColumn("one", F.lit(1))
    cells = vectors.agg(F.count(F.lit(1)).alias("cells")).withColumn("one", F.lit(1))
    both = paths.join(F.broadcast(cells), "one")
    return both.select("n_files", (2 * F.col("chars") + 8 * F.col("cells") + 4 * dim * F.col("n_files")).alias("memory"))
