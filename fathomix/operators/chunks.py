"""Queries over chunks: filters with pages, lookups, statistics, upserts, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a chunk can be, and of which language.
TYPES = ("function", "method", "constructor", "property", "class", "module", "async_function", "async_method", "generator")
LANGUAGES = ("typescript", "javascript", "python")
LARGE = 5000


@dataclass
class ChunkQuery:
    """Filters and a page; None does not filter."""

    types: tuple[str, ...] | None = None
    languages: tuple[str, ...] | None = None
    file_id: str | None = None
    text: str | None = None
    min_lines: int | None = None
    max_lines: int | None = None
    limit: int = 100
    offset: int = 0

    def page(self, number: int, size: int) -> ChunkQuery:
        """The same filters with page ``number``, from 1."""
        if number < 1 or size < 1:
            raise ValueError("page and size start at 1")
        return ChunkQuery(self.types, self.languages, self.file_id, self.text, self.min_lines, self.max_lines, size, (number - 1) * size)

    def filter(self, chunks: DataFrame) -> DataFrame:
        out = chunks
        if self.types:
            out = out.filter(F.col("chunk_type").isin(*self.types))
        if self.languages:
            out = out.filter(F.col("language").isin(*self.languages))
        if self.file_id is not None:
            out = out.filter(F.col("file_id") == self.file_id)
        if self.text:
            out = out.filter(F.lower("content").contains(self.text.lower()))
        if self.min_lines is not None:
            out = out.filter(F.col("line_count") >= self.min_lines)
        if self.max_lines is not None:
            out = out.filter(F.col("line_count") <= self.max_lines)
        return out


def run(chunks: DataFrame, query: ChunkQuery, order: tuple[str, ...] = ("file_id", "start_line", "id")) -> DataFrame:
    """The page's rows with total, page and has_more.

    The total is counted from the filter columns alone; rows are found by a bounded sort.
    """
    found = query.filter(chunks)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    rows = found.orderBy(*order).offset(query.offset).limit(query.limit)
    out = rows.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").drop("one")
    return out.withColumn("page", F.lit(query.offset // query.limit + 1)).withColumn("has_more", F.lit(query.offset + query.limit) < F.col("total"))


def by_hash(chunks: DataFrame, value: str) -> DataFrame:
    return chunks.filter(F.col("chunk_hash") == value)


def by_file(chunks: DataFrame, file_id: str) -> DataFrame:
    return chunks.filter(F.col("file_id") == file_id).orderBy("start_line")


def without(chunks: DataFrame, column: str, value: str) -> DataFrame:
    return chunks.filter(~F.col(column).eqNullSafe(value))


def statistics(chunks: DataFrame) -> DataFrame:
    """grouping (total, language or chunk_type), value, n, mean_size and n_large; the total of no chunks is 0."""
    figures = [F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("character_count"), F.lit(0.0)).alias("mean_size"), F.count_if(F.col("line_count") > LARGE).alias("n_large")]
    sets = chunks.groupingSets([["language"], ["chunk_type"]], "language", "chunk_type").agg(F.grouping_id().alias("g"), *figures)
    name = F.when(F.col("g") == 1, "language").otherwise("chunk_type")
    value = F.when(F.col("g") == 1, F.col("language")).otherwise(F.col("chunk_type"))
    total = chunks.agg(*figures).select(F.lit("total").alias("grouping"), F.lit("all").alias("value"), "n", "mean_size", "n_large")
    return sets.select(name.alias("grouping"), value.alias("value"), "n", "mean_size", "n_large").unionByName(total)


def collisions(chunks: DataFrame) -> DataFrame:
    """Hashes under which different contents are stored."""
    return chunks.groupBy("chunk_hash").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a <> b").select("chunk_hash")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with new chunks in place of those of the same hash; different content is an error."""
    if not collisions(stored.select("chunk_hash", "content").unionByName(new.select("chunk_hash", "content"))).isEmpty():
        raise ValueError("Hash collision detected")
    return stored.join(new.select("chunk_hash"), "chunk_hash", "left_anti").select(*stored.columns).unionByName(new)


def with_validity(chunks: DataFrame) -> DataFrame:
    """chunks with is_valid: a proper hash and name, ranges in order, a line count that fits."""
    fine = F.lower("chunk_hash").rlike("^[0-9a-f]{64}$") & (F.col("start_line") <= F.col("end_line")) & (F.col("start_byte") <= F.col("end_byte"))
    fine = fine & (F.col("line_count") == F.col("end_line") - F.col("start_line") + 1) & (F.length(F.trim("name")) > 0)
    return chunks.withColumn("is_valid", F.coalesce(fine & F.col("chunk_type").isin(*TYPES) & F.col("language").isin(*LANGUAGES), F.lit(False)))
