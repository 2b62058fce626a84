"""Reports: storage, percentiles, rolling averages, health, benchmarks, query plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n_rows of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def table_sizes(spark: SparkSession, folders: dict[str, str], indexes: tuple[str, ...] = ()) -> DataFrame:
    """table_name, n_rows, bytes, mean_row and index_overhead of stored tables.

    Bytes are those of the files, which the file system tells without reading them; the overhead is the
    share of the tables named as ``indexes`` in all bytes, in percent.
    """
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    sizes = []
    for name, folder in folders.items():
        path = jvm.org.apache.hadoop.fs.Path(folder)
        sizes.append((name, path.getFileSystem(conf).getContentSummary(path).getLength(), name in indexes))
    total = sum(b for _, b, _ in sizes)
    overhead = 100.0 * sum(b for _, b, index in sizes if index) / total if total else 0.0
    counts = table_counts({n: spark.read.parquet(f) for n, f in folders.items()})
    known = spark.createDataFrame([(n, b) for n, b, _ in sizes], "table_name string, bytes long")
    out = counts.join(F.broadcast(known), "table_name")
    return out.select("table_name", "n_rows", "bytes", F.when(F.col("n_rows") > 0, F.col("bytes") / F.col("n_rows")).otherwise(0.0).alias("mean_row"), F.lit(overhead).alias("index_overhead"))


def index_tables(indexes: DataFrame, tables: DataFrame) -> DataFrame:
    """Each index of a catalog with its table, and whether that is there: index_name, table_name, present."""
    known = tables.select(F.col("table_name")).distinct().withColumn("present", F.lit(True))
    return indexes.select("index_name", "table_name").join(known, "table_name", "left").select("index_name", "table_name", F.coalesce("present", F.lit(False)).alias("present"))


def compare_catalog(found: DataFrame, expected: DataFrame) -> DataFrame:
    """table_name and status (present, missing, extra) of two lists of tables."""
    a = found.select("table_name").distinct().withColumn("a", F.lit(True))
    b = expected.select("table_name").distinct().withColumn("b", F.lit(True))
    both = a.join(b, "table_name", "full")
    return both.select("table_name", F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").otherwise("present").alias("status"))


def alerts(samples: DataFrame, at: str, *group: str, memory_mb: float = 500, cpu_percent: float = 80, lag_ms: float = 100) -> DataFrame:
    """samples with cpu_percent, of the time since the sample before, and alerts: which limits it exceeds.

    samples: memory_mb, cpu_ms (a running total), lag_ms; ``at`` is the time of a sample in ms.  Memory of
    half as much again as its limit is critical.
    """
    w = Window.partitionBy(*group).orderBy(at)
    elapsed = F.col(at) - F.lag(at).over(w)
    out = samples.withColumn("cpu_percent", F.when(elapsed > 0, 100.0 * (F.col("cpu_ms") - F.lag("cpu_ms").over(w)) / elapsed))
    found = [F.when(F.col("memory_mb") > 1.5 * memory_mb, "memory critical").when(F.col("memory_mb") > memory_mb, "memory"), F.when(F.col("lag_ms") > lag_ms, "event loop"), F.when(F.col("cpu_percent") > cpu_percent, "cpu")]
    return out.withColumn("alerts", F.array_compact(F.array(*found)))


def first_failure(results: DataFrame, order: list[str], *group: str) -> DataFrame:
    """ok and error of each group of results (ok, error): all are well, or the error of the first that is not."""
    bad = ~F.coalesce(F.col("ok"), F.lit(False))
    first = F.min_by(F.when(bad, F.coalesce("error", F.lit("unknown"))), F.when(bad, F.struct(*order)))
    return results.groupBy(*group).agg(F.bool_and(~bad).alias("ok"), first.alias("error"))


def storage(rows: DataFrame, size: Column, *group: str) -> DataFrame:
    """n, total_size and mean_size, which is 0 without rows."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_size"))


def percentiles(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99, least, greatest and mean."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*group).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))


def rolling(rows: DataFrame, value: str, order: list[str], *group: str, samples: int = 100) -> DataFrame:
    """rows with the mean, the peak and the number of the last samples of each group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(1 - samples, 0)
    return rows.withColumns({"mean": F.avg(value).over(w), "peak": F.max(value).over(w), "samples": F.count(F.lit(1)).over(w)})


#: States from the worst on.
HEALTH = ("CRITICAL", "ERROR", "WARNING", "HEALTHY")


def health(rows: DataFrame, status: str, *group: str) -> DataFrame:
    """The worst status of each group; HEALTHY where there is none."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, HEALTH)), F.col(status)), F.lit(0).cast("long")), F.lit(len(HEALTH)))
    return rows.groupBy(*group).agg(F.array(*map(F.lit, HEALTH))[F.min(rank).cast("int") - 1].alias("status"))


def memory_status(used: Column, threshold: float) -> Column:
    return F.when(used / threshold * 100 >= 150, "critical").when(used / threshold * 100 >= 100, "warning").otherwise("ok")


def approaching_timeout(elapsed: Column, timeout: float, buffer: float = 50) -> Column:
    return elapsed >= timeout - buffer


def benchmark(rows: DataFrame, files: str, size: str, seconds: str, memory: str) -> DataFrame:
    """Totals, files and MB a second (0 without time), peak memory."""
    out = rows.agg(F.sum(files).alias("files"), F.sum(size).alias("bytes"), F.sum(seconds).alias("seconds"), F.max(memory).alias("peak_memory"))
    rate = lambda c: F.when(F.col("seconds") > 0, c / F.col("seconds")).otherwise(0.0)
    return out.withColumn("files_per_s", rate(F.col("files"))).withColumn("mb_per_s", rate(F.col("bytes") / 1048576))


def catalog_tables(spark: SparkSession, expected: list[str] | None = None) -> DataFrame:
    """Tables of the catalog: present, missing or extra against those expected."""
    there = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "table_name string")
    return compare_catalog(there, there if expected is None else spark.createDataFrame([(n,) for n in expected], "table_name string"))


def analyse_plan(df: DataFrame) -> dict:
    """Findings on a frame's physical plan and a score from 0 to 100.

    A scan without a pushed filter costs 20, each warning 10: products of tables, row-by-row Python, and
    sorts of everything in one partition.
    """
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    warnings = []
    if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan):
        warnings.append("product of tables: add join conditions")
    if "BatchEvalPython" in plan:
        warnings.append("row-by-row Python: use column functions or pandas_udf")
    if re.search(r"Exchange\n.*SinglePartition|SinglePartition", plan):
        warnings.append("all rows in one partition")
    scans = len(set(re.findall(r"\((\d+)\) Scan ", plan)))
    pushed = len(re.findall(r"PushedFilters: \[(?!\])", plan))
    score = 100 - (20 if scans > pushed else 0) - 10 * len(warnings)
    return {"scans": scans, "pushed": pushed, "exchanges": len(set(re.findall(r"\((\d+)\) Exchange", plan))), "warnings": warnings, "score": max(0, score)}


def compare_plans(a: DataFrame, b: DataFrame) -> dict:
    x, y = analyse_plan(a), analyse_plan(b)
    return {"first": x["score"], "second": y["score"], "better": "first" if x["score"] > y["score"] else "second" if y["score"] > x["score"] else "equal"}


def search_metrics(samples: DataFrame, timeout_ms: float = 300, *group: str) -> DataFrame:
    """lexical_ms, vector_ms, ranking_ms, total_ms, candidates and sla_violation of phase timings.

    samples: phase (lexical, vector, ranking), ms, candidates, unique_candidates (may be null); where no
    unique count is given it is the sum of the phases' candidates.
    """
    of = lambda phase: F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col("ms"))), F.lit(0.0)).alias(f"{phase}_ms")
    out = samples.groupBy(*group).agg(of("lexical"), of("vector"), of("ranking"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"), F.coalesce(F.max("unique_candidates"), F.sum("candidates"), F.lit(0)).alias("unique_candidates"))
    return out.withColumn("sla_violation", F.col("total_ms") > timeout_ms)


def slow_queries(log: DataFrame, threshold_ms: float = 100) -> DataFrame:
    """Rows of a query log that took longer."""
    return log.filter(F.col("duration_ms") > threshold_ms)


def write_log(rows: DataFrame, folder: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(folder)
