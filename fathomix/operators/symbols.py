"""Symbol lookup: exact, prefix, substring and fuzzy names, k-gram postings, definitions, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomix.functions import text as X

#: Kinds by precedence.
KINDS = ("function", "class", "interface", "type", "enum", "constant", "component", "method")
ORDER = ("name", "file_path", "line")


def exact(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("name") == name)


def prefix(symbols: DataFrame, start: str, limit: int | None = 50) -> DataFrame:
    found = symbols.filter(F.lower("name").startswith(start.lower()))
    return found.orderBy(*ORDER).limit(limit) if limit is not None else found


def substring(symbols: DataFrame, part: str, limit: int | None = 50) -> DataFrame:
    found = symbols.filter(F.lower("name").contains(part.lower()))
    return found.orderBy(*ORDER).limit(limit) if limit is not None else found


def fuzzy(symbols: DataFrame, name: str, most: int = 2, limit: int | None = 50) -> DataFrame:
    """Symbols within an edit distance, nearest first; the bounded distance stops early."""
    near = F.levenshtein(F.lower("name"), F.lit(name.lower()), most)
    found = symbols.withColumn("distance", near).filter("distance >= 0")
    return found.orderBy("distance", *ORDER).limit(limit) if limit is not None else found


def postings(names: DataFrame, k: int = 3, padded: bool = True) -> DataFrame:
    """(kgram, name), distinct, of lower-cased names."""
    cut = X.padded_kgrams if padded else X.grams
    return names.select("name").distinct().select(F.explode(F.array_distinct(cut(F.lower("name"), k))).alias("kgram"), "name")


def candidates_any(posting: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Names that share a padded k-gram with a query."""
    wanted = _grams(f"${query.lower()}$", k)
    return posting.filter(F.col("kgram").isin(wanted)).select("name").distinct() if wanted else posting.select("name").distinct()


def candidates_all(posting: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Names with all k-grams of a query, none if it is shorter; postings without padding."""
    wanted = sorted(set(_grams(query.lower(), k)))
    if not wanted:
        return posting.select("name").limit(0)
    return posting.filter(F.col("kgram").isin(wanted)).groupBy("name").agg(F.count_distinct("kgram").alias("n")).filter(F.col("n") == len(wanted)).select("name")


def _grams(text: str, k: int) -> list[str]:
    return [text[i : i + k] for i in range(len(text) - k + 1)]


def kind_rank(kind: Column | str) -> Column:
    out = None
    for i, k in enumerate(KINDS):
        hit = F.col(kind) == k if isinstance(kind, str) else kind == k
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(len(KINDS))


def definitions(symbols: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Symbols of a name, or of any class's method of that name where there is none."""
    own = exact(symbols, name)
    methods = symbols.filter((F.col("kind") == "method") & (F.substring_index("name", ".", -1) == name))
    fallback = methods.join(own.select(F.lit(True).alias("found")).limit(1), how="left_anti", on=F.lit(True))
    return own.unionByName(fallback).orderBy(kind_rank("kind"), *ORDER).limit(limit)


def references(symbols: DataFrame, edges: DataFrame, imports: DataFrame, exports: DataFrame, name: str) -> DataFrame:
    """file_path and reference_type of files that define, import, export or call a name.

    A file with several is listed once: definition before import, export and call.
    """
    parts = [
        symbols.filter((F.col("name") == name) | (F.substring_index("name", ".", -1) == name)).select("file_path", F.lit(0).alias("rank")),
        imports.filter((F.col("imported") == name) | (F.col("local") == name)).select("file_path", F.lit(1).alias("rank")),
        exports.filter((F.col("exported") == name) | (F.col("local") == name)).select("file_path", F.lit(2).alias("rank")),
        edges.filter(F.col("callee") == name).select("file_path", F.lit(3).alias("rank")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    names = F.array(*map(F.lit, ("definition", "import", "export", "call")))
    return every.groupBy("file_path").agg(F.min("rank").alias("rank")).select("file_path", names[F.col("rank")].alias("reference_type"))


def callers(edges: DataFrame, symbols: DataFrame, name: str, one_per_file: bool = False) -> DataFrame:
    """file_path, caller and the caller's line of every function that calls a name."""
    calls = edges.filter(F.col("callee") == name).select("file_path", F.col("caller").alias("name")).distinct()
    out = calls.join(symbols.select("file_path", "name", "line"), ["file_path", "name"], "left").groupBy("file_path", "name").agg(F.min("line").alias("line"))
    if one_per_file:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("line", "name"))).filter("n = 1").drop("n")
    return out.withColumnRenamed("name", "caller")


def callees(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """callee and its first definition, of everything a function or a method of that name calls."""
    called = edges.filter((F.col("caller") == name) | (F.substring_index("caller", ".", -1) == name)).select(F.col("callee").alias("name")).distinct()
    first = F.row_number().over(Window.partitionBy("name").orderBy(kind_rank("kind"), "file_path", "line"))
    return called.join(symbols.join(called, "name", "left_semi").withColumn("n", first).filter("n = 1").drop("n"), "name", "left").withColumnRenamed("name", "callee")


def statistics(symbols: DataFrame, k: int = 3) -> DataFrame:
    """n_symbols, n_names, n_kgrams."""
    grams_of = F.explode(F.array_distinct(X.padded_kgrams(F.lower("name"), k)))
    names = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    counted = names.agg(F.sum("n").alias("n_symbols"), F.count(F.lit(1)).alias("n_names"))
    kgrams = names.select(grams_of.alias("g")).distinct().agg(F.count(F.lit(1)).alias("n_kgrams"))
    return counted.withColumn("one", F.lit(1)).join(F.broadcast(kgrams.withColumn("one", F.lit(1))), "one").drop("one")
