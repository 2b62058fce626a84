"""Ranked search: dense, hybrid, BM25, and search for literals or patterns in lines."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomix.functions import vectors as V
from fathomix.operators.sparse import index_scores, sparse_scores
from fathomix.storage import Scratch

DENSE_WEIGHT, SPARSE_WEIGHT = 0.6, 0.4
K1, B = 1.2, 0.75
#: Signs of code in a query, any of which is enough.
CODE_SIGNS = {
    "braces": re.compile(r"[{}\[\]]"),
    "statement end": re.compile(r";"),
    "call": re.compile(r"[A-Za-z_]\w*\s*\("),
    "member": re.compile(r"[A-Za-z_]\w*(?:\.|::|->)[A-Za-z_]"),
    "operator": re.compile(r"=>|==|[<>]"),
    "capital": re.compile(r"(?<![A-Za-z0-9_])[A-Z]\w*"),
    "file extension": re.compile(r"\.[a-z]{1,4}(?![a-z0-9])"),
}
WORDS = r"([\p{L}\p{N}_]+)"


def looks_like_code(query: str) -> bool:
    return any(sign.search(query) for sign in CODE_SIGNS.values())


def literal_vector(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dense_scores(vectors: DataFrame, vector: str, query: list[float], name: str = "dense_score") -> DataFrame:
    """vectors with their inner product with a query vector."""
    return vectors.withColumn(name, V.dot(F.col(vector), literal_vector(query)))


def top(rows: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k best rows; ties go by the named columns."""
    return rows.orderBy(F.desc(score), *ties).limit(k)


def dense_topk(vectors: DataFrame, vector: str, query: list[float], k: int, *ties: str, where: Column | None = None) -> DataFrame:
    """The k vectors nearest to a query among those that a condition allows, such as a model or a partition; it
    reaches the scan, so a partition that it rules out is not read."""
    allowed = vectors.filter(where) if where is not None else vectors
    return top(dense_scores(allowed, vector, query), "dense_score", k, *ties)


def weights_for(query: str, sparse: float = SPARSE_WEIGHT) -> tuple[float, float]:
    """(dense, sparse) weights; a query that looks like code moves 0.15 to the sparse side."""
    w = sparse + 0.15 if looks_like_code(query) else sparse
    return max(0.0, 1 - w), w


def hybrid_search(docs: DataFrame, dense: DataFrame, query: str, query_vector: list[float], k: int = 10, doc_id: str = "doc_id", text: str = "text", dense_id: str | None = None, vector: str = "embedding", dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, where: Column | None = None) -> DataFrame:
    """id, score, dense_score, sparse_score of the k best documents that have a text and a vector.

    Both scores are computed next to the scans; only (id, score) rows are joined.
    """
    docs = docs.filter(where) if where is not None else docs
    sparse = sparse_scores(docs.select(doc_id, text), text, query).select(doc_id, "sparse_score")
    scored = dense_scores(dense, vector, query_vector).select(F.col(dense_id or doc_id).alias(doc_id), "dense_score")
    return _weighted(sparse.join(scored, doc_id), k, doc_id, dense_weight, sparse_weight)


def stored_search(ids: DataFrame, vectors: DataFrame, dense: DataFrame, query: str, query_vector: list[float], k: int = 10, doc_id: str = "doc_id", dense_id: str | None = None, vector: str = "embedding", dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, where: Column | None = None, norm: str | None = None) -> DataFrame:
    """The same from a stored index: no text is read, and of the sparse vectors only the query's buckets.

    ``ids``: a row for each document, with the columns of ``where``.  A document that shares no bucket
    has a sparse score of 0.  ``norm``: a column of ids with the lengths of vectors, where those hold counts (tf).
    """
    ids = (ids.filter(where) if where is not None else ids).select(doc_id, *([norm] if norm else []))
    scored = dense_scores(dense, vector, query_vector).select(F.col(dense_id or doc_id).alias(doc_id), "dense_score")
    both = ids.join(scored, doc_id).join(index_scores(vectors, doc_id, query, weight="tf" if norm else "weight"), doc_id, "left")
    both = both.withColumn("sparse_score", F.col("sparse_score") / F.col(norm)) if norm else both
    return _weighted(both.withColumn("sparse_score", F.coalesce("sparse_score", F.lit(0.0))), k, doc_id, dense_weight, sparse_weight)


def _weighted(both: DataFrame, k: int, doc_id: str, dense_weight: float, sparse_weight: float) -> DataFrame:
    scored = both.withColumn("score", dense_weight * F.col("dense_score") + sparse_weight * F.col("sparse_score"))
    return top(scored.select(doc_id, "score", "dense_score", "sparse_score"), "score", k, doc_id)


def federated(results: list[DataFrame], k: int, *ties: str) -> DataFrame:
    """The k best of several indexes' results, with the number of the index."""
    every = None
    for i, r in enumerate(results):
        r = r.withColumn("index_no", F.lit(i))
        every = r if every is None else every.unionByName(r)
    return top(every, "score", k, *(ties or ("index_no",)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), 1)


def query_terms(spark, query: str, stem=None) -> list[str]:
    """The different words of a query, or their stems."""
    terms = sorted(set(re.findall(r"[^\W]+", query.lower())))
    if stem and terms:
        terms = sorted({t for t in spark.range(1).select(stem(F.array(*map(F.lit, terms)))).first()[0]})
    return terms


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stem=None) -> DataFrame:
    """(id, term, tf, n): the words of each document, how often it holds them, and how many it holds in all.

    A document without words has one row with a null term, so that it counts in the corpus.
    """
    tokens = words(F.col(text))
    each = docs.select(doc_id, F.coalesce(stem(tokens) if stem else tokens, F.array().cast("array<string>")).alias("w"))
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("n", T.IntegerType())])

    def run(batches):
        for batch in batches:
            # A document's words are in one row, so they are counted where they are; rows leave by term.
            n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = batch.column(1).flatten().dictionary_encode()
            names = coded.dictionary.take(pc.array_sort_indices(coded.dictionary))
            codes = pc.index_in(coded.dictionary, names).to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            cells, tf = np.unique(codes * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
            none = np.flatnonzero(n == 0)
            row = np.concatenate([cells % max(len(n), 1), none])
            term = pa.concat_arrays([names.take(pa.array(cells // max(len(n), 1))).cast(pa.string()), pa.nulls(len(none), pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), term, pa.array(np.concatenate([tf, none * 0]).astype(np.int64)), pa.array(n[row].astype(np.int32))], names=[doc_id, "term", "tf", "n"])

    return each.mapInArrow(run, schema)


def corpus_statistics(posting: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row: the documents of a postings table, and their mean number of words."""
    return posting.select(doc_id, "n").distinct().agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"))


def _bm25(tf: Column, n: Column, df: int, total: int, mean: float) -> Column:
    idf = F.log(F.lit(1 + (total - df + 0.5) / (df + 0.5)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / (mean or 1.0)))


def bm25_stored(posting: DataFrame, statistics: DataFrame, query: str, k: int = 200, doc_id: str = "doc_id", stem=None) -> DataFrame:
    """id and bm25 of the k best documents, from stored postings: only the rows of the query's words are read."""
    terms = query_terms(posting.sparkSession, query, stem)
    found = posting.filter(F.col("term").isin(*terms)) if terms else posting.limit(0)
    total, mean = statistics.first()
    counts = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}  # at most the query's words
    score = F.lit(0.0)
    for term, df in counts.items():
        score = F.when(F.col("term") == term, _bm25(F.col("tf"), F.col("n"), df, total, mean)).otherwise(score)
    return top(found.groupBy(doc_id).agg(F.sum(score).alias("bm25")), "bm25", k, doc_id)


def bm25(docs: DataFrame, query: str, k: int = 200, doc_id: str = "doc_id", text: str = "text", stem=None) -> DataFrame:
    """id and bm25 of the k best documents that hold a word of the query, in one pass over the texts.

    Words are cut once for each text; what is stored for the second step, which needs the corpus
    statistics, is a row of counts for each document that holds a word of the query.
    ``stem``: a column function for each word list, such as porter().
    """
    terms = query_terms(docs.sparkSession, query, stem)
    if not terms:
        return docs.select(doc_id, F.lit(0.0).alias("bm25")).limit(0)
    tokens = stem(words(F.col(text))) if stem else words(F.col(text))
    # Of a text's words, those of the query: what array_position finds is looked up once a word.
    wanted = F.array(*map(F.lit, terms))
    cut = docs.select(doc_id, tokens.alias("w")).select(doc_id, F.greatest(F.size("w"), F.lit(0)).alias("n"), F.filter(F.transform("w", lambda x: F.array_position(wanted, x).cast("int")), lambda p: p > 0).alias("hits"))
    scratch = Scratch(docs.sparkSession, "bm25")
    counted = scratch.write(cut.select(doc_id, "n", *(F.greatest(F.size("hits") - F.size(F.array_remove("hits", i + 1)), F.lit(0)).alias(f"tf{i}") for i in range(len(terms)))))
    stats = counted.agg(F.count(F.lit(1)), F.coalesce(F.avg("n"), F.lit(0.0)), *(F.count_if(F.col(f"tf{i}") > 0) for i in range(len(terms)))).first()
    total, mean, found = stats[0], stats[1], stats[2:]
    score = F.lit(0.0)
    for i, df in enumerate(found):
        score = score + F.when(F.col(f"tf{i}") > 0, _bm25(F.col(f"tf{i}"), F.col("n"), df, total, mean)).otherwise(0.0)
    return top(counted.select(doc_id, score.alias("bm25")).filter("bm25 > 0"), "bm25", k, doc_id)


def pattern_of(query: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False) -> str:
    p = query if regex else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", query)
    return ("(?i)" if ignore_case else "") + (rf"\b(?:{p})\b" if whole_word else p)


def text_search(docs: DataFrame, query: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False, doc_id: str = "doc_id", text: str = "text", limit: int | None = None, offset: int = 0) -> DataFrame:
    """id, line (from 1) and context of every line with a match; documents are filtered before lines are.

    With a limit or an offset, a page of them in the order of id and line.
    """
    p = pattern_of(query, regex, ignore_case, whole_word)
    found = docs.filter(F.col(text).rlike(p))
    out = found.select(doc_id, F.posexplode(F.split(text, "\n")).alias("line", "context")).filter(F.col("context").rlike(p)).withColumn("line", F.col("line") + 1)
    if limit is not None or offset:
        out = out.orderBy(doc_id, "line").offset(offset)
        out = out.limit(limit) if limit is not None else out
    return out


def relevance(matches: Column, size: Column, mean_line: Column, exact: Column) -> Column:
    """A heuristic from 0 to 100: matches, exactness, a small file, early lines."""
    score = F.least(matches * 10, F.lit(50)) + F.when(exact, 30).otherwise(0) - F.when(size > 100000, 10).otherwise(0) + F.when(mean_line < 50, 10).otherwise(0)
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))
