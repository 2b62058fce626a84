"""Hashed character n-gram vectors, their cosine, and hash embeddings.

A vector's buckets are FNV-1a hashes of the 3- to 5-grams of a text with normalised white space, modulo
2**18; its weights are counts divided by their Euclidean length.  Hashing is done with numpy in Arrow
batches: the same as an SQL expression is interpreted and many times slower.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW, HIGH, BUCKETS = 3, 5, 1 << 18
#: The characters that count as white space, the same as functions.text.SPACE.
SPACE = re.compile(r"[\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
#: Fixed value: what is a word of the hash embedding.
TOKEN = re.compile(r"[a-z0-9_]+|[^\s]")
#: Characters of the texts that are hashed at once: about a hundred bytes of memory for each.
PART_CHARS = 1 << 18
#: Characters of the texts whose cells are sorted together, of some 50 bytes of memory each.
SEGMENT_CHARS = 1 << 22


def gram_hashes(text: str, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """FNV-1a hashes of all n-grams, over UTF-16 code units."""
    x = np.frombuffer(SPACE.sub(" ", text).strip(" ").encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
    out = []
    h = np.full(len(x), 2166136261, np.uint32)
    for k in range(high):
        if len(x) - k <= 0:
            break
        h = (h[: len(x) - k] ^ x[k:]) * np.uint32(16777619)
        if k + 1 >= low:
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def gram_counts(text: str | None, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a text, by bucket."""
    return np.unique(gram_hashes(text or "", low, high) % np.uint32(buckets), return_counts=True)


def _batch_cells(texts: list[str | None], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of several texts, by row and bucket."""
    hashes = [gram_hashes(t or "", low, high) for t in texts]
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), [len(h) for h in hashes])
    cells, counts = np.unique(rows * buckets + np.concatenate([*hashes, np.zeros(0, np.uint32)]).astype(np.int64) % buckets, return_counts=True)
    return cells // buckets, cells % buckets, counts


def _parts(texts: pa.Array, most: int = PART_CHARS):
    """(first, texts) of parts of about so many characters."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def sparse_vectors(docs: DataFrame, doc_id: str, text: str, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """(id, bucket, tf, weight), one row for each bucket of each document; no shuffle."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, kind), T.StructField("bucket", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("weight", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for first, part in _parts(batch.column(1)):
                row, bucket, n = _batch_cells(part, low, high, buckets)
                norm = np.sqrt(np.bincount(row, n * n, len(part)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(n / norm[row])], names=[doc_id, "bucket", "tf", "weight"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def sorted_cells(docs: DataFrame, doc_id: str, text: str, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, most: int = SEGMENT_CHARS) -> DataFrame:
    """(id, bucket, tf), one row for each bucket of each document; within segments of about ``most`` characters by bucket.

    Written as it comes, a bucket's rows are skipped by the statistics of pages, and nothing is shuffled or spilled.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, kind), T.StructField("bucket", T.IntegerType()), T.StructField("tf", T.IntegerType())])

    def run(batches):
        for batch in batches:
            held, chars = [], 0
            for first, part in _parts(batch.column(1)):
                row, bucket, n = _batch_cells(part, low, high, buckets)
                held.append([x.astype(np.int32) for x in (row + first, bucket, n)])
                chars += sum(len(t or "") for t in part)
                if chars >= most or first + len(part) == batch.num_rows:
                    row, bucket, n = (np.concatenate(x) for x in zip(*held, strict=True))
                    order, held, chars = np.argsort(bucket, kind="stable"), [], 0
                    for k in range(0, len(order), 1 << 18):
                        at = order[k : k + (1 << 18)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), pa.array(bucket[at]), pa.array(n[at])], names=[doc_id, "bucket", "tf"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def sparse_rows(docs: DataFrame, doc_id: str, text: str, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """(id, columns, values): the vector of each document that has a bucket as a row, by bucket.

    The same as compressed_rows of sparse_vectors, but cells are never rows of their own, so nothing is shuffled.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, kind), T.StructField("columns", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for first, part in _parts(batch.column(1)):
                row, bucket, n = _batch_cells(part, low, high, buckets)
                norm = np.sqrt(np.bincount(row, n * n, len(part)))
                some = np.unique(row)
                starts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part))[some])]).astype(np.int32))
                cells = [pa.array(bucket.astype(np.int32)), pa.array(n / norm[row])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + first)), *(pa.ListArray.from_arrays(starts, c) for c in cells)], names=[doc_id, "columns", "values"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def sparse_scores(docs: DataFrame, text: str, query: str, name: str = "sparse_score", low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """docs with the sparse cosine of each text and a query, in one pass over the texts."""
    qb, qn = gram_counts(query.lower(), low, high, buckets)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        table = np.zeros(buckets)
        table[qb] = qn / max(np.sqrt((qn * qn).sum()), 1e-300)
        out = np.zeros(len(texts))
        for first, part in _parts(texts):
            row, bucket, n = _batch_cells(part, low, high, buckets)
            dot, squared = np.bincount(row, table[bucket] * n, len(part)), np.bincount(row, n * n, len(part))
            out[first : first + len(part)] = dot / np.sqrt(np.maximum(squared, 1))
        return pa.array(out)

    return docs.withColumn(name, score(F.lower(F.col(text))))


def index_scores(vectors: DataFrame, doc_id: str, query: str, name: str = "sparse_score", low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, weight: str = "weight") -> DataFrame:
    """(id, score) from stored vectors: the query's few buckets are a filter that reaches the scan, sums meet by document."""
    qb, qn = gram_counts(query.lower(), low, high, buckets)
    if not len(qb):
        return vectors.select(doc_id, F.lit(0.0).alias(name)).limit(0)
    size = float(np.sqrt((qn * qn).sum()))
    weights = F.create_map(*(F.lit(x) for b, n in zip(qb.tolist(), qn.tolist(), strict=True) for x in (int(b), float(n) / size)))
    return vectors.filter(F.col("bucket").isin(qb.tolist())).groupBy(doc_id).agg(F.sum(F.col(weight) * F.element_at(weights, F.col("bucket"))).alias(name))


def compressed_rows(vectors: DataFrame, doc_id: str) -> DataFrame:
    """(id, columns, values): a vector a row, by bucket."""
    cells = F.array_sort(F.collect_list(F.struct("bucket", "weight")))
    return vectors.groupBy(doc_id).agg(cells.alias("c")).select(doc_id, F.col("c.bucket").alias("columns"), F.col("c.weight").alias("values"))


def expanded_rows(rows: DataFrame, doc_id: str) -> DataFrame:
    """(id, bucket, weight) of compressed rows."""
    return rows.select(doc_id, F.explode(F.arrays_zip("columns", "values")).alias("c")).select(doc_id, F.col("c.columns").alias("bucket"), F.col("c.values").alias("weight"))


def token_hash(token: str) -> int:
    h = 2166136261
    for c in np.frombuffer(token.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h


def hash_vector(text: str | None, dim: int) -> np.ndarray:
    v = np.zeros(dim)
    seen: dict[str, int] = {}
    for token in TOKEN.findall((text or "").lower()):
        at = seen.get(token)
        if at is None:
            at = seen[token] = token_hash(token) % dim
        v[at] += 1
    return v / (np.sqrt(v @ v) or 1)


def hash_embedding(docs: DataFrame, text: str, dim: int = 384, name: str = "embedding") -> DataFrame:
    """docs with a unit vector of hashed words; the default embedder, as it needs no model."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts):
        return texts.map(lambda t: hash_vector(t, dim))

    return docs.withColumn(name, embed(text))


class Embedders:
    """Named functions from a list of texts to a list of vectors, run in Arrow batches."""

    registered: dict[str, object] = {"hash": lambda texts: [hash_vector(t, 384) for t in texts]}

    @classmethod
    def register(cls, name: str, embed) -> None:
        cls.registered[name] = embed

    @classmethod
    def apply(cls, docs: DataFrame, text: str, embedder: str = "hash", name: str = "embedding") -> DataFrame:
        embed = cls.registered[embedder]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(texts):
            import pandas as pd

            return pd.Series(list(embed(texts.fillna("").tolist())))

        return docs.withColumn(name, run(text))
