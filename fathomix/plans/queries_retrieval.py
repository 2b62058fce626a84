"""Queries of vectors, search, symbols and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomix.functions import paths as P
from fathomix.functions import text as X
from fathomix.functions import vectors as V
from fathomix.operators import ranking, search, sparse, symbols
from fathomix.plans.registry import ORACLE_SQL, query, table
from fathomix.storage import temporary_folder

QUERY = "the intention of this and that"

#: Characters of normalised lower-cased documents, and the FNV-1a hashes of the 3- to 5-grams from each.
_GRAMS = """
t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM docs),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM t WHERE length(t) > 0),
w AS (SELECT doc_id, ascii(ch) AS a, lead(ascii(ch), 1) OVER s AS b, lead(ascii(ch), 2) OVER s AS c, lead(ascii(ch), 3) OVER s AS d, lead(ascii(ch), 4) OVER s AS e FROM c WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
h2 AS (SELECT *, (xor((xor(CAST(2166136261 AS BIGINT), CAST(a AS BIGINT)) * 16777619) & 4294967295, CAST(b AS BIGINT)) * 16777619) & 4294967295 AS h2 FROM w),
h3 AS (SELECT *, (xor(h2, CAST(c AS BIGINT)) * 16777619) & 4294967295 AS h3 FROM h2),
h4 AS (SELECT *, (xor(h3, CAST(d AS BIGINT)) * 16777619) & 4294967295 AS h4 FROM h3),
h5 AS (SELECT *, (xor(h4, CAST(e AS BIGINT)) * 16777619) & 4294967295 AS h5 FROM h4),
g AS (SELECT doc_id, h3 % 262144 AS bucket FROM h5 WHERE h3 IS NOT NULL UNION ALL SELECT doc_id, h4 % 262144 FROM h5 WHERE h4 IS NOT NULL UNION ALL SELECT doc_id, h5 % 262144 FROM h5 WHERE h5 IS NOT NULL),
v AS (SELECT doc_id, bucket, count(*) AS tf FROM g GROUP BY doc_id, bucket),
n AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM v GROUP BY doc_id)"""

_SPARSE = f"""
WITH docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '{QUERY}'), {_GRAMS},
s AS (SELECT a.doc_id, sum(a.tf * q.tf) AS dot FROM v a JOIN v q ON a.bucket = q.bucket AND q.doc_id = -1 WHERE a.doc_id >= 0 GROUP BY a.doc_id),
sparse AS (SELECT doc_id, coalesce(dot, 0) / (norm * (SELECT norm FROM n WHERE doc_id = -1)) AS sparse_score FROM n LEFT JOIN s USING (doc_id) WHERE doc_id >= 0)"""

_DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _vector(spark, d, vec_id: int = 0) -> list[float]:
    """One stored vector, as a query."""
    row = table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def paths(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with a file path made of the id."""
    k = F.col(key)
    folder = F.element_at(F.array(*map(F.lit, ("src", "lib", "tests", "docs", "packages/core"))), (k % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("ts", "py", "js", "test.ts", "md"))), (k % 7 % 5 + 1).cast("int"))
    return docs.withColumn("file_path", F.concat(folder, F.lit("/module_"), F.floor(k / 100).cast("string"), F.lit("/file_"), k.cast("string"), F.lit("."), ext))


PATH_SQL = "(['src', 'lib', 'tests', 'docs', 'packages/core'])[CAST({k} % 5 + 1 AS INT)] || '/module_' || CAST(CAST(floor({k} / 100) AS BIGINT) AS VARCHAR) || '/file_' || CAST({k} AS VARCHAR) || '.' || (['ts', 'py', 'js', 'test.ts', 'md'])[CAST({k} % 7 % 5 + 1 AS INT)]"

KIND_NAMES = ("function", "class", "interface", "type", "enum", "constant", "component")
SYMBOLS_SQL = f"""
l AS (SELECT doc_id, {PATH_SQL.format(k="doc_id")} AS file_path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
symbols AS (SELECT * FROM (SELECT file_path, line, regexp_extract(t, '([A-Za-z]+)', 1) AS name, (['function', 'class', 'interface', 'type', 'enum', 'constant', 'component'])[CAST(line % 7 + 1 AS INT)] AS kind FROM l) WHERE name <> '')"""


def symbol_table(spark, d) -> DataFrame:
    """The first word of every line as a symbol at that line."""
    lines = paths(table(spark, d, "documents")).select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("line", F.col("line") + 1)
    kind = F.element_at(F.array(*map(F.lit, KIND_NAMES)), F.col("line") % 7 + 1)
    return lines.select("file_path", F.col("line").cast("long").alias("line"), F.regexp_extract("t", "([A-Za-z]+)", 1).alias("name"), kind.alias("kind")).filter("name <> ''")


@query(f"{_SPARSE} SELECT doc_id, round(sparse_score, 6) AS sparse_score FROM sparse")
def rnk04_sparse_cosine(spark, d):
    """Sparse cosine of every document and a query."""
    scored = sparse.sparse_scores(table(spark, d, "documents"), "text", QUERY)
    return scored.select("doc_id", F.round("sparse_score", 6).alias("sparse_score"))


@query(f"WITH docs AS (SELECT doc_id, text FROM documents), {_GRAMS} SELECT v.doc_id, count(*) AS n_buckets, CAST(sum(tf) AS BIGINT) AS n_grams, round(max(tf / norm), 6) AS greatest, CAST(sum(bucket * tf) AS BIGINT) AS checksum FROM v JOIN n USING (doc_id) GROUP BY v.doc_id")
def rnk03_sparse_vectors(spark, d):
    """The sparse vector of every document, summarised."""
    docs = table(spark, d, "documents").withColumn("text", F.lower("text"))
    v = sparse.sparse_vectors(docs, "doc_id", "text")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_buckets"), F.sum("tf").alias("n_grams"), F.round(F.max("weight"), 6).alias("greatest"), F.sum(F.col("bucket") * F.col("tf")).alias("checksum"))


@query(f"{_SPARSE} SELECT doc_id, round(sparse_score, 6) AS sparse_score FROM sparse WHERE sparse_score > 0")
def join03_sparse_index(spark, d):
    """Sparse cosine from stored vectors, by a join on buckets."""
    docs = table(spark, d, "documents").withColumn("text", F.lower("text"))
    return sparse.index_scores(sparse.sparse_vectors(docs, "doc_id", "text"), "doc_id", QUERY).select("doc_id", F.round("sparse_score", 6).alias("sparse_score"))


@query(f"WITH docs AS (SELECT doc_id, text FROM documents), {_GRAMS.replace('lower(text)', 'text')} SELECT v.doc_id, count(*) AS n_buckets, round(sum((tf / norm) * (tf / norm)), 6) AS squared FROM v JOIN n USING (doc_id) GROUP BY v.doc_id")
def rnk05_compressed_rows(spark, d):
    """Vectors as sorted rows and back, summarised."""
    docs = table(spark, d, "documents")
    rows = sparse.sparse_rows(docs, "doc_id", "text")
    return sparse.expanded_rows(rows, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_buckets"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squared"))


@query(f"SELECT vec_id, round({_DOT.format(a='embedding', b=_QUERY_VECTOR)}, 5) AS dense_score FROM embeddings")
def rnk09_dense_scores(spark, d):
    """Inner product of every vector with a query vector."""
    scored = search.dense_scores(table(spark, d, "embeddings"), "embedding", _vector(spark, d))
    return scored.select("vec_id", F.round("dense_score", 5).alias("dense_score"))


@query(f"SELECT vec_id, round({_DOT.format(a='embedding', b=_QUERY_VECTOR)}, 5) AS dense_score FROM embeddings ORDER BY {_DOT.format(a='embedding', b=_QUERY_VECTOR)} DESC, vec_id LIMIT 10")
def rnk35_dense_topk(spark, d):
    """The 10 vectors nearest to a query vector."""
    best = search.top(search.dense_scores(table(spark, d, "embeddings"), "embedding", _vector(spark, d)), "dense_score", 10, "vec_id")
    return best.select("vec_id", F.round("dense_score", 5).alias("dense_score"))


@query(f"SELECT vec_id, label, round({_DOT.format(a='embedding', b=_QUERY_VECTOR)}, 5) AS dense_score FROM embeddings WHERE label IN (1, 3) ORDER BY {_DOT.format(a='embedding', b=_QUERY_VECTOR)} DESC, vec_id LIMIT 10")
def rnk35_filtered_topk(spark, d):
    """The 10 nearest vectors of two labels."""
    best = search.dense_topk(table(spark, d, "embeddings"), "embedding", _vector(spark, d), 10, "vec_id", where=F.col("label").isin(1, 3))
    return best.select("vec_id", "label", F.round("dense_score", 5).alias("dense_score"))


@query(f"SELECT vec_id, round({_DOT.format(a='embedding', b=_QUERY_VECTOR)} / sqrt({_DOT.format(a='embedding', b='embedding')} * {_DOT.format(a=_QUERY_VECTOR, b=_QUERY_VECTOR)}), 5) AS cosine FROM embeddings")
def rnk10_cosine(spark, d):
    """Full cosine of every vector and a query vector."""
    q = search.literal_vector(_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), q), 5).alias("cosine"))


@query(f"SELECT vec_id, round(sqrt({_DOT.format(a='embedding', b='embedding')}), 5) AS norm, len(embedding) = 64 AS is_valid, true AS same_after_codec, 1.0 AS unit FROM embeddings")
def rnk11_vector_checks(spark, d):
    """Length, validity, binary form and unit form of every vector."""
    e = F.col("embedding")
    out = table(spark, d, "embeddings").withColumn("back", V.decode(V.encode(e)))
    return out.select("vec_id", F.round(V.norm(e), 5).alias("norm"), V.is_valid(e, 64).alias("is_valid"), (F.col("back") == e).alias("same_after_codec"), F.round(V.norm(V.normalise(e)), 6).alias("unit"))


@query(f"""{_SPARSE}, dense AS (SELECT vec_id AS doc_id, {_DOT.format(a='embedding', b=_QUERY_VECTOR)} AS dense_score FROM embeddings)
SELECT doc_id, round(0.6 * dense_score + 0.4 * sparse_score, 5) AS score, round(dense_score, 5) AS dense_score, round(sparse_score, 5) AS sparse_score
FROM sparse JOIN dense USING (doc_id) ORDER BY 0.6 * dense_score + 0.4 * sparse_score DESC, doc_id LIMIT 10""")
def rnk12_hybrid_search(spark, d):
    """The 10 documents with the best weighted dense and sparse score."""
    best = search.hybrid_search(table(spark, d, "documents"), table(spark, d, "embeddings"), QUERY, _vector(spark, d), dense_id="vec_id")
    return best.select("doc_id", *(F.round(c, 5).alias(c) for c in ("score", "dense_score", "sparse_score")))


_STORED: dict[tuple, dict[str, str]] = {}


def stored_index(spark, d) -> dict[str, DataFrame]:
    """vectors (counts), postings and lengths of documents, as an index keeps them: written once an application, in segments
    sorted by what searches look for, without a shuffle of cells or words."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        docs = table(spark, d, "documents").select("doc_id", "text")
        folder = temporary_folder(spark, "stored")
        cells = sparse.sorted_cells(docs.withColumn("text", F.lower("text")), "doc_id", "text")
        # Both come sorted in segments; lengths are gathered from what is stored.
        for name, df in (("vectors", cells), ("postings", search.postings(docs))):
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        posting, cells = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/vectors")
        norms = cells.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf").cast("double") * F.col("tf"))).alias("norm"))
        posting.select("doc_id", "n").distinct().join(norms, "doc_id", "left").write.parquet(f"{folder}/lengths")
        _STORED[key] = {name: f"{folder}/{name}" for name in ("vectors", "postings", "lengths")}
    return {name: spark.read.parquet(path) for name, path in _STORED[key].items()}


@query(f"""{_SPARSE}, dense AS (SELECT vec_id AS doc_id, {_DOT.format(a='embedding', b=_QUERY_VECTOR)} AS dense_score FROM embeddings)
SELECT doc_id, round(0.6 * dense_score + 0.4 * coalesce(sparse_score, 0), 5) AS score, round(dense_score, 5) AS dense_score, round(coalesce(sparse_score, 0), 5) AS sparse_score
FROM documents JOIN dense USING (doc_id) LEFT JOIN sparse USING (doc_id) ORDER BY 0.6 * dense_score + 0.4 * coalesce(sparse_score, 0) DESC, doc_id LIMIT 10""")
def src14_stored_search(spark, d):
    """The same from a stored index: no text is read."""
    index = stored_index(spark, d)
    best = search.stored_search(index["lengths"], index["vectors"], table(spark, d, "embeddings"), QUERY, _vector(spark, d), dense_id="vec_id", norm="norm")
    return best.select("doc_id", *(F.round(c, 5).alias(c) for c in ("score", "dense_score", "sparse_score")))


@query(f"""{_SPARSE}, dense AS (SELECT vec_id AS doc_id, {_DOT.format(a='embedding', b=_QUERY_VECTOR)} AS dense_score FROM embeddings)
SELECT doc_id, round(0.45 * dense_score + 0.55 * sparse_score, 5) AS score FROM sparse JOIN dense USING (doc_id) JOIN documents USING (doc_id) WHERE lang = 'en'
ORDER BY 0.45 * dense_score + 0.55 * sparse_score DESC, doc_id LIMIT 20""")
def rnk13_code_aware_search(spark, d):
    """Hybrid search with a language filter and the weights of a query that looks like code."""
    dense_weight, sparse_weight = search.weights_for("f()")
    best = search.hybrid_search(table(spark, d, "documents"), table(spark, d, "embeddings"), QUERY, _vector(spark, d), 20, dense_id="vec_id", dense_weight=dense_weight, sparse_weight=sparse_weight, where=F.col("lang") == "en")
    return best.select("doc_id", F.round("score", 5).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+|[^\s]')) AS w FROM documents), c AS (SELECT w, [ascii(x) FOR x IN string_split(w, '')] AS u FROM (SELECT DISTINCT w FROM w)),
h AS (SELECT w, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(x AS BIGINT) FOR x IN u]), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS h FROM c), b AS (SELECT doc_id, h % 384 AS b, count(*) AS n FROM w JOIN h USING (w) GROUP BY 1, 2),
f AS (SELECT doc_id, count(*) AS n_used, max(n) / sqrt(sum(n * n)) AS g FROM b GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_used, 0) AS BIGINT) AS n_used, round(coalesce(g, 0), 6) AS greatest FROM documents LEFT JOIN f USING (doc_id)""")
def rnk08_hash_embedding(spark, d):
    """Hash embeddings of all documents, summarised."""
    e = sparse.hash_embedding(table(spark, d, "documents"), "text", 384)
    return e.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("n_used"), F.round(F.array_max("embedding"), 6).alias("greatest"))


@query(f"""WITH a AS (SELECT 0 AS index_no, vec_id, {_DOT.format(a='embedding', b=_QUERY_VECTOR)} AS s FROM embeddings WHERE label < 5), b AS (SELECT 1 AS index_no, vec_id, {_DOT.format(a='embedding', b=_QUERY_VECTOR)} AS s FROM embeddings WHERE label >= 5)
SELECT index_no, vec_id, round(s, 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY s DESC, index_no, vec_id LIMIT 15""")
def rnk36_federated(spark, d):
    """The best of two indexes."""
    scored = search.dense_scores(table(spark, d, "embeddings"), "embedding", _vector(spark, d), "score").select("vec_id", "label", "score")
    out = search.federated([scored.filter("label < 5"), scored.filter("label >= 5")], 15, "index_no", "vec_id")
    return out.select("index_no", "vec_id", F.round("score", 5).alias("score"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
q AS (SELECT unnest(['the', 'intention', 'thing', 'ver']) AS q), tf AS (SELECT doc_id, len(w) AS dl, q, len(list_filter(w, lambda x: x = q)) AS tf FROM w, q), df AS (SELECT q, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY q)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) AS bm25 FROM tf JOIN df USING (q), s WHERE tf > 0 GROUP BY doc_id ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))) DESC, doc_id LIMIT 200""")
def rnk34_bm25(spark, d):
    """The 200 documents that match words best."""
    return search.bm25(table(spark, d, "documents"), "the intention thing ver").select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(ORACLE_SQL["rnk34_bm25"])
def rnk34_stored_bm25(spark, d):
    """The same from stored postings."""
    index = stored_index(spark, d)
    statistics = index["lengths"].agg(F.count(F.lit(1)), F.coalesce(F.avg("n"), F.lit(0.0)))
    return search.bm25_stored(index["postings"], statistics, "the intention thing ver").select("doc_id", F.round("bm25", 6).alias("bm25"))


def _line_search(condition: str) -> str:
    return f"SELECT * FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS context FROM documents) WHERE {condition}"


@query(_line_search("contains(context, 'tion the')"))
def flt20_search_literal(spark, d):
    return search.text_search(table(spark, d, "documents"), "tion the").withColumn("line", F.col("line").cast("long"))


@query(_line_search("regexp_matches(context, '(?i)\\b(?:THING)\\b')"))
def flt20_search_word(spark, d):
    return search.text_search(table(spark, d, "documents"), "THING", ignore_case=True, whole_word=True).withColumn("line", F.col("line").cast("long"))


@query(_line_search("contains(context, 'thing')") + " ORDER BY doc_id, line LIMIT 20 OFFSET 15")
def flt20_search_page(spark, d):
    """A page of matching lines."""
    return search.text_search(table(spark, d, "documents"), "thing", limit=20, offset=15).withColumn("line", F.col("line").cast("long"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {PATH_SQL.format(k='doc_id')} AS p FROM documents) WHERE (p LIKE 'src/%' OR p LIKE '%.py') AND NOT p LIKE '%test%'")
def flt19_path_filters(spark, d):
    """Documents by patterns of their paths, and without others."""
    p = F.col("file_path")
    return paths(table(spark, d, "documents")).filter(P.matches_any(p, ["src/*", "*.py"]) & ~P.matches_any(p, ["*test*"])).select("doc_id")


@query(_line_search("regexp_matches(context, 'th[aeiou]{2}r\\w+')"))
def flt20_search_regex(spark, d):
    return search.text_search(table(spark, d, "documents"), r"th[aeiou]{2}r\w+", regex=True).withColumn("line", F.col("line").cast("long"))


@query(f"""WITH m AS ({_line_search("contains(context, 'thing')")}), g AS (SELECT doc_id, count(*) AS n, avg(line) AS a, bool_or(context = 'thing') AS exact FROM m GROUP BY doc_id)
SELECT doc_id, CAST(least(greatest(least(10 * n, 50) + CASE WHEN exact THEN 30 ELSE 0 END - CASE WHEN n_chars > 100000 THEN 10 ELSE 0 END + CASE WHEN a < 50 THEN 10 ELSE 0 END, 0), 100) AS BIGINT) AS relevance FROM g JOIN documents USING (doc_id)""")
def rnk32_relevance(spark, d):
    """Relevance of documents with a word, from their matching lines."""
    docs = table(spark, d, "documents")
    m = search.text_search(docs, "thing").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg("line").alias("a"), F.bool_or(F.col("context") == "thing").alias("exact"))
    return m.join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", search.relevance(F.col("n"), F.col("n_chars"), F.col("a"), F.col("exact")).cast("long").alias("relevance"))


@query(f"WITH {SYMBOLS_SQL} SELECT name, kind, file_path, line FROM symbols WHERE name = 'The'")
def rnk15_symbol_exact(spark, d):
    return symbols.exact(symbol_table(spark, d), "The").select("name", "kind", "file_path", "line")


@query(f"WITH {SYMBOLS_SQL} SELECT name, kind, file_path, line FROM symbols WHERE starts_with(lower(name), 'tha') ORDER BY name, file_path, line LIMIT 50")
def rnk16_symbol_prefix(spark, d):
    return symbols.prefix(symbol_table(spark, d), "THA").select("name", "kind", "file_path", "line")


@query(f"WITH {SYMBOLS_SQL} SELECT name, kind, file_path, line FROM symbols WHERE contains(lower(name), 'hat') ORDER BY name, file_path, line LIMIT 50")
def rnk17_symbol_substring(spark, d):
    return symbols.substring(symbol_table(spark, d), "hat").select("name", "kind", "file_path", "line")


@query(f"WITH {SYMBOLS_SQL} SELECT name, kind, file_path, line, levenshtein(lower(name), 'thing') AS distance FROM symbols WHERE levenshtein(lower(name), 'thing') <= 2 ORDER BY 5, name, file_path, line LIMIT 50")
def rnk18_symbol_fuzzy(spark, d):
    out = symbols.fuzzy(symbol_table(spark, d), "Thing")
    return out.select("name", "kind", "file_path", "line", F.col("distance").cast("long").alias("distance"))


_NAMES = f"WITH {SYMBOLS_SQL}, n AS (SELECT DISTINCT name, '$' || lower(name) || '$' AS p FROM symbols), k AS (SELECT DISTINCT name, substr(p, CAST(i AS INT), 3) AS kgram FROM (SELECT name, p, unnest(range(1, length(p) - 1)) AS i FROM n))"


@query(f"{_NAMES} SELECT kgram, count(*) AS n_names, min(name) AS first_name FROM k GROUP BY kgram")
def rnk19_kgram_postings(spark, d):
    return symbols.postings(symbol_table(spark, d)).groupBy("kgram").agg(F.count(F.lit(1)).alias("n_names"), F.min("name").alias("first_name"))


@query(f"{_NAMES} SELECT DISTINCT name FROM k WHERE kgram IN ('$th', 'thi', 'hin', 'in$')")
def rnk20_candidates_any(spark, d):
    return symbols.candidates_any(symbols.postings(symbol_table(spark, d)), "thin")


@query(f"WITH {SYMBOLS_SQL} SELECT DISTINCT name FROM symbols WHERE contains(lower(name), 'tha') AND contains(lower(name), 'hat') AND contains(lower(name), 'ati')")
def rnk21_candidates_all(spark, d):
    return symbols.candidates_all(symbols.postings(symbol_table(spark, d), padded=False), "thati")


@query(f"{_NAMES} SELECT (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM n) AS n_names, (SELECT count(DISTINCT kgram) FROM k) AS n_kgrams")
def agg01_symbol_stats(spark, d):
    return symbols.statistics(symbol_table(spark, d))


@query(f"WITH {SYMBOLS_SQL} SELECT name, kind, file_path, line FROM symbols WHERE name = 'Of' ORDER BY list_position(['function', 'class', 'interface', 'type', 'enum', 'constant', 'component'], kind), name, file_path, line LIMIT 10")
def join04_definitions(spark, d):
    return symbols.definitions(symbol_table(spark, d), "Of").select("name", "kind", "file_path", "line")


@query(f"WITH {SYMBOLS_SQL} SELECT file_path, kind, count(*) AS n, min(line) AS first_line FROM symbols WHERE kind = 'class' GROUP BY file_path, kind")
def flt03_symbols_by_file(spark, d):
    return symbol_table(spark, d).filter("kind = 'class'").groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def _candidates(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists of parts: by price and by size."""
    from pyspark.sql import Window

    parts = table(spark, d, "part").withColumn("one", F.lit(1))
    w = lambda c: F.row_number().over(Window.partitionBy("one").orderBy(F.desc(c), "p_partkey"))
    best = lambda c: parts.orderBy(F.desc(c), "p_partkey").limit(200).withColumn("rank", w(c)).select(F.col("p_partkey").alias("doc_id"), "rank")
    return best("p_retailprice"), best("p_size")


_FUSED = """WITH a AS (SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.r AS lexical_rank, b.r AS vector_rank, coalesce(0.5 / (60 + a.r), 0) AS lexical_part, coalesce(0.4 / (60 + b.r), 0) AS vector_part
      FROM (SELECT * FROM a WHERE r <= 200) a FULL JOIN (SELECT * FROM b WHERE r <= 200) b ON a.doc_id = b.doc_id),
fused AS (SELECT *, lexical_part + vector_part AS score, row_number() OVER (ORDER BY lexical_part + vector_part DESC, doc_id) AS final_rank FROM f)"""


@query(f"{_FUSED} SELECT doc_id, CAST(lexical_rank AS BIGINT) AS lexical_rank, CAST(vector_rank AS BIGINT) AS vector_rank, round(score, 9) AS score, CAST(final_rank AS BIGINT) AS final_rank FROM fused WHERE final_rank <= 100")
def rnk24_rank_fusion(spark, d):
    """Reciprocal rank fusion of two lists."""
    fused = ranking.fuse(*_candidates(spark, d), ["doc_id"], limit=100)
    return fused.select("doc_id", F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), F.round("score", 9).alias("score"), F.col("final_rank").cast("long").alias("final_rank"))


@query()
def rnk25_diversified(spark, d):
    """Fused parts in an order that spreads over paths."""
    fused = paths(ranking.fuse(*_candidates(spark, d), ["doc_id"], limit=100))
    return ranking.diversify(fused.select("file_path", "score", "doc_id"), ties=["doc_id"]).select("doc_id", "file_path", F.round("score", 9).alias("score"), F.round("penalty", 6).alias("penalty"), F.col("final_rank").cast("long").alias("final_rank"))


@query(f"""WITH RECURSIVE {_FUSED.removeprefix('WITH ')},
r AS (SELECT doc_id, 30 * score AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS n, {PATH_SQL.format(k='doc_id')} AS file_path, (['function', 'class', 'method', 'comment'])[CAST(doc_id % 4 + 1 AS INT)] AS symbol_type FROM fused WHERE final_rank <= 100),
g AS (SELECT n, score AS head, 1 AS tie_group FROM r WHERE n = 1 UNION ALL SELECT r.n, CASE WHEN head - r.score <= 0.01 THEN head ELSE r.score END, CASE WHEN head - r.score <= 0.01 THEN tie_group ELSE tie_group + 1 END FROM g JOIN r ON r.n = g.n + 1),
c AS (SELECT r.*, tie_group, count(*) OVER (PARTITION BY tie_group) AS members FROM r JOIN g USING (n))
SELECT doc_id, CAST(tie_group AS BIGINT) AS tie_group, round(CASE WHEN members > 1 THEN 0.1 * (0.3 * (CASE symbol_type WHEN 'function' THEN 1.0 WHEN 'class' THEN 0.95 WHEN 'method' THEN 0.8 ELSE 0.2 END)
 + 0.3 * (CASE WHEN file_path LIKE 'src/%' THEN 1.0 WHEN file_path LIKE 'lib/%' THEN 0.9 WHEN file_path LIKE 'packages/%' THEN 0.85 WHEN file_path LIKE 'tests/%' OR file_path LIKE '%.test.%' THEN 0.6 WHEN file_path LIKE 'docs/%' THEN 0.4 ELSE 0.5 END)
 + 0.2 * (CASE WHEN file_path LIKE '%.py' THEN 1 ELSE 0 END)) ELSE 0 END, 9) AS tie_score FROM c""")
def rnk28_tie_break(spark, d):
    """Fused parts whose scores tie, decided by type, path and language."""
    fused = paths(ranking.fuse(*_candidates(spark, d), ["doc_id"], limit=100))
    kind = F.element_at(F.array(*map(F.lit, ("function", "class", "method", "comment"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = fused.select("doc_id", "file_path", (30 * F.col("score")).alias("score"), kind.alias("symbol_type"), F.lit("x").alias("symbol_name"), P.language(F.col("file_path")).alias("language"))
    out = ranking.break_ties(rows, "a python parser", ["doc_id"])
    return out.select("doc_id", F.col("tie_group").cast("long").alias("tie_group"), F.round("tie_score", 9).alias("tie_score"))


@query(f"SELECT doc_id, p AS file_path, CASE WHEN p LIKE 'src/%' THEN 1.0 WHEN p LIKE 'lib/%' THEN 0.9 WHEN p LIKE 'packages/%' THEN 0.85 WHEN p LIKE 'tests/%' OR p LIKE '%.test.%' THEN 0.6 WHEN p LIKE 'docs/%' THEN 0.4 ELSE 0.5 END AS priority, round(1 - levenshtein(p, 'src/module_1/file_1.ts') / greatest(length(p), 22), 6) AS similarity FROM (SELECT doc_id, {PATH_SQL.format(k='doc_id')} AS p FROM documents)")
def rnk26_path_scores(spark, d):
    """Priority of paths and likeness to one."""
    p = F.col("file_path")
    return paths(table(spark, d, "documents")).select("doc_id", "file_path", P.priority(p).alias("priority"), F.round(P.similarity(p, F.lit("src/module_1/file_1.ts")), 6).alias("similarity"))


@query("SELECT DISTINCT x AS name, list_sort(list_distinct(list_transform(list_concat([x], list_filter(regexp_split_to_array(regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_.-]+', ' ', 'g'), '\\s+'), lambda y: y <> '')), lambda y: lower(y)))) AS parts FROM (SELECT replace(p_name, ' ', '_') || p_brand AS x FROM part)")
def rnk14_identifier_parts(spark, d):
    """Names split at case changes and separators."""
    names = table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), "p_brand").alias("name")).distinct()
    return names.select("name", F.array_sort(X.identifier_parts(F.col("name"))).alias("parts"))
