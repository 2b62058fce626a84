"""Queries of text functions, chunks and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomix.functions import paths as P
from fathomix.functions import text as X
from fathomix.operators import chunks
from fathomix.plans.queries_retrieval import PATH_SQL, paths
from fathomix.plans.registry import query, table


@query("SELECT p_partkey, p_name, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT) AS hash FROM part")
def rnk02_fnv1a(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", X.fnv1a(F.col("p_name")).alias("hash"))


@query("SELECT p_partkey, list_transform(range(1, length('$' || p_name || '$') - 1), lambda i: substr('$' || p_name || '$', CAST(i AS INT), 3)) AS grams FROM part")
def rnk19_padded_kgrams(spark, d):
    return table(spark, d, "part").select("p_partkey", X.padded_kgrams(F.col("p_name")).alias("grams"))


@query("SELECT doc_id, CASE WHEN length(l) <= 150 THEN l ELSE substr(l, 1, 149) || '…' END AS tail, CASE WHEN length(l) <= 40 THEN l WHEN length(l) <= 60 THEN '…' || substr(l, length(l) - 38, 39) ELSE '…' || substr(l, 22, 38) || '…' END AS centred FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents WHERE text IS NOT NULL)")
def sc03_truncate_line(spark, d):
    first = F.split("text", "\n")[0]
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", first.alias("l"))
    return rows.select("doc_id", X.truncate_line(F.col("l")).alias("tail"), X.truncate_line(F.col("l"), F.lit(40), 40).alias("centred"))


@query(r"SELECT doc_id, sha256(replace(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]', '', 'g'), chr(9), '  ')) AS clean FROM documents")
def sc04_sanitise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.sanitise(F.col("text")), 256).alias("clean"))


@query("""SELECT doc_id, CAST(greatest(0, least(4, len(s) - 1) - 3) + 1 AS BIGINT) AS start_line, list_transform(s[greatest(0, least(4, len(s) - 1) - 3) + 1 : least(len(s) - 1, least(4, len(s) - 1) + 4) + 1], lambda x: CASE WHEN length(x) <= 150 THEN x ELSE substr(x, 1, 149) || '…' END) AS shown
FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)""")
def sc05_preview(spark, d):
    """Lines around line 5 of every document."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.preview(F.col("text"), F.lit(5)).alias("p"))
    return rows.select("doc_id", F.col("p.start_line").cast("long").alias("start_line"), F.col("p.lines").alias("shown"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS code FROM documents WHERE text IS NOT NULL")
def sc06_code_by_span(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.code_by_span(F.col("text"), F.lit(2), F.lit(4)).alias("code"))


@query("""SELECT doc_id, CASE WHEN len(s) >= 3 THEN '  ' || s[1] || chr(10) || '  ' || s[2] || chr(10) || '→ ' || s[3] || CASE WHEN len(s) >= 4 THEN chr(10) || '  ' || s[4] ELSE '' END || CASE WHEN len(s) >= 5 THEN chr(10) || '  ' || s[5] ELSE '' END || CASE WHEN len(s) > 5 THEN chr(10) || '...' ELSE '' END END AS preview
FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)""")
def sc07_marked_preview(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.marked_preview(F.col("text"), F.lit(3)).alias("preview"))


_DEDENT = r"""l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, l, list_min([length(regexp_extract(x, '^\s*')) FOR x IN l IF regexp_matches(x, '\S')]) AS n FROM l),
d AS (SELECT doc_id, CASE WHEN n IS NULL THEN '' ELSE regexp_replace(array_to_string([CASE WHEN length(x) >= n THEN substr(x, CAST(n + 1 AS BIGINT)) ELSE x END FOR x IN l], chr(10)), '^\s+|\s+$', '', 'g') END AS t FROM i)"""


@query(f"WITH {_DEDENT} SELECT doc_id, sha256(t) AS chunk_hash, true AS same_indented FROM d")
def sc08_chunk_ids(spark, d):
    """Hashes of dedented texts, which indentation does not change."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    indented = F.concat(F.lit("\n    "), F.replace("text", F.lit("\n"), F.lit("\n    ")), F.lit("\n\n"))
    return docs.select("doc_id", X.chunk_id(F.col("text")).alias("chunk_hash"), (X.chunk_id(F.col("text")) == X.chunk_id(indented)).alias("same_indented"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal_hash, sha256(text) AS file_hash, CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines FROM documents")
def sc12_hashes_and_lines(spark, d):
    t = F.col("text")
    normal = F.trim(F.regexp_replace(t, r"\s+", " "))
    return table(spark, d, "documents").select("doc_id", F.sha2(normal, 256).alias("normal_hash"), F.sha2(t, 256).alias("file_hash"), X.count_lines(t).cast("long").alias("n_lines"))


@query(r"SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def sc10_equal_contents(spark, d):
    """Documents of the same text but for white space."""
    h = F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256)
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(r"SELECT doc_id, contains(substr(text, 1, 8192), chr(0)) AS has_nul, NOT regexp_matches(substr(text, 1, 8192), '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS is_text, (length(substr(text, 1, 8000)) - length(regexp_replace(substr(text, 1, 8000), '[\x01-\x08\x0B\x0C\x0E-\x1F\x{80}-\x{9F}]', '', 'g'))) > 0.3 * length(substr(text, 1, 8000)) AS binary FROM documents")
def flt16_binary_checks(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.has_nul(t).alias("has_nul"), X.is_text(t).alias("is_text"), X.looks_binary(t).alias("binary"))


@query(f"""SELECT doc_id, p AS file_path, CASE regexp_extract(p, '(\\.[^.]+)$', 1) WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.md' THEN 'markdown' END AS language, regexp_extract(p, '(\\.[^.]+)$', 1) AS extension, regexp_extract(p, '([^/]+)$', 1) AS name, CAST(len(string_split(p, '/')) - 1 AS BIGINT) AS depth,
starts_with(p, 'src/') AS within, p LIKE 'src/%.ts' OR p LIKE 'docs/%' AS matched, replace(p, '/', '_') AS encoded FROM (SELECT doc_id, {PATH_SQL.format(k='doc_id')} AS p FROM documents)""")
def sc14_path_functions(spark, d):
    p = F.col("file_path")
    rows = paths(table(spark, d, "documents"))
    return rows.select("doc_id", "file_path", P.language(p).alias("language"), P.extension(p).alias("extension"), P.basename(p).alias("name"), P.depth(p).cast("long").alias("depth"), P.is_within(p, F.lit("src")).alias("within"), P.matches_any(p, ["src/*.ts", "docs/*"]).alias("matched"), P.encode_document_path(p).alias("encoded"))


@query(f"SELECT doc_id, p LIKE 'docs/%' OR p LIKE '%.md' AS ignored FROM (SELECT doc_id, {PATH_SQL.format(k='doc_id')} AS p FROM documents)")
def src06_ignore_rules(spark, d):
    rules = P.IgnoreRules(["docs/", "*.md", "# a comment"])
    return paths(table(spark, d, "documents")).select("doc_id", rules.ignored(F.col("file_path")).alias("ignored"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.2f KB', floor(n / 1024.0 * 100 + 0.5) / 100) ELSE printf('%.2f MB', floor(n / 1048576.0 * 100 + 0.5) / 100) END AS size, printf('%.3f', o_totalprice) AS score, 'f' || ':' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INT), ' ') || ': ' || o_orderstatus AS match, '****' || right(o_orderpriority, 4) AS masked,
'f:' || CAST(o_orderkey AS VARCHAR) || ':1' AS anchor, CAST(floor(least(1000.0 * pow(2, o_orderkey % 7), 30000)) AS BIGINT) AS delay, (['added', 'modified', 'deleted', 'renamed', 'copied', 'type_changed', 'unmerged', 'unknown'])[CAST(o_orderkey % 8 + 1 AS INT)] AS status FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def sc19_formats(spark, d):
    """Sizes, scores, matches, masked keys, anchors and delays as text."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select("o_orderkey", X.format_bytes(F.floor("o_totalprice")).alias("size"), X.format_score(F.col("o_totalprice")).alias("score"), X.format_match(F.lit("f"), key, F.col("o_orderstatus")).alias("match"), X.mask_key(F.col("o_orderpriority")).alias("masked"), X.anchor(F.lit("f"), key, F.lit(1)).alias("anchor"), X.retry_delay(key % 7 + 1).cast("long").alias("delay"), X.file_status(F.element_at(F.array(*map(F.lit, (" A", "M", "d", "R100", "C075", "T", "U", "?"))), (key % 8 + 1).cast("int"))).alias("status"))


_CHUNKS = "c AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, (['function', 'method', 'class', 'property', 'generator'])[CAST(doc_id % 5 + 1 AS INT)] AS chunk_type, (['typescript', 'javascript', 'python'])[CAST(doc_id % 3 + 1 AS INT)] AS language, source AS file_id, text AS content, n_chars AS character_count, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count FROM documents)"


def chunk_table(spark, d):
    """Documents as chunks."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", pick(("function", "method", "class", "property", "generator")).alias("chunk_type"), pick(chunks.LANGUAGES).alias("language"), F.col("source").alias("file_id"), F.col("text").alias("content"), F.col("n_chars").alias("character_count"), F.size(F.split("text", "\n")).cast("long").alias("line_count"))


@query(f"WITH {_CHUNKS}, f AS (SELECT * FROM c WHERE chunk_type IN ('function', 'method') AND language IN ('python', 'typescript') AND contains(lower(content), 'thing') AND line_count BETWEEN 2 AND 400) SELECT id, file_id, line_count, (SELECT count(*) FROM f) AS total, 2 AS page, 40 < (SELECT count(*) FROM f) AS has_more FROM f ORDER BY file_id, doc_id LIMIT 20 OFFSET 20")
def flt11_chunk_page(spark, d):
    """The second page of filtered chunks."""
    q = chunks.ChunkQuery(types=("function", "method"), languages=("python", "typescript"), text="Thing", min_lines=2, max_lines=400).page(2, 20)
    return chunks.run(chunk_table(spark, d), q, ("file_id", "doc_id")).select("id", "file_id", "line_count", "total", "page", "has_more")


@query(f"WITH {_CHUNKS} SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(chunk_type) = 0 THEN 'chunk_type' ELSE 'total' END AS grouping, coalesce(language, chunk_type, 'all') AS value, count(*) AS n, round(avg(character_count), 4) AS mean_size, count(*) FILTER (WHERE line_count > 5000) AS n_large FROM c GROUP BY GROUPING SETS ((language), (chunk_type), ())")
def agg06_chunk_stats(spark, d):
    return chunks.statistics(chunk_table(spark, d)).withColumn("mean_size", F.round("mean_size", 4))


@query(f"WITH {_CHUNKS} SELECT id, chunk_type FROM c WHERE file_id = 'src3'")
def flt12_chunks_by_file(spark, d):
    return chunks.by_file(chunk_table(spark, d).withColumn("start_line", F.col("doc_id")), "src3").select("id", "chunk_type")


@query(f"WITH {_CHUNKS} SELECT id, chunk_type FROM c WHERE id = '7' UNION ALL SELECT id, 'left' FROM c WHERE file_id <> 'src3' OR file_id IS NULL")
def flt12_chunk_lookup(spark, d):
    """A chunk by its hash, and those that are left when a file's chunks are deleted."""
    rows = chunk_table(spark, d).withColumn("chunk_hash", F.col("id"))
    return chunks.by_hash(rows, "7").select("id", "chunk_type").unionByName(chunks.without(rows, "file_id", "src3").select("id", F.lit("left").alias("chunk_type")))


@query(f"""WITH {_CHUNKS}, v AS (SELECT id, chunk_type, language, doc_id, line_count, CASE WHEN doc_id % 4 = 1 THEN 'x' ELSE sha256(id) END AS h FROM c)
SELECT id, doc_id % 4 <> 1 AND doc_id % 5 <> 2 AND doc_id % 7 <> 3 AND doc_id % 11 <> 4 AS is_valid FROM v""")
def ext27_chunk_validity(spark, d):
    """Chunks some of which have a wrong hash, range, count of lines or name."""
    k, n = F.col("doc_id"), F.col("line_count")
    rows = chunk_table(spark, d).withColumns({
        "chunk_hash": F.when(k % 4 == 1, "x").otherwise(F.sha2("id", 256)), "start_line": F.lit(10), "end_line": F.when(k % 5 == 2, F.lit(9)).otherwise(9 + n),
        "start_byte": F.lit(0), "end_byte": F.lit(1), "line_count": F.when(k % 7 == 3, n + 1).otherwise(n), "name": F.when(k % 11 == 4, " ").otherwise("f"),
    })
    return chunks.with_validity(rows).select("id", "is_valid")


@query(f"WITH {_CHUNKS}, n AS (SELECT id AS chunk_hash, content, doc_id FROM c WHERE doc_id % 3 = 0) SELECT id AS chunk_hash, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM c WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def ext28_chunk_upsert(spark, d):
    """Chunks of even documents, into which those of every third one are stored."""
    rows = chunk_table(spark, d).select(F.col("id").alias("chunk_hash"), F.coalesce("content", F.lit("")).alias("content"), "doc_id")
    stored, new = rows.filter("doc_id % 2 = 0").withColumn("state", F.lit("old")), rows.filter("doc_id % 3 = 0").withColumn("state", F.lit("new"))
    return chunks.upsert(stored, new).select("chunk_hash", "state")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '.' WHEN p_partkey % 3 = 1 THEN 'ns.' ELSE '' END || p_name AS qualified, trim(regexp_replace(p_name || '<b>' || chr(7) || ';' || p_brand, '[\x00-\x1F\x7F<>|;&$`\\\"'']', '', 'g')) AS clean, CASE WHEN p_partkey % 9 < 8 THEN 'transient' ELSE 'permanent' END AS category, p_partkey % 2 = 0 AS is_id FROM part")
def sc16_names_and_checks(spark, d):
    """Qualified names, inputs without control characters, categories of errors, and hashes that are ids."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    code = F.element_at(F.array(*map(F.lit, (*X.RETRYABLE_CODES, "EACCES"))), (k % 9 + 1).cast("int"))
    qualified = X.qualified_name(F.when(k % 3 == 0, F.col("p_brand")).otherwise(F.lit("")), F.when(k % 3 < 2, F.lit("ns")).otherwise(none), F.col("p_name"))
    value = F.when(k % 2 == 0, F.sha2("p_name", 256)).otherwise(F.upper(F.sha2("p_name", 256)))
    return table(spark, d, "part").select("p_partkey", qualified.alias("qualified"), X.sanitise_input(F.concat("p_name", F.lit("<b>\x07;"), "p_brand")).alias("clean"), X.error_category(code).alias("category"), X.is_chunk_id(value).alias("is_id"))


@query("SELECT p_partkey, true AS same, true AS differs, 16 AS size FROM part")
def sc11_semantic_hashes(spark, d):
    """Hashes that comments and white space do not change, and that code does."""
    body = F.concat(F.lit("return "), "p_name", F.lit(";"))
    noisy = F.concat(F.lit("// note\n  return  "), "p_name", F.lit("; /* why */"))
    hash_of = lambda b: X.semantic_hash(F.col("p_brand"), b)
    return table(spark, d, "part").select("p_partkey", (hash_of(body) == hash_of(noisy)).alias("same"), (hash_of(body) != hash_of(F.concat(body, F.lit("x")))).alias("differs"), F.length(hash_of(body)).alias("size"))


@query("SELECT text AS content FROM documents GROUP BY text HAVING count(DISTINCT lang) > 1")
def ext28_collisions(spark, d):
    """Equal texts that are stored under two languages, by the collision check."""
    rows = table(spark, d, "documents").select(F.col("text").alias("chunk_hash"), F.col("lang").alias("content"))
    return chunks.collisions(rows).select(F.col("chunk_hash").alias("content"))
