"""Queries of the parsers, over source files that are written from the table of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomix.functions import tokens
from fathomix.operators import documents, search, sparse, stats, xrefs
from fathomix.plans.engine import Engine
from fathomix.plans.queries_retrieval import _GRAMS, QUERY
from fathomix.plans.registry import query, table
from fathomix.sources import extract, store
from fathomix.storage import temporary_folder

#: A file for ten parts: an import, and four lines for each part: a comment, a function's head, a call, its end.
_FILES = "p AS (SELECT p_partkey AS k, p_size AS s, p_name, CAST(floor(p_partkey / 10) AS BIGINT) AS f, row_number() OVER (PARTITION BY CAST(floor(p_partkey / 10) AS BIGINT) ORDER BY p_partkey) AS i, 'src/file_' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS VARCHAR) || '.ts' AS file_path FROM part)"


def source_files(spark, d) -> DataFrame:
    """file_path, language, content and the number of parts of TypeScript files."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("f_"), x.cast("string"))
    lines = F.concat_ws("\n", F.concat(F.lit("/** Doc of "), "p_name", F.lit(". */")), F.concat(F.lit("export function "), name(k), F.lit("(a: number, b = "), F.col("p_size").cast("string"), F.lit("): number {")), F.concat(F.lit("  return "), name(2 * k % 1000), F.lit("(a, 1) + b;")), F.lit("}"))
    rows = table(spark, d, "part").select(F.floor(k / 10).alias("f"), F.struct(k.alias("k"), lines.alias("x")).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["x"]), "\n")
    head = F.concat(F.lit("import { g as h"), F.col("f").cast("string"), F.lit(" } from './file_"), (F.col("f") + 1).cast("string"), F.lit("';\n"))
    files = rows.groupBy("f").agg(body.alias("body"))
    return files.select(F.concat(F.lit("src/file_"), F.col("f").cast("string"), F.lit(".ts")).alias("file_path"), F.lit("typescript").alias("language"), F.concat(head, "body").alias("content"))


def parts(spark, d) -> dict[str, DataFrame]:
    return extract.tables(extract.parse_files(source_files(spark, d)))


@query(f"WITH {_FILES} SELECT file_path, 'f_' || k AS name, 'function' AS kind, CAST(4 * i - 1 AS BIGINT) AS line, CAST(4 * i + 1 AS BIGINT) AS end_line, 'f_' || k || '(a: number, b = ' || s || '): number' AS signature, 'Doc of ' || p_name || '.' AS doc, true AS exported FROM p")
def ext05_symbols(spark, d):
    out = parts(spark, d)["symbols"]
    return out.select("file_path", "name", "kind", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "signature", "doc", "exported")


@query(f"WITH {_FILES} SELECT DISTINCT file_path, './file_' || (f + 1) AS source, 'named' AS kind, 'g' AS imported, 'h' || f AS local FROM p")
def ext11_imports(spark, d):
    return parts(spark, d)["imports"].select("file_path", "source", "kind", "imported", "local")


@query(f"WITH {_FILES} SELECT file_path, 'named' AS kind, 'f_' || k AS local, 'f_' || k AS exported FROM p")
def ext12_exports(spark, d):
    return parts(spark, d)["exports"].select("file_path", "kind", "local", "exported")


@query(f"WITH {_FILES} SELECT file_path, 'jsdoc' AS kind, 'Doc of ' || p_name || '.' AS text, CAST(4 * i - 2 AS BIGINT) AS line FROM p")
def ext13_comments(spark, d):
    return parts(spark, d)["comments"].select("file_path", "kind", "text", F.col("line").cast("long").alias("line"))


@query(f"WITH {_FILES} SELECT file_path, 'f_' || k AS caller, 'f_' || (2 * k % 1000) AS callee, CAST(2 AS BIGINT) AS n_args, CAST(4 * i AS BIGINT) AS line FROM p")
def ext14_calls(spark, d):
    return parts(spark, d)["call_edges"].select("file_path", "caller", "callee", F.col("n_args").cast("long").alias("n_args"), F.col("line").cast("long").alias("line"))


@query(f"WITH {_FILES} SELECT file_path, CAST(4 * i - 2 AS BIGINT) AS comment_line, 'f_' || k AS name, CAST(1 AS BIGINT) AS distance FROM p")
def ext15_documented_symbols(spark, d):
    t = extract.stored_tables(extract.parse_files(source_files(spark, d)))
    return extract.documented(t["comments"], t["symbols"]).select("file_path", F.col("comment_line").cast("long").alias("comment_line"), "name", F.col("distance").cast("long").alias("distance"))


@query(f"WITH {_FILES} SELECT file_path AS file_id, 'function' AS chunk_type, 'f_' || k AS name, 'export function f_' || k || '(a: number, b = ' || s || '): number {{' || chr(10) || '  return f_' || (2 * k % 1000) || '(a, 1) + b;' || chr(10) || '}}' AS content, CAST(3 AS BIGINT) AS line_count FROM p")
def ext22_chunks(spark, d):
    files = source_files(spark, d)
    out = extract.chunks(files, extract.tables(extract.parse_files(files))["symbols"])
    return out.select("file_id", "chunk_type", "name", "content", F.col("line_count").cast("long").alias("line_count"))


@query(f"""WITH {_FILES}, t AS (SELECT file_path, f, string_agg('f_' || k || ' function f_' || k || '(a: number, b = ' || s || '): number Doc of ' || p_name || '.', ' ' ORDER BY k) AS fs, string_agg('f_' || k || ' f_' || k, ' ' ORDER BY k) AS ex, string_agg('Doc of ' || p_name || '.', ' ' ORDER BY k) AS docs FROM p GROUP BY file_path, f)
SELECT file_path, lower(regexp_replace(file_path || ' ' || fs || ' ./file_' || (f + 1) || ' g h' || f || ' ' || ex || ' ' || docs, ' +', ' ', 'g')) AS text FROM t""")
def flt04_search_text(spark, d):
    """The text that search reads of each parsed file."""
    out = extract.search_text(extract.parse_files(source_files(spark, d)))
    return out.select("file_path", F.regexp_replace("text", " +", " ").alias("text"))


@query(f"WITH {_FILES} SELECT DISTINCT file_path AS caller, 'src/file_' || (f + 1) || '.ts' AS callee FROM p WHERE f + 1 IN (SELECT f FROM p)")
def join13_dependencies(spark, d):
    """Files and the files that they import."""
    from fathomix.operators import graph

    files = source_files(spark, d)
    found = extract.resolve_imports(extract.tables(extract.parse_files(files))["imports"], files)
    return graph.dependency_edges(found.filter("resolved IS NOT NULL"), files)


@query(f"WITH {_FILES} SELECT file_path, 'f_' || k AS name, CAST(2 * i - 1 AS BIGINT) AS line, 'f_' || k || '(a, b=' || s || ')' AS signature FROM p")
def ext01_python_symbols(spark, d):
    """Symbols of Python files of the same functions."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("def f_"), k.cast("string"), F.lit("(a, b="), F.col("p_size").cast("string"), F.lit("):\n    return f_"), (2 * k % 1000).cast("string"), F.lit("(a)"))
    rows = table(spark, d, "part").select(F.floor(k / 10).alias("f"), F.struct(k.alias("k"), text.alias("x")).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["x"]), "\n")
    files = rows.groupBy("f").agg(body.alias("content")).select(F.concat(F.lit("src/file_"), F.col("f").cast("string"), F.lit(".ts")).alias("file_path"), F.lit("python").alias("language"), "content")
    return extract.tables(extract.parse_files(files))["symbols"].select("file_path", "name", F.col("line").cast("long").alias("line"), "signature")


@query()
def rnk34_bm25_stemmed(spark, d):
    """BM25 over stems."""
    return search.bm25(table(spark, d, "documents"), QUERY, stem=tokens.stems).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query()
def rnk06_word_ids(spark, d):
    """Padded word ids of every document, summarised."""
    rows = table(spark, d, "documents").select("doc_id", tokens.word_ids(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t.ids").alias("size"), F.aggregate("t.mask", F.lit(0), lambda a, x: a + x).alias("used"), F.sha2(F.to_json("t.ids"), 256).alias("ids_sha256"))


@query(f"WITH docs AS (SELECT doc_id, text FROM documents), {_GRAMS.replace('lower(text)', 'text')} SELECT v.doc_id, count(*) AS cells, round(sum(CAST(CAST(tf / norm AS FLOAT) AS DOUBLE) * CAST(CAST(tf / norm AS FLOAT) AS DOUBLE)), 4) AS squared FROM v JOIN n USING (doc_id) GROUP BY v.doc_id")
def snk03_matrix_blocks(spark, d):
    """Sparse vectors packed as binary blocks and read again, summarised."""
    rows = sparse.sparse_rows(table(spark, d, "documents"), "doc_id", "text")
    back = store.import_blocks(store.export_blocks(rows, "doc_id"), "doc_id")
    return back.select("doc_id", F.size("columns").cast("long").alias("cells"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x), 4).alias("squared"))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 2) AS lexical_ms, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 2) AS vector_ms, round(sum(value), 2) AS total_ms, CAST(count(*) AS BIGINT) AS unique_candidates, round(sum(value), 2) > 3000 AS sla_violation FROM events GROUP BY user_id")
def agg10_search_metrics(spark, d):
    """Phase timings of each user's events against a limit."""
    phase = F.when(F.col("event_type") == "view", "lexical").when(F.col("event_type") == "click", "vector").otherwise("ranking")
    samples = table(spark, d, "events").select("user_id", phase.alias("phase"), F.col("value").alias("ms"), F.lit(1).cast("long").alias("candidates"), F.lit(None).cast("long").alias("unique_candidates"))
    out = stats.search_metrics(samples, 3000, "user_id")
    return out.select("user_id", *(F.round(c, 2).alias(c) for c in ("lexical_ms", "vector_ms", "total_ms")), "unique_candidates", (F.round("total_ms", 2) > 3000).alias("sla_violation"))


@query("SELECT o_orderkey, duration_ms FROM (SELECT o_orderkey, o_totalprice / 1000 AS duration_ms FROM orders) WHERE duration_ms > 100")
def snk16_slow_queries(spark, d):
    log = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("duration_ms"))
    return stats.slow_queries(log)


@query(f"WITH {_FILES}, x AS (SELECT *, unnest([0, 1, 2]) AS pos FROM p) SELECT 'c_' || k AS caller, (['first', 'then_', 'last'])[pos + 1] || CASE WHEN pos = 1 THEN CAST(s AS VARCHAR) ELSE '' END AS callee, CASE WHEN pos = 0 THEN 'list' WHEN pos = 1 THEN 'list.first' ELSE 'list.first.then_' || s END AS receiver, 'method' AS kind, CAST(pos AS BIGINT) AS n_args, CAST(pos AS BIGINT) AS chain_position, CASE pos WHEN 1 THEN 'first' WHEN 2 THEN 'then_' || s END AS chain_previous, CASE pos WHEN 0 THEN 'then_' || s WHEN 1 THEN 'last' END AS chain_next FROM x UNION ALL SELECT 'c_' || k, '<dynamic>', 'table', 'dynamic', CAST(1 AS BIGINT), NULL, NULL, NULL FROM p UNION ALL SELECT 'c_' || k, 'Thing', NULL, 'constructor', CAST(0 AS BIGINT), NULL, NULL, NULL FROM p")
def ext26_call_chains(spark, d):
    """Kinds, receivers and places in chains of the calls in JavaScript files."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(F.lit("function c_"), k.cast("string"), F.lit("(list, table) {\n  list\n    .first()\n    .then_"), size, F.lit("(x => x)\n    .last(1, 2);\n  table["), size, F.lit("](3);\n  return new Thing();\n}"))
    calls = extract.tables(extract.parse_files(_by_tens(spark, d, text, "js", "javascript")))["call_edges"]
    return calls.select("caller", "callee", "receiver", "kind", F.col("n_args").cast("long").alias("n_args"), F.col("chain_position").cast("long").alias("chain_position"), "chain_previous", "chain_next")


def _by_tens(spark, d, text, ending: str, language: str) -> DataFrame:
    """file_path, language and content of files that hold a text for each of ten parts."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.floor(k / 10).alias("f"), F.struct(k.alias("k"), text.alias("x")).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["x"]), "\n")
    return rows.groupBy("f").agg(body.alias("content")).select(F.concat(F.lit("src/file_"), F.col("f").cast("string"), F.lit(f".{ending}")).alias("file_path"), F.lit(language).alias("language"), "content")


def _parsed_symbols(spark, d, text, ending: str, language: str) -> DataFrame:
    found = extract.tables(extract.parse_files(_by_tens(spark, d, text, ending, language)))["symbols"]
    return found.select("file_path", "name", "kind", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "signature", "doc", "exported")


def _path_of(ending: str) -> str:
    return f"regexp_replace(file_path, 'ts$', '{ending}') AS file_path"


@query(f"""WITH {_FILES} SELECT {_path_of('java')}, 'C' || k AS name, 'class' AS kind, CAST(6 * i - 4 AS BIGINT) AS line, CAST(6 * i AS BIGINT) AS end_line, NULL AS signature, 'Doc of ' || p_name || '.' AS doc, true AS exported FROM p
UNION ALL SELECT {_path_of('java')}, 'C' || k || '.run', 'method', CAST(6 * i - 3 AS BIGINT), CAST(6 * i - 1 AS BIGINT), 'run(int a, String b): long', NULL, s % 2 = 0 FROM p""")
def ext04_java_symbols(spark, d):
    k, mark = F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, "public").otherwise("private")
    text = F.concat(F.lit("/** Doc of "), "p_name", F.lit(". */\npublic class C"), k, F.lit(" {\n    "), mark, F.lit(" long run(int a, String b) {\n        return help(\"} // {\", a);\n    }\n}"))
    return _parsed_symbols(spark, d, text, "java", "java")


@query(f"""WITH {_FILES} SELECT {_path_of('go')}, 'T' || k AS name, 'class' AS kind, CAST(6 * i - 5 AS BIGINT) AS line, CAST(6 * i - 5 AS BIGINT) AS end_line, NULL AS signature, NULL AS doc, true AS exported FROM p
UNION ALL SELECT {_path_of('go')}, 'T' || k || '.run', 'method', CAST(6 * i - 3 AS BIGINT), CAST(6 * i AS BIGINT), 'run(a int) error', 'run does ' || p_name, false FROM p""")
def ext04_go_symbols(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("type T"), k, F.lit(" struct { n int }\n// run does "), "p_name", F.lit("\nfunc (t *T"), k, F.lit(") run(a int) error {\n\ts := `}`\n\treturn t.help(s, a)\n}"))
    return _parsed_symbols(spark, d, text, "go", "go")


@query(f"""WITH {_FILES} SELECT {_path_of('rs')}, 'S' || k AS name, 'class' AS kind, CAST(7 * i - 6 AS BIGINT) AS line, CAST(7 * i - 6 AS BIGINT) AS end_line, NULL AS signature, NULL AS doc, true AS exported FROM p
UNION ALL SELECT {_path_of('rs')}, 'S' || k || '.run', 'method', CAST(7 * i - 3 AS BIGINT), CAST(7 * i - 1 AS BIGINT), 'run(&self, a: u32) -> u32', 'Doc of ' || p_name, false FROM p""")
def ext04_rust_symbols(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("pub struct S"), k, F.lit(" { n: u32 }\nimpl S"), k, F.lit(" {\n    /// Doc of "), "p_name", F.lit("\n    fn run(&self, a: u32) -> u32 {\n        help(a, '}')\n    }\n}"))
    return _parsed_symbols(spark, d, text, "rs", "rust")


@query(f"""WITH {_FILES} SELECT {_path_of('rb')}, 'K' || k AS name, 'class' AS kind, CAST(7 * i - 6 AS BIGINT) AS line, CAST(7 * i AS BIGINT) AS end_line, NULL AS signature, NULL AS doc, true AS exported FROM p
UNION ALL SELECT {_path_of('rb')}, 'K' || k || '.run', 'method', CAST(7 * i - 5 AS BIGINT), CAST(7 * i - 1 AS BIGINT), 'run(a, b)', NULL, true FROM p""")
def ext04_ruby_symbols(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("class K"), k, F.lit("\n  def run(a, b)\n    if a\n      help(b) # end\n    end\n  end\nend"))
    return _parsed_symbols(spark, d, text, "rb", "ruby")


def _declared(spark, d) -> DataFrame:
    """Symbols of TypeScript files with an interface, a class, an enum, a type and a constant for each part."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("export interface I"), k, F.lit(" extends J { a: number; }\nexport class C"), k, F.lit(" extends B"), size, F.lit(" implements I"), k, F.lit(" {\n  private static async get(a: string) { return a; }\n}\nexport enum E"), k, F.lit(" { A, B }\nexport type T"), k, F.lit(" = string | number;\nconst V"), k, F.lit(" = "), size, F.lit(";"))
    return extract.tables(extract.parse_files(_by_tens(spark, d, text, "ts", "typescript")))["symbols"].filter("kind <> 'property'")


@query(f"""WITH {_FILES}, x AS (SELECT *, unnest(['class', 'interface', 'enum', 'type', 'constant', 'get']) AS what FROM p) SELECT file_path, CASE what WHEN 'class' THEN 'C' || k WHEN 'interface' THEN 'I' || k WHEN 'enum' THEN 'E' || k WHEN 'type' THEN 'T' || k WHEN 'constant' THEN 'V' || k ELSE 'C' || k || '.get' END AS name, CASE what WHEN 'get' THEN 'method' ELSE what END AS kind,
CASE what WHEN 'class' THEN 'B' || s WHEN 'interface' THEN 'J' ELSE '' END AS extends, CASE what WHEN 'class' THEN 'I' || k ELSE '' END AS implements, what = 'get' AS is_static FROM x""")
def ext09_declarations(spark, d):
    """Bases, modifiers and kinds of the declarations in TypeScript files."""
    found = _declared(spark, d)
    return found.select("file_path", "name", "kind", F.array_join("extends", ",").alias("extends"), F.array_join("implements", ",").alias("implements"), F.array_contains("modifiers", "static").alias("is_static"))


@query(f"""WITH {_FILES}, x AS (SELECT *, unnest(['class.definition', 'class.extends', 'interface.definition', 'method.definition', 'method.async', 'method.static']) AS capture FROM p)
SELECT {_path_of('ts')}, capture, CASE WHEN capture LIKE 'class%' THEN 'C' || k WHEN capture LIKE 'interface%' THEN 'I' || k ELSE 'C' || k || '.get' END AS name FROM x""")
def ext19_captures(spark, d):
    """What syntax patterns name in TypeScript files."""
    return extract.captures(_declared(spark, d)).select("file_path", "capture", "name")


@query(f"WITH {_FILES} SELECT file_path, CASE WHEN f % 3 = 0 THEN 'added' ELSE 'f_' || min(k) END AS first_name FROM p WHERE f % 5 <> 0 GROUP BY file_path, f")
def ext18_reparse(spark, d):
    """Parsed files after edits of every third and the loss of every fifth."""
    files = source_files(spark, d)
    number = F.regexp_extract("file_path", r"(\d+)", 1).cast("long")
    edited = files.filter((number % 3 == 0) | (number % 5 == 0))
    now = files.filter(number % 5 != 0).withColumn("content", F.when(number % 3 == 0, F.concat(F.lit("function added() {}\n"), "content")).otherwise(F.col("content")))
    out = extract.reparse(extract.parse_files(files), now, edited)
    names = F.transform("symbols", lambda s: s["name"])
    return out.select("file_path", F.when(names[0] == "added", "added").otherwise(F.concat(F.lit("f_"), F.array_min(F.transform(names, lambda n: F.substring(n, 3, 20).cast("int"))))).alias("first_name"))


@query(f"WITH {_FILES} SELECT file_path, count(*) AS n_function, count(*) AS n_exports, count(*) AS n_comments, count(*) AS n_calls, CAST(1 AS BIGINT) AS n_imports, count(*) AS n_symbols, true AS has_symbols, CAST(0 AS BIGINT) AS n_after_error FROM p GROUP BY file_path")
def ext20_document_statistics(spark, d):
    out = documents.document_statistics(extract.parse_files(source_files(spark, d)))
    return out.select("file_path", "n_function", "n_exports", "n_comments", "n_calls", "n_imports", "n_symbols", "has_symbols", "n_after_error")


@query(f"WITH {_FILES} SELECT file_path, string_agg('f_' || k, ',' ORDER BY k) AS names FROM p GROUP BY file_path")
def ext20_function_names(spark, d):
    return documents.function_names(extract.parse_files(source_files(spark, d))).select("file_path", F.array_join("names", ",").alias("names"))


@query(f"""WITH {_FILES} SELECT file_path, 'file:' || file_path || ' ⏐ lang:typescript ⏐ exports:' || string_agg('f_' || k, ' , ' ORDER BY k) || ' ⏐ ' || string_agg('fn f_' || k || '(a: number, b = ' || s || '): number calls[f_' || (2 * k % 1000) || ']', ' ⏐ ' ORDER BY k) AS text FROM p GROUP BY file_path""")
def flt05_canonical_text(spark, d):
    return documents.canonical_text(extract.parse_files(source_files(spark, d)))


@query(f"""WITH {_FILES}, d AS (SELECT DISTINCT file_path, k FROM p) SELECT p.file_path, 'f_' || p.k AS caller, 'f_' || (2 * p.k % 1000) AS callee, CASE WHEN d.k IS NOT NULL THEN 'direct' ELSE 'indirect' END AS call_type FROM p LEFT JOIN d ON d.file_path = p.file_path AND d.k = 2 * p.k % 1000""")
def gr07_call_types(spark, d):
    """Calls of functions of the same file and of others."""
    t = extract.stored_tables(extract.parse_files(source_files(spark, d)))
    return xrefs.call_types(t["call_edges"], t["symbols"], t["imports"]).select("file_path", "caller", "callee", "call_type")


@query(f"""WITH {_FILES} SELECT 'LIMIT_' || k AS target, type, count(*) AS n, min(source) AS source FROM (SELECT k, unnest([{{'type': 'read', 'source': 'use_' || k}}, {{'type': 'write', 'source': 'use_' || k}}]) AS u FROM p) t, (SELECT u.type AS type, u.source AS source) GROUP BY 1, 2
UNION ALL SELECT 'help', 'call', count(*), min('use_' || k) FROM p""")
def gr06_cross_references(spark, d):
    """Reads, writes and calls in JavaScript files."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("let LIMIT_"), k, F.lit(" = 1;\nfunction use_"), k, F.lit("(a) {\n  help(LIMIT_"), k, F.lit(");\n  LIMIT_"), k, F.lit(" += a;\n}"))
    files = _by_tens(spark, d, text, "js", "javascript")
    t = extract.stored_tables(extract.parse_files(files))
    known = t["symbols"].unionByName(t["symbols"].filter("kind = 'function'").withColumns({"kind": F.lit("variable"), "name": F.replace("name", F.lit("use_"), F.lit("LIMIT_")), "line": F.col("line") - 1, "end_line": F.col("line") - 1}))
    found = xrefs.cross_references(files, known, t["call_edges"], t["imports"])
    return found.groupBy("target", "type").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source"))


@query("SELECT p_partkey, 'param:a ' || p_name || '|returns:all of it' AS tags FROM part")
def ext25_doc_tags(spark, d):
    """The tags of documentation blocks."""
    text = F.concat(F.lit("Does.\n@param a "), "p_name", F.lit("\n  @returns all of it\nmore"))
    tags = F.transform(extract.doc_tags(text), lambda t: F.concat(t["tag"], F.lit(":"), t["text"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(tags, "|").alias("tags"))


_ENGINES: dict[tuple, str] = {}


def engine(spark, d) -> Engine:
    """The index of the files of parts, built once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ENGINES:
        folder = temporary_folder(spark, "engine")
        files = source_files(spark, d).select("file_path", F.lit(1.0).alias("mtime_ms"), F.octet_length("content").cast("long").alias("bytes"), "language", "content")
        Engine(spark, folder, parts=2).index_frame(files)
        _ENGINES[key] = folder
    return Engine(spark, _ENGINES[key], parts=2)


_CODE = "'export function f_' || k || '(a: number, b = ' || s || '): number {' || chr(10) || '  return f_' || (2 * k % 1000) || '(a, 1) + b;' || chr(10) || '}'"


@query(f"WITH {_FILES} SELECT file_path, 'f_' || k AS name, CAST(4 * i - 1 AS BIGINT) AS line, {_CODE} AS code, 'f_' || (2 * k % 1000) AS calls, (SELECT coalesce(string_agg('f_' || k, ',' ORDER BY 'f_' || k), '') FROM p c WHERE 2 * c.k % 1000 = 14) AS called_by FROM p WHERE k = 14")
def api02_find_def(spark, d):
    """The definition of f_14 with its code, calls and callers."""
    return engine(spark, d).find_def("f_14").select("file_path", "name", F.col("line").cast("long").alias("line"), "code", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"))


@query(f"WITH {_FILES} SELECT file_path, CASE WHEN bool_or(k = 14) THEN 'definition' ELSE 'call' END AS reference_type FROM p WHERE k = 14 OR 2 * k % 1000 = 14 GROUP BY file_path")
def api03_find_refs(spark, d):
    return engine(spark, d).find_refs("f_14")


@query(f"WITH {_FILES} SELECT file_path, 'f_' || k AS caller, CAST(4 * i - 1 AS BIGINT) AS line FROM p WHERE 2 * k % 1000 = 14")
def api04_callers(spark, d):
    return engine(spark, d).callers("f_14").select("file_path", "caller", F.col("line").cast("long").alias("line"))


@query(f"WITH {_FILES} SELECT 'f_14' AS callee, file_path FROM p WHERE k = 14")
def api05_callees(spark, d):
    return engine(spark, d).callees("f_7").select("callee", "file_path")


@query(f"WITH {_FILES} SELECT file_path, CAST(4 * i - 2 AS BIGINT) AS start_line, true AS \"exists\", '/** Doc of ' || p_name || '. */' || chr(10) || {_CODE} AS text FROM p WHERE k = 14")
def api06_open_at(spark, d):
    """The lines around the function f_14."""
    e = engine(spark, d)
    at = e.symbols_exact("f_14").select("file_path", "line").first()
    return e.open_at(at["file_path"], at["line"] + 1, 4).select("file_path", F.col("start_line").cast("long").alias("start_line"), "exists", F.array_join(F.slice("lines", 1, 4), "\n").alias("text"))


@query(f"WITH {_FILES} SELECT file_path, 'f_' || k AS name, 'function' AS kind FROM p WHERE file_path = 'src/file_3.ts'")
def api08_symbols(spark, d):
    return engine(spark, d).symbols("src/file_3.ts", "function").select("file_path", "name", "kind")


@query(f"WITH {_FILES} SELECT 'f_' || k AS name, CAST(levenshtein('f_' || k, 'f_14') AS BIGINT) AS distance FROM p WHERE levenshtein('f_' || k, 'f_14') <= 1 ORDER BY 2, 1 LIMIT 50")
def api09_symbols_fuzzy(spark, d):
    return engine(spark, d).symbols_fuzzy("f_14", 1).select("name", F.col("distance").cast("long").alias("distance"))


@query(f"WITH {_FILES} SELECT 'src/file_3.ts' AS file_path, count(*) AS n_lines FROM p WHERE file_path = 'src/file_3.ts'")
def flt19_text_search(spark, d):
    """Lines of one file that return something, by path pattern and exclusion."""
    found = engine(spark, d).text_search("return f_", file_patterns=["src/file_3*"], exclude=["src/file_3?*.ts"])
    return found.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {_FILES} SELECT count(DISTINCT file_path) AS n_files, count(*) AS n_symbols, count(DISTINCT k) AS n_names FROM p")
def agg02_engine_stats(spark, d):
    return engine(spark, d).stats().select("n_files", "n_symbols", "n_names")


@query(f"WITH {_FILES} SELECT unnest(['files', 'symbols', 'imports']) AS table_name, 'present' AS status, unnest([count(DISTINCT file_path), count(*), count(DISTINCT file_path)]) AS n_rows FROM p")
def cli02_doctor(spark, d):
    return engine(spark, d).doctor().filter("table_name IN ('files', 'symbols', 'imports')").select("table_name", "status", "n_rows")


@query(f"WITH docs AS (SELECT doc_id, text FROM documents), {_GRAMS.replace('lower(text)', 'text')} SELECT (SELECT count(*) FROM documents) AS n_files, CAST((SELECT sum(2 * length(CAST(doc_id AS VARCHAR)) + 4 * 384) FROM documents) + 8 * (SELECT count(*) FROM v) AS BIGINT) AS memory")
def agg02_index_stats(spark, d):
    """Files of an index, and the bytes that it would take."""
    docs = table(spark, d, "documents")
    return store.index_statistics(docs.select("doc_id"), sparse.sparse_vectors(docs, "doc_id", "text"), "doc_id", 384)
