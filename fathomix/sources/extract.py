"""Parsed files and the flat tables of symbols, calls, imports, exports, comments and chunks."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomix.functions import text as X
from fathomix.sources import brace_parser, python_parser, script_parser
from fathomix.sources.schemas import PARSED
from fathomix.storage import Scratch

PARSERS = {"python": python_parser.parse, "javascript": script_parser.parse, "typescript": script_parser.parse} | {name: partial(brace_parser.parse, language=name) for name in brace_parser.LANGUAGES}
PARTS = ("symbols", "imports", "exports", "calls", "comments", "errors")
NOTHING = {p: [] for p in PARTS}
#: What is parsed before it leaves Python: about so many characters, and files.
PART_CHARS, PART_FILES = 1 << 18, 1000


def parse_files(files: DataFrame, path: str = "file_path", language: str = "language", content: str = "content") -> DataFrame:
    """One row a file with arrays of all that its parser found; other languages have empty arrays."""

    def run(frames):
        for f in frames:
            rows, chars = [], 0
            for p, lang, text in zip(f[path], f[language], f[content], strict=True):
                try:
                    found = PARSERS[lang](text) if lang in PARSERS and text else NOTHING
                except Exception as e:  # a file that breaks the parser is reported, the scan goes on
                    found = {**NOTHING, "errors": [{"message": f"{type(e).__name__}: {e}", "line": 1}]}
                rows.append({"file_path": p, "language": lang, **found})
                chars += len(text or "")
                if chars >= PART_CHARS or len(rows) >= PART_FILES:
                    yield pd.DataFrame(rows, columns=["file_path", "language", *PARTS])
                    rows, chars = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["file_path", "language", *PARTS])

    fields = files.select(path, language, content)
    return fields.mapInPandas(run, PARSED)


def flat(parsed: DataFrame, part: str) -> DataFrame:
    """file_path and the fields of one part, one row an element."""
    return parsed.select("file_path", F.explode(part).alias("x")).select("file_path", "x.*")


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    out = {p: flat(parsed, p) for p in PARTS}
    out["call_edges"] = out.pop("calls").filter("caller IS NOT NULL")
    return out


def stored_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The same of files that are parsed once and stored, for plans that read several tables or one of them often."""
    return tables(Scratch(parsed.sparkSession, "parsed").write(parsed))


def search_text(parsed: DataFrame) -> DataFrame:
    """file_path and the lower-cased text that search reads: path, symbols with kinds, signatures and docs
    in the order of kinds, imports, exports, doc comments."""
    join = lambda *c: F.concat_ws(" ", *c)

    def of_kind(kind: str, *fields: str) -> Column:
        rows = F.filter("symbols", lambda s: s["kind"] == kind)
        return F.array_join(F.transform(rows, lambda s: join(s["name"], F.lit(kind), *(s[f] for f in fields))), " ")

    parts = [
        F.col("file_path"),
        of_kind("function", "signature", "doc"),
        of_kind("class", "doc"),
        of_kind("method", "signature", "doc"),
        of_kind("interface", "doc"),
        of_kind("type", "signature", "doc"),
        of_kind("enum", "value", "doc"),
        of_kind("constant", "value"),
        F.array_join(F.transform("imports", lambda i: join(i["source"], i["imported"], i["local"])), " "),
        F.array_join(F.transform("exports", lambda e: join(e["source"], e["local"], e["exported"])), " "),
        F.array_join(F.transform(F.filter("comments", lambda c: c["kind"].isin("jsdoc", "docstring")), lambda c: c["text"]), " "),
    ]
    return parsed.select("file_path", F.lower(join(*parts)).alias("text"))


def documented(comments: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """file_path, comment line and the symbol that follows it within so many lines, the nearest one."""
    from fathomix.operators.symbols import kind_rank

    c = comments.filter(F.col("kind").isin("jsdoc", "docstring")).select("file_path", F.col("line").alias("comment_line"), "text")
    s = symbols.filter(F.col("kind").isin("function", "class", "interface")).select("file_path", "name", "kind", "line")
    # Rows meet in buckets of so many lines, a comment in two of them.
    bucket = lambda x: F.floor(F.col(x) / most)
    c = c.withColumn("__b", F.explode(F.array(bucket("comment_line"), bucket("comment_line") + 1)))
    near = c.join(s.withColumn("__b", bucket("line")), ["file_path", "__b"]).filter((F.col("line") - F.col("comment_line")).between(1, most))
    best = F.min(F.struct((F.col("line") - F.col("comment_line")).alias("distance"), kind_rank("kind").alias("r"), "name"))
    return near.groupBy("file_path", "comment_line", "text").agg(best.alias("b")).select("file_path", "comment_line", "text", "b.name", "b.distance")


def doc_tags(text: Column) -> Column:
    """The tags of a documentation block: array of struct(tag, text)."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(@\w+[^\n]*)"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"@(\w+)", 1).alias("tag"), F.trim(F.regexp_extract(x, r"@\w+\s*(.*)", 1)).alias("text")))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with the file that a relative source names, or null."""
    folder = F.regexp_replace("file_path", "/?[^/]+$", "")
    plain = F.regexp_replace("source", r"\.(js|ts|jsx|tsx)$", "")

    def step(a: Column, x: Column) -> Column:
        return F.when(x.isin(".", ""), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))

    dotted = F.when(F.col("source").startswith("./") | F.col("source").startswith("../"), F.concat_ws("/", folder, plain))
    module = F.when(F.col("file_path").endswith(".py"), F.concat_ws("/", F.when(F.col("source").startswith("."), folder), F.replace(F.regexp_replace("source", r"^\.+", ""), F.lit("."), F.lit("/"))))
    parts = F.aggregate(F.split(F.coalesce(dotted, module), "/"), F.array().cast("array<string>"), step)
    wanted = imports.withColumn("stem", F.array_join(parts, "/"))
    known = files.select(F.col("file_path").alias("resolved"), F.regexp_replace(F.regexp_replace("file_path", r"\.[^./]+$", ""), r"/(index|__init__)$", "").alias("stem"))
    first = known.groupBy("stem").agg(F.min("resolved").alias("resolved"))
    return wanted.join(first, "stem", "left").drop("stem")


def reparse(parsed: DataFrame, files: DataFrame, edited: DataFrame) -> DataFrame:
    """parsed after edits: the rows of files whose paths ``edited`` holds are parsed again from ``files``, all others are kept
    as they are; a file that is gone loses its row."""
    paths = edited.select("file_path").distinct()
    return parsed.join(paths, "file_path", "left_anti").select(*parsed.columns).unionByName(parse_files(files.join(paths, "file_path", "left_semi")))


def captures(symbols: DataFrame) -> DataFrame:
    """file_path, capture, name, line, end_line: what the usual syntax patterns name, one row for each that a symbol meets."""
    has = lambda mark: F.array_contains("modifiers", mark)
    method, function = F.col("kind") == "method", F.col("kind") == "function"
    found = {
        "function.definition": function,
        "function.async": function & has("async"),
        "function.generator": function & has("generator"),
        "method.definition": method,
        "method.async": method & has("async"),
        "method.static": method & (has("static") | has("staticmethod")),
        "method.constructor": method & F.col("name").rlike(r"\.(constructor|__init__)$"),
        "class.definition": F.col("kind") == "class",
        "class.extends": (F.col("kind") == "class") & (F.size("extends") > 0),
        "interface.definition": F.col("kind") == "interface",
        "documented": F.coalesce(F.length("doc"), F.lit(0)) > 0,
    }
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in found.items())), lambda x: x.isNotNull())
    return symbols.select("file_path", F.explode(names).alias("capture"), "name", "line", "end_line")


CHUNK_KINDS = ("function", "method", "class", "property", "interface", "type", "enum", "constant")


def chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A chunk for each function, method, constructor, property and class, with its code and context."""
    code = X.code_by_span(F.col("content"), F.col("line"), F.col("end_line"))
    is_async = F.array_contains("modifiers", "async")
    kind = F.when(F.array_contains("modifiers", "generator"), "generator").when(F.col("name").rlike(r"\.(constructor|__init__)$"), "constructor")
    kind = kind.when((F.col("kind") == "method") & is_async, "async_method").when((F.col("kind") == "function") & is_async, "async_function").otherwise(F.col("kind"))
    rows = symbols.filter(F.col("kind").isin("function", "method", "class", "property")).join(files.select("file_path", "language", "content"), "file_path").withColumn("code", code)
    whole = F.concat_ws("\n", "doc", "signature", "code")
    return rows.select(
        F.sha2(F.concat_ws(" ", "name", X.normalise_space(whole)), 256).alias("chunk_hash"),
        F.col("file_path").alias("file_id"),
        kind.alias("chunk_type"),
        F.substring_index("name", ".", -1).alias("name"),
        F.col("code").alias("content"),
        X.normalise_space(F.col("code")).alias("normalized_content"),
        F.col("line").alias("start_line"),
        F.col("end_line"),
        F.col("language"),
        F.struct(F.col("parent").alias("class_name"), F.col("file_path").alias("module_path"), F.col("signature").alias("method_signature"), F.col("parent").isNull().alias("is_top_level")).alias("context"),
        F.col("doc").alias("documentation"),
        F.col("signature"),
        (F.col("end_line") - F.col("line") + 1).alias("line_count"),
        F.length("code").alias("character_count"),
    )
