"""Literal cases of text, path and vector functions."""

import math

import pytest
from pyspark.sql import functions as F

from fathomix.functions import paths as P
from fathomix.functions import text as X
from fathomix.functions import vectors as V
from fathomix.operators import sparse


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_fnv1a(spark):
    assert one(spark, X.fnv1a(F.lit("abc"))) == 440920331 == sparse.token_hash("abc")


def test_kgrams(spark):
    assert one(spark, X.padded_kgrams(F.lit("hello"))) == ["$he", "hel", "ell", "llo", "lo$"]
    assert one(spark, X.grams(F.lit("ab"), 3)) == []


def test_gram_hashes_equal_sql(spark):
    text = "Le  été à Paris 😀"
    got = sorted(sparse.gram_hashes("le été à"))
    grams = [g for n in (3, 4, 5) for g in ("le été à"[i : i + n] for i in range(8 - n + 1))]
    assert got == sorted(sparse.token_hash(g) for g in grams)
    assert len(sparse.gram_hashes(text)) == sum(len("Le été à Paris 😀".encode("utf-16-le")) // 2 - n + 1 for n in (3, 4, 5))


def test_empty_vector():
    b, n = sparse.gram_counts(None)
    assert len(b) == len(n) == 0
    assert not sparse.hash_vector("", 8).any()
    assert math.isclose(sparse.hash_vector("a b a", 8) @ sparse.hash_vector("a b a", 8), 1)


def test_identifiers(spark):
    assert sorted(one(spark, X.identifier_parts(F.lit("getUser_name.id")))) == ["get", "getuser_name.id", "id", "name", "user"]


@pytest.mark.parametrize(("line", "position", "width", "expected"), [("abc", None, 5, "abc"), ("abcdef", None, 5, "abcd…"), ("abcdefghij", 5, 4, "…ef…"), ("abcdefghij", 9, 4, "…hij"), ("abcdefghij", 0, 4, "abc…")])
def test_truncate(spark, line, position, width, expected):
    assert one(spark, X.truncate_line(F.lit(line), None if position is None else F.lit(position), width)) == expected


def test_previews(spark):
    text = "\n".join(f"l{i}" for i in range(1, 21))
    p = one(spark, X.preview(F.lit(text), F.lit(10)))
    assert p["start_line"] == 7 and p["lines"] == [f"l{i}" for i in range(7, 15)]
    assert one(spark, X.preview(F.lit(text), F.lit(99)))["lines"][-1] == "l20"
    assert one(spark, X.marked_preview(F.lit(text), F.lit(1), 1)) == "→ l1\n  l2\n..."
    assert one(spark, X.marked_preview(F.lit(text), F.lit(10), 1, numbered=True)) == "...\n 9  l9\n10→ l10\n11  l11\n..."
    assert one(spark, X.marked_preview(F.lit(text), F.lit(21))) is None
    assert one(spark, X.code_by_span(F.lit(text), F.lit(19), F.lit(30))) == "l19\nl20"


def test_dedent(spark):
    assert one(spark, X.dedent(F.lit("\n    a\n      b\n\n    c\n\n"))) == "a\n  b\n\nc"
    assert one(spark, X.dedent(F.lit(" \n "))) == ""
    same = one(spark, X.chunk_id(F.lit("  f(){\n    x\n  }")) == X.chunk_id(F.lit("f(){\n  x\n}")))
    assert same and one(spark, X.is_chunk_id(X.chunk_id(F.lit("a"))))


def test_semantic_hash(spark):
    h = lambda b: one(spark, X.semantic_hash(F.lit("f(a)"), F.lit(b)))
    assert h("x = 1 // one\n  y") == h("x  =  1\ny /* two */") != h("x = 2\ny")
    assert len(h("x")) == 16


def test_binary(spark):
    assert one(spark, X.has_nul(F.lit("a\0b"))) and not one(spark, X.has_nul(F.lit("ab")))
    assert not one(spark, X.is_text(F.lit("a\0b"))) and one(spark, X.is_text(F.lit("a\tb\r\n")))
    assert one(spark, X.looks_binary(F.lit("\x01\x02\x03ab"))) and not one(spark, X.looks_binary(F.lit("plain")))


def test_formats(spark):
    sizes = [one(spark, X.format_bytes(F.lit(n))) for n in (5, 2048, 3 * 1024**2, 5 * 1024**3)]
    assert sizes == ["5 B", "2.00 KB", "3.00 MB", "5.00 GB"]
    assert one(spark, X.format_match(F.lit("a.ts"), F.lit(7), F.lit("x"))) == "a.ts:   7: x"
    assert one(spark, X.mask_key(F.lit("abcdefgh"))) == "****efgh" and one(spark, X.mask_key(F.lit("abc"))) == "****"
    assert [one(spark, X.retry_delay(F.lit(n))) for n in (1, 2, 9)] == [1000, 2000, 30000]
    assert one(spark, X.file_status(F.lit(" r100"))) == "renamed" and one(spark, X.file_status(F.lit("?"))) == "unknown"
    assert one(spark, X.error_category(F.lit("EBUSY"))) == "transient"
    assert one(spark, X.qualified_name(F.lit("A"), F.lit("n"), F.lit("f"))) == "A.f" and one(spark, X.qualified_name(F.lit(""), F.lit("n"), F.lit("f"))) == "n.f"
    assert one(spark, X.sanitise(F.lit("a\tb\x07"))) == "a  b"


def test_paths(spark):
    assert [one(spark, P.priority(F.lit(p))) for p in ("src/parser.test.ts", "parser.test.ts", "doc/README.md", "foo/bar/baz.ts")] == [1.0, 0.6, 0.4, 0.5]
    s = lambda a, b: one(spark, P.similarity(F.lit(a), F.lit(b)))
    assert s("a/b", "a/b") == 1 and s("", "a") == 0 and s("", "") == 0 and s("a/b.ts", "a/c.py") == s("a/c.py", "a/b.ts")
    assert one(spark, P.language(F.lit("a/B.TSX"))) == "typescript" and one(spark, P.language(F.lit("x/Dockerfile"))) == "dockerfile" and one(spark, P.language(F.lit("noext"))) is None
    assert one(spark, P.extension(F.lit("a/b.tar.gz"))) == ".gz" and one(spark, P.extension(F.lit("a/.env"))) == ""
    assert one(spark, P.normalise(F.lit("a//b\\c/./d/"))) == "a/b/c/d"
    assert one(spark, P.is_within(F.lit("src/a"), F.lit("src"))) and not one(spark, P.is_within(F.lit("srcs/a"), F.lit("src")))
    assert one(spark, P.matches_any(F.lit("a/b.ts"), ["*.ts"])) and not one(spark, P.matches_any(F.lit("a/b.ts"), ["?.ts"]))
    assert one(spark, P.has_binary_extension(F.lit("x.PNG"))) and one(spark, P.is_hidden(F.lit("a/.b")))


@pytest.mark.parametrize(("path", "ignored"), [("a.log", True), ("x/node_modules/y.js", True), ("node_modules.js", False), ("build/a.ts", True), ("src/build/a.ts", True), ("out/keep.ts", False), ("out/b.ts", True), ("docs/a/b.md", True), ("x/docs/a/b.md", False)])
def test_ignore(spark, path, ignored):
    rules = P.IgnoreRules(["build/", "out/*", "!out/keep.ts", "/docs/**/*.md", "# note", ""])
    assert one(spark, rules.ignored(F.lit(path))) is ignored


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, V.dot(v(1.0, 2.0), v(3.0, 4.0))) == 11
    assert one(spark, V.cosine(v(0.0, 0.0), v(1.0, 0.0))) == 0
    assert one(spark, V.normalise(v(3.0, 4.0))) == [0.6, 0.8]
    assert one(spark, V.is_valid(v(1.0, float("nan")), 2)) is False and one(spark, V.is_valid(v(1.0), 2)) is False
    with pytest.raises(Exception, match="different length"):
        one(spark, V.dot(v(1.0), v(1.0, 2.0)))
