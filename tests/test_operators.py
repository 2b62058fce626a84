"""Operators on small fixtures."""

import datetime

import numpy as np
import pandas as pd
import random

import pytest
from pyspark.sql import functions as F

from fathomix.operators import changes, chunks, graph, joins, ranking, search, sparse, stats, symbols


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fusion(spark):
    lex = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "file string, line int, rank int")
    vec = spark.createDataFrame([("a", 1, 1), ("c", 3, 2)], "file string, line int, rank int")
    out = {r["file"]: r for r in ranking.fuse(lex, vec, ["file", "line"]).collect()}
    assert len(out) == 3 and out["a"]["score"] == pytest.approx(0.5 / 61 + 0.4 / 61) and out["a"]["final_rank"] == 1
    assert out["b"]["vector_rank"] is None and out["b"]["score"] == pytest.approx(0.5 / 62)
    assert ranking.fuse(lex, vec.limit(0), ["file", "line"], limit=1).count() == 1


def test_config():
    with pytest.raises(ValueError, match="exceed"):
        ranking.RankingConfig(alpha=0.8, beta=0.4)
    with pytest.raises(ValueError, match="candidate_limit"):
        ranking.RankingConfig(candidate_limit=5)
    assert ranking.RankingConfig(alpha=1.0, beta=0.0, gamma=0.0).extreme() and not ranking.RankingConfig().extreme()


def test_diversify(spark):
    items = [("src/main.ts", 1 - i / 100, i) for i in range(6)] + [("src/other.ts", 0.5, 9)]
    df = spark.createDataFrame(items, "file_path string, score double, id int")
    out = ranking.diversify(df, ties=["id"], config=ranking.RankingConfig(max_per_file=2)).toPandas()
    assert (out.file_path == "src/main.ts").sum() == 2 and (out.file_path == "src/other.ts").sum() == 1
    assert list(out.final_rank) == [1, 2, 3]
    single = ranking.diversify(df.filter("file_path = 'src/main.ts'"), ties=["id"], config=ranking.RankingConfig(max_per_file=1)).toPandas()
    assert list(single.id) == [0, 1, 2, 3, 4, 5] and not single.penalty.any()
    by_score = ranking.diversify(df, ties=["id"], config=ranking.RankingConfig(lambda_=1.0, max_per_file=10)).toPandas()
    assert list(by_score.score) == sorted(by_score.score, reverse=True)
    assert ranking.diversify(df.limit(0), ties=["id"]).count() == 0


def test_likeness_matches_column(spark):
    from fathomix.functions.paths import similarity

    pairs = [("a/b.ts", "a/c.ts"), ("x", ""), ("same", "same"), ("kitten", "sitting")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("s", similarity(F.col("a"), F.col("b")))
    assert [r["s"] for r in df.collect()] == [pytest.approx(ranking.path_likeness(a, b)) for a, b in pairs]


def test_ties(spark):
    cols = "file_path string, symbol_type string, symbol_name string, language string, score double"
    near = spark.createDataFrame([("src/a.py", "function", "parse", "python", 0.5), ("b.py", "comment", "x", "go", 0.505), ("docs/c", "class", "y", None, 0.502)], cols)
    out = ranking.break_ties(near, "parse in python", ["file_path"]).toPandas().set_index("file_path")
    assert out.tie_group.nunique() == 1 and (out.tie_score > 0).all()
    assert out.tie_score["src/a.py"] == pytest.approx(0.1 * (0.3 + 0.3 + 0.2 + 0.2)) and out.final_score.idxmax() == "src/a.py"
    far = near.withColumn("score", F.when(F.col("file_path") == "b.py", 1.0).when(F.col("file_path") == "docs/c", 0.7).otherwise(F.col("score")))
    assert not ranking.break_ties(far, "q", ["file_path"]).toPandas().tie_score.any()


def test_relevance(spark):
    c = search.relevance(F.lit(3), F.lit(10000), F.lit(20.0), F.lit(False))
    assert spark.range(1).select(c).first()[0] == 40
    none = search.relevance(F.lit(0), F.lit(200000), F.lit(None).cast("double"), F.lit(False))
    assert spark.range(1).select(none).first()[0] == 0


def test_search_text(spark):
    df = spark.createDataFrame([(1, "Foo bar\nfoo.bar\nfoobar"), (2, None), (3, "")], "doc_id int, text string")
    assert rows(search.text_search(df, "foo.bar")) == [(1, 2, "foo.bar")]
    assert len(rows(search.text_search(df, "foo", ignore_case=True, whole_word=True))) == 2
    assert len(rows(search.text_search(df, "fo+.?bar", regex=True))) == 2


def test_bm25(spark):
    df = spark.createDataFrame([(1, "cat dog"), (2, "cat cat cat"), (3, "bird"), (4, None)], "doc_id int, text string")
    out = rows(search.bm25(df, "Cat"))
    assert [r[0] for r in out] == [2, 1] and all(r[1] > 0 for r in out)
    assert search.bm25(df, "!!").count() == 0


def test_sparse_matches_brute_force(spark):
    texts = ["the cat", "a  dog\n", "", None, "the cat sat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = dict(sparse.sparse_scores(df, "text", "The Cat").select("doc_id", "sparse_score").collect())
    assert got[0] == pytest.approx(1) and got[2] == got[3] == 0 and 0 < got[4] < 1
    index = dict(rows(sparse.index_scores(sparse.sparse_vectors(df, "doc_id", "text"), "doc_id", "The Cat")))
    assert index[4] == pytest.approx(got[4])


def test_weights():
    assert search.weights_for("plain words") == (0.6, 0.4)
    assert search.weights_for("parse()") == (pytest.approx(0.45), pytest.approx(0.55))


SYMBOLS = [("parse", "function", "a.ts", 1), ("Parser", "class", "a.ts", 5), ("Parser.parse", "method", "a.ts", 6), ("prase", "function", "b.ts", 2), ("x", "constant", "b.ts", 9)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(SYMBOLS, "name string, kind string, file_path string, line int")


def test_symbols(table):
    assert [r.name for r in symbols.exact(table, "parse").collect()] == ["parse"]
    assert [r.name for r in symbols.prefix(table, "PARSE").collect()] == ["Parser", "Parser.parse", "parse"]
    assert [r.name for r in symbols.substring(table, "ras").collect()] == ["prase"]
    assert [(r.name, r.distance) for r in symbols.fuzzy(table, "parse").collect()] == [("parse", 0), ("Parser", 1), ("prase", 2)]
    assert [r.kind for r in symbols.definitions(table, "parse").collect()] == ["function"]
    assert [r.name for r in symbols.definitions(table.filter("kind <> 'function'"), "parse").collect()] == ["Parser.parse"]
    p = symbols.postings(table)
    assert {r.name for r in symbols.candidates_any(p, "x").collect()} == {"x"}
    q = symbols.postings(table, padded=False)
    assert {r.name for r in symbols.candidates_all(q, "parse").collect()} == {"parse", "Parser", "Parser.parse"}
    assert symbols.candidates_all(q, "ab").count() == 0
    assert symbols.statistics(table).first()["n_symbols"] == 5


def test_references(spark, table):
    edges = spark.createDataFrame([("b.ts", "prase", "parse"), ("c.ts", "f", "parse")], "file_path string, caller string, callee string")
    imports = spark.createDataFrame([("b.ts", "parse", "parse")], "file_path string, imported string, local string")
    exports = spark.createDataFrame([("a.ts", "parse", "parse")], "file_path string, local string, exported string")
    assert rows(symbols.references(table, edges, imports, exports, "parse"), "file_path") == [("a.ts", "definition"), ("b.ts", "import"), ("c.ts", "call")]
    assert rows(symbols.callers(edges, table, "parse"), "file_path") == [("b.ts", "prase", 2), ("c.ts", "f", None)]
    assert [(r.callee, r.file_path) for r in symbols.callees(edges, table, "prase").collect()] == [("parse", "a.ts")]


def test_graph(spark):
    e = spark.createDataFrame([("entry", "mid"), ("mid", "leaf1"), ("mid", "leaf2"), ("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")], "caller string, callee string")
    up = {r.name: r.depth for r in graph.call_hierarchy(e, "leaf1", reverse=True).collect()}
    assert up == {"mid": 1, "entry": 2}
    down = {r.name: r.has_cycle for r in graph.call_hierarchy(e, "a").collect()}
    assert down == {"b": False, "c": False, "a": True}
    assert sorted(r.cycle for r in graph.cycles(e).collect()) == [["a", "b", "c"], ["s"]]
    assert {r.name for r in graph.unused(e.select(F.col("caller").alias("name")), e).collect()} == {"entry", "s"}
    maps = {r.name: (r.calls, r.called_by) for r in graph.call_maps(e).collect()}
    assert maps["mid"] == (["leaf1", "leaf2"], ["entry"]) and maps["leaf1"] == ([], ["mid"])
    assert graph.call_hierarchy(e.limit(0), "a").count() == 0


CHUNKS = [(str(i), t, lang, f"f{i % 2}", f"code {i}", n, 10 * i) for i, (t, lang, n) in enumerate([("function", "python", 10), ("method", "typescript", 20), ("class", "javascript", 6000), ("function", "typescript", 5), ("property", "python", 1), ("method", "python", 50), ("function", "javascript", 70), ("generator", "typescript", 3)])]


def test_chunks(spark):
    df = spark.createDataFrame(CHUNKS, "id string, chunk_type string, language string, file_id string, content string, line_count int, character_count int").withColumn("start_line", F.col("line_count"))
    assert chunks.ChunkQuery(types=("function", "method")).filter(df).count() == 5
    q = chunks.ChunkQuery(types=("function",))
    first, second = (chunks.run(df, q.page(n, 2)).collect() for n in (1, 2))
    assert len(first) == 2 and first[0].has_more and first[0].total == 3 and len(second) == 1 and not second[0].has_more and second[0].page == 2
    stat = {(r.grouping, r.value): r.n for r in chunks.statistics(df).collect()}
    assert stat["total", "all"] == 8 and stat["language", "python"] == 3 and stat["chunk_type", "function"] == 3
    assert chunks.statistics(df.limit(0)).collect()[0].n == 0
    with pytest.raises(ValueError, match="page"):
        q.page(0, 1)


def test_chunk_upsert(spark):
    a = spark.createDataFrame([("h1", "x"), ("h2", "y")], "chunk_hash string, content string")
    assert chunks.upsert(a, spark.createDataFrame([("h2", "y"), ("h3", "z")], a.schema)).count() == 3
    with pytest.raises(ValueError, match="collision"):
        chunks.upsert(a, spark.createDataFrame([("h1", "other")], a.schema))


def _events(spark, *items):
    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, p, k, t + datetime.timedelta(seconds=s)) for i, (p, k, s) in enumerate(items)], "id long, path string, type string, ts timestamp")


def test_coalesce(spark):
    e = _events(spark, ("a", "create", 1), ("a", "delete", 2), ("b", "modify", 1), ("b", "modify", 5), ("c", "create", 1), ("c", "modify", 2), ("d", "modify", 1), ("d", "delete", 2), ("e", "create", 1))
    out = {r.path: (r.type, r.ts.second, r.id) for r in changes.coalesced(e).collect()}
    assert out == {"b": ("modify", 1, 3), "c": ("create", 1, 4), "d": ("delete", 2, 7), "e": ("create", 1, 8)}
    s = changes.buffer_statistics(e).first()
    assert (s.total_events, s.unique_paths, s.coalesced_events) == (9, 5, 4) and s.compression_ratio == pytest.approx(5 / 9)
    assert changes.buffer_statistics(e.limit(0)).first().compression_ratio == 0


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "path string, mtime double")
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("d", 1.0)], "path string, mtime double")
    assert dict(changes.compare(old, new, "path", "mtime").select("path", "status").collect()) == {"a": "unchanged", "b": "updated", "c": "deleted", "d": "added"}
    assert rows(changes.upsert(old, new, "path", "mtime"), "path") == [("a", 1.0), ("b", 2.0), ("c", 1.0), ("d", 1.0)]
    assert rows(changes.delete(old, new, "path"), "path") == [("c", 1.0)]
    assert changes.keep_latest(new, 1, "mtime").count() == 1


def test_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 15, 12, 18, 22, 25, 30, 35, 40, 100)], "v double")
    p = stats.percentiles(df, "v").first()
    assert (p.p50, p.p95) == (22, 100)
    h = spark.createDataFrame([("a", "HEALTHY"), ("a", "ERROR"), ("b", "odd")], "g string, s string")
    assert dict(stats.health(h, "s", "g").collect()) == {"a": "ERROR", "b": "HEALTHY"}
    b = stats.benchmark(spark.createDataFrame([(1, 10, 0.0, 5)], "f int, b int, s double, m int"), "f", "b", "s", "m").first()
    assert b.files_per_s == 0
    plan = stats.analyse_plan(df.crossJoin(df.withColumnRenamed("v", "w")))
    assert plan["warnings"] and plan["score"] < 100


def test_nearest_and_container(spark):
    c = spark.createDataFrame([("f", 1, 10), ("f", 2, 20)], "file string, id int, line int")
    s = spark.createDataFrame([("f", 7, 12), ("f", 8, 14), ("f", 9, 26), ("g", 6, 11)], "file string, id int, line int")
    assert rows(joins.nearest_following(c, s, ["file"], "line", 5, "id", "id")) == [(1, 7, 2)]
    spans = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 10, 20)], "file string, id int, a int, b int")
    calls = spark.createDataFrame([("f", 5, 12, 13), ("f", 6, 30, 31), ("f", 7, 200, 201)], "file string, id int, a int, b int")
    assert rows(joins.innermost_container(calls, spans, ["file"], "a", "b", "id", "id"), "point_id") == [(5, 2), (6, 1)]


def test_mmr_without_rows():
    out = ranking.mmr(pd.DataFrame({"path": ["a"], "score": [1.0]}), ranking.RankingConfig())
    assert list(out.final_rank) == [1]


def test_cycles_of_any_length(spark):
    """Two rings, of 9 and of 12 nodes, with a way between them that is no cycle."""
    ring = lambda p, n: [(f"{p}{i:02}", f"{p}{(i + 1) % n:02}") for i in range(n)]
    e = spark.createDataFrame([*ring("a", 9), *ring("b", 12), ("a03", "b05"), ("x", "a00"), ("b01", "y"), ("s", "s"), (None, "a00")], "caller string, callee string")
    assert sorted(r.cycle for r in graph.cycles(e).collect()) == [[f"a{i:02}" for i in range(9)], [f"b{i:02}" for i in range(12)], ["s"]]
    part = {r.name: r.component for r in graph.strong_components(e).collect()}
    assert part == {**{f"a{i:02}": "a00" for i in range(9)}, **{f"b{i:02}": "b00" for i in range(12)}, "s": "s"}
    assert [r.cycle for r in graph.cycles(e, depth=8).collect()] == [["s"]] and graph.strong_components(e.limit(0)).count() == 0
    far = {r.name: r.depth for r in graph.call_hierarchy(e, "x", None).collect()}
    assert far["y"] == 14 and len(far) == 22 and max(far.values()) == 16
    assert {r.name for r in graph.call_hierarchy(e, "x", 3).collect()} == {"a00", "a01", "a02"}


def test_neighbours(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b"), ("d", "e")], "caller string, callee string")
    names = spark.createDataFrame([("b",), ("z",)], "name string")
    assert [(r.name, r.calls, r.called_by) for r in graph.neighbours(e, names).collect()] == [("b", ["c"], ["a", "d"])]


def test_ties_keep_all_rows(spark):
    """Rows beyond the candidates follow with no tie score; repeated rows are rows."""
    rows = [(f"src/f{i % 250}.py", "function", "x", "python", 1 - i / 10_000) for i in range(260)] + [("src/f0.py", "function", "x", "python", 0.0)] * 2
    df = spark.createDataFrame(rows, "file_path string, symbol_type string, symbol_name string, language string, score double")
    out = ranking.break_ties(df, "q", ["file_path"]).collect()
    assert len(out) == 262 and sum(r.tie_group is None for r in out) == 62 and all(r.tie_score == 0 for r in out if r.tie_group is None)


def test_innermost_of_any_width(spark):
    """Against all pairs, with spans from one line to very many."""
    r = random.Random(5)
    spans = [(r.choice("ab"), s, s + r.choice([0, 1, 5, 63, 64, 65, 700, 40_000]), i) for i in range(300) for s in [r.randrange(3000)]]
    points = [(r.choice("abc"), p, p + r.choice([0, 1, 3]), i) for i in range(200) for p in [r.randrange(4000)]]
    found = {x.point_id: x.span_id for x in joins.innermost_container(spark.createDataFrame(points, "k string, s int, e int, id int"), spark.createDataFrame(spans, "k string, s int, e int, id int"), ["k"], "s", "e", "id", "id").collect()}
    expected = {}
    for k, s, e, i in points:
        inside = [(b - a, j) for c, a, b, j in spans if c == k and a <= s and b >= e]
        if inside:
            expected[i] = min(inside)[1]
    assert found == expected


def test_stored_search_matches_one_pass(spark):
    texts = ["the cat sat", "a dog", "", None, "the cat", "dog and cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    dense = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "doc_id int, embedding array<double>")
    lowered = df.withColumn("text", F.lower("text"))
    one = search.hybrid_search(df, dense, "Cat dog", [0.1, 0.2], 6)
    stored = search.stored_search(df.select("doc_id"), sparse.sparse_vectors(lowered, "doc_id", "text"), dense, "Cat dog", [0.1, 0.2], 6)
    assert [(r.doc_id, round(r.score, 9)) for r in one.collect()] == [(r.doc_id, round(r.score, 9)) for r in stored.collect()]
    posting = search.postings(df)
    one, stored = (rows(x) for x in (search.bm25(df, "cat dog"), search.bm25_stored(posting, search.corpus_statistics(posting), "cat dog")))
    assert [r[0] for r in one] == [r[0] for r in stored] and [r[1] for r in one] == pytest.approx([r[1] for r in stored])
    assert search.bm25_stored(posting, search.corpus_statistics(posting), "!!").count() == 0


def test_code_signs():
    assert all(search.looks_like_code(q) for q in ("f(x)", "a;", "foo.bar", "MyClass", "x => y", "index.ts", "a[0]", "std::sort"))
    assert not any(search.looks_like_code(q) for q in ("how to sort a list", "read the file", "1.5 times"))


def test_alerts(spark):
    df = spark.createDataFrame([(0, 10.0, 0, 5), (1000, 600.0, 100, 5), (2000, 900.0, 1000, 500)], "ms long, memory_mb double, cpu_ms long, lag_ms int")
    assert [r.alerts for r in stats.alerts(df, "ms").orderBy("ms").collect()] == [[], ["memory"], ["memory critical", "event loop", "cpu"]]


def test_grouped_events_stay_bounded(spark):
    df = spark.createDataFrame([("a", i, "modify", i) for i in range(25)] + [("b", 1, "create", 1)], "path string, ts long, type string, id long")
    parts = {(r.path, r.part): r.n_events for r in changes.events_by_path(df, most=10).collect()}
    assert parts == {("a", 0): 10, ("a", 1): 10, ("a", 2): 5, ("b", 0): 1}


def test_catalog(spark):
    spark.range(1).createOrReplaceTempView("here_it_is")
    found = {r.table_name: r.status for r in stats.catalog_tables(spark, ["here_it_is", "gone"]).collect()}
    assert found["here_it_is"] == "present" and found["gone"] == "missing"
    assert {r.status for r in stats.catalog_tables(spark).collect()} == {"present"}
    spark.catalog.dropTempView("here_it_is")


def test_sparse_rows_without_shuffle(spark):
    texts = [(1, "the cat sat"), (2, None), (3, "ab"), (4, "a dog sat " * 50), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sparse.sparse_rows(df, "doc_id", "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "doc_id") == rows(sparse.compressed_rows(sparse.sparse_vectors(df, "doc_id", "text"), "doc_id"), "doc_id")


@pytest.mark.parametrize("name", ["snk03_matrix_blocks", "rnk05_compressed_rows"])
def test_cells_are_not_shuffled(spark, data, name):
    """Vectors are rows from the start: no cells are gathered behind a shuffle."""
    from fathomix.plans.registry import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan


def test_blocks_are_bounded(spark):
    from fathomix.sources import store

    df = spark.createDataFrame([(i, [1, 2, 3], [0.5, 0.25, 1.0]) for i in range(20)] + [(20, list(range(40)), [1.0] * 40)], "doc_id long, columns array<int>, values array<double>").coalesce(1)
    blocks = store.export_blocks(df, "doc_id", most=10)
    assert sorted(len(r.ids) for r in blocks.collect()) == [1] + [2] + [3] * 6
    assert rows(store.import_blocks(blocks, "doc_id"), "doc_id") == rows(df, "doc_id")


def test_stored_rows_come_sorted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "the cat the"), (2, None), (3, "a dog sat Été"), (4, ""), (5, "the dog " * 30)], "doc_id long, text string").coalesce(1)
    posting, cells = search.postings(df), sparse.sorted_cells(df, "doc_id", "text")
    for out in (posting, cells):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in posting.collect()} == {(1, "the", 2, 3), (1, "cat", 1, 3), (2, None, 0, 0), (3, "a", 1, 4), (3, "dog", 1, 4), (3, "sat", 1, 4), (3, "été", 1, 4), (4, None, 0, 0), (5, "the", 30, 60), (5, "dog", 30, 60)}
    assert [r.term for r in posting.filter("term IS NOT NULL").collect()] == sorted(r.term for r in posting.filter("term IS NOT NULL").collect())
    assert [r.bucket for r in cells.collect()] == sorted(r.bucket for r in cells.collect())
    assert rows(cells, "doc_id", "bucket") == rows(sparse.sparse_vectors(df, "doc_id", "text").selectExpr("doc_id", "bucket", "tf"), "doc_id", "bucket")
    parts = sparse.sorted_cells(df, "doc_id", "text", most=5)
    assert rows(parts, "doc_id", "bucket") == rows(cells, "doc_id", "bucket")


def test_components_by_task_and_by_rounds(spark, monkeypatch):
    """Against reachability, with nodes between cycles; a small graph takes few jobs however many rings are in a row."""
    r = random.Random(3)
    edges = [("b", "c"), ("c", "b"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "d"), ("é", "z"), ("z", "é"), ("f", "f"), ("e", "f"), (None, "b"), ("b", "c")]
    edges += [(f"n{r.randrange(30):02}", f"n{r.randrange(30):02}") for _ in range(34)]
    reach = {(a, b) for a, b in edges if a}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    expected = {a: min(y for x, y in reach if x == a and (y, a) in reach) for a, b in reach if a == b}
    assert "a" not in expected and {"f", "z"} < set(expected)
    frame = spark.createDataFrame(edges, "caller string, callee string").repartition(5)
    found = lambda: sorted((x.name, x.component) for x in graph.strong_components(frame).collect())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    assert found() == sorted(expected.items())
    assert len(tracker.getJobIdsForGroup("few")) < 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(graph, "TASK_BYTES", 0)
    assert found() == sorted(expected.items())
    chain = np.arange(200_000)
    assert (graph._least_of_component(chain, (chain + 1) % 200_000, 200_000) == 0).all()


def test_innermost_in_bounded_tasks(spark, monkeypatch):
    """Tasks grow in number with the rows, not in size; a bucket too large for that is left to adaptive execution."""
    r = random.Random(8)
    spans = [(r.choice("abcdef"), s, s + r.choice([0, 3, 64, 900]), i) for i in range(300) for s in [r.randrange(2000)]]
    points = [(r.choice("abcdefg"), p, p + r.choice([0, 2]), i) for i in range(300) for p in [r.randrange(2200)]]
    frame = lambda x: spark.createDataFrame(x, "k string, s int, e int, id int")
    find = lambda p: joins.innermost_container(frame(p), frame(spans), ["k"], "s", "e", "id", "id")
    planned = lambda df: "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    hot = points + [("a", 70, 71, 1000 + i) for i in range(200)]
    expected = [dict(find(p).collect()) for p in (points, hot)]
    assert not planned(find(points)) and len(expected[0]) > 50
    monkeypatch.setattr(joins, "TASK_ROWS", 40, raising=False)
    assert planned(find(points)) and dict(find(points).collect()) == expected[0]
    assert not planned(find(hot)) and dict(find(hot).collect()) == expected[1]
