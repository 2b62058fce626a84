"""The registered queries against their SQL, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomix.llm import pieces, queries
from helpers import assert_same, connect
from llm.test_dedup import brute_components, brute_tree
from llm.test_texts import brute_contamination


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data).toPandas(), connect(data).execute(queries.ORACLE_SQL[name]).df())


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))


def test_stages(spark, data, docs):
    """Each stage works on its own input and keeps its columns."""
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, data)
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, data).filter("predicted = 1").collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    lines = stage["line dedup"](spark, clean, data)
    assert lines.columns == docs.columns and lines.count() == clean.count() and lines.filter(F.col("n_chars") != F.length("text")).count() == 0
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    near = stage["near dedup"](spark, lines, data)
    assert {r.doc_id for r in near.collect()} == {c for _, c in brute_components(rows, 80).values()}
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id: r.text for r in near.collect()}
    hits = brute_contamination(kept.items(), bench)
    left = {r.doc_id: r.text for r in stage["decontamination"](spark, near, data).collect()}
    assert set(left) == {d for d, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
    assert all(left[d] == kept[d] for d in left if not hits[d][1])
    ids = stage["pieces"](spark, near, data)
    assert ids.filter("NOT round_trip").count() == 0


def test_run_matches_brute_force(spark, data, docs):
    """All stages after the classifier, whose decisions the query gives, on plain Python."""
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, data).filter("predicted = 1").collect()}
    rows = brute_tree([(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic])
    one = {c for _, c in brute_components(rows.items(), 80).values()}
    rows = {i: t for i, t in rows.items() if i in one}
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_contamination(rows.items(), bench)
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "ids", "n_ids", "round_trip"]
    found = {r.doc_id: r for r in out.collect()}
    assert set(found) == {d for d, (n, h, _) in hits.items() if not (h and 20 * h >= n)} and len(found) > 50
    for d, r in found.items():
        assert r.round_trip and r.n_ids == len(r.ids)
        if not hits[d][1]:
            assert r.ids == (library.encode(rows[d]) if rows[d] else [])


def test_stages_keep_clashing_columns(spark, data, docs):
    """Extra columns named like those that operators use come through every stage but the last."""
    names = ("score", "__score", "places", "line", "component_id", "kept", "items", "n_words", "shingles", "__doc", "doc", "row", "ids")
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, data)
        assert out.columns == wide.columns, name
        assert out.select(*names).distinct().collect() == [tuple(range(len(names)))], name
    assert corpus_pipeline.encode(spark, wide, data).columns == ["doc_id", "ids", "n_ids", "round_trip"]


def test_run_on_odd_documents(spark, tmp_path, edges, data):
    edges.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {r.doc_id: r.n_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {None, 10, 11, 12, 13, 15, 16, 17} and found[10] == found[11] == 0
