"""Stems, word ids, packed matrices, and the entry without the training-data subpackage."""

import sys

import pytest

from fathomix.functions import tokens
from fathomix.operators import sparse
from fathomix.sources import store


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky")]
    + [("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("generalizations", "gener"), ("oscillators", "oscil"), ("y", "y"), ("été", "été")],
)
def test_porter(word, stem):
    assert tokens.porter(word) == stem


def test_word_ids():
    ids, mask = tokens.encode_words("Hello, world!", 6)
    assert (ids[0], ids[3], ids[4:], mask) == (2, 3, [0, 0], [1, 1, 1, 1, 0, 0])
    assert ids[1] == 99162322 % 30000 + 4 and ids[2] == 113318802 % 30000 + 4
    assert tokens.encode_words(None, 4) == ([2, 3, 0, 0], [1, 1, 0, 0])
    assert len(tokens.encode_words("a " * 900)[0]) == 512


def test_pack():
    rows = [([1, 5], [0.5, 0.25]), ([], []), ([7], [1.0])]
    assert store.unpack(store.pack(rows)) == rows
    assert store.unpack(store.pack([])) == []


def test_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "the cat"), (2, None), (3, "a dog sat")], "doc_id long, text string")
    v = sparse.sparse_vectors(df, "doc_id", "text")
    store.write_vectors(v, str(tmp_path / "v"), "doc_id")
    back = store.read_vectors(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
    rows = sparse.compressed_rows(v, "doc_id")
    again = store.import_blocks(store.export_blocks(rows, "doc_id"), "doc_id")
    assert {r.doc_id: r["columns"] for r in again.collect()} == {r.doc_id: r["columns"] for r in rows.collect()}


def test_entry_without_subpackage(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = __spark_entry__.queries()
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_words_stay_in_arrow_buffers(spark):
    """Ids and stems of a batch are not lists of Python values; null texts, words and lists keep their places."""
    df = spark.createDataFrame([(1, "Ponies, été running"), (2, None), (3, ""), (4, "a " * 900)], "id long, text string")
    coded = df.select("id", tokens.word_ids(df.text, 8).alias("t"))
    assert "], 250" in coded._jdf.queryExecution().executedPlan().toString()  # a function on Arrow arrays, not on pandas series
    assert {r.id: (r.t.ids, r.t.mask) for r in coded.collect()} == {r.id: tokens.encode_words(r.text, 8) for r in df.collect()}
    lists = spark.createDataFrame([(1, ["ponies", "été", None, "ponies"]), (2, None), (3, []), (4, ["running"])], "id long, w array<string>").coalesce(1)
    out = lists.select("id", tokens.stems(lists.w).alias("s"))
    assert sorted(map(tuple, out.collect())) == [(1, ["poni", tokens.porter("ete"), None, "poni"]), (2, None), (3, []), (4, ["run"])]
