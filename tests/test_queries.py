"""Every registered query of the reference tables against its SQL."""

import pytest

from fathomix.plans.registry import ORACLE_SQL, QUERIES
from helpers import assert_same, connect


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    found = QUERIES[name](spark, data).toPandas()
    if name in ORACLE_SQL:
        assert_same(found, duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(found)


def test_names_match():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark, data):
    """Search reads two columns of documents, and a symbol filter reaches the scan."""
    plan = QUERIES["rnk04_sparse_cosine"](spark, data)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = QUERIES["rnk13_code_aware_search"](spark, data)._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan


@pytest.mark.parametrize("name", ["gr06_cross_references", "gr07_call_types", "ext15_documented_symbols"])
def test_files_are_parsed_once(spark, data, name):
    """A plan that reads several tables of files reads stored ones; it neither parses nor searches lines again."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "regexp_extract_all" not in plan
