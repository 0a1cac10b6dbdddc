"""Every relational query against its DuckDB counterpart, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from psephon.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return str(v)[:10] if hasattr(v, "year") else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_gbt_scores_every_document(spark):
    got = registry.queries()["gbt_fit_predict"](spark, SF).toPandas()
    ids = spark.read.parquet(f"{SF}/documents.parquet").toPandas().doc_id
    assert sorted(got.doc_id) == sorted(ids) and got.p.between(0, 1).all() and set(got.fold) == {0, 1, 2}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_corpus_operators(spark, monkeypatch):
    """The entry module imports, and the other queries stay, where the corpus operators are gone."""
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("psephon.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "psephon.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as e

    e = importlib.reload(e)
    assert set(e.queries()) == set(registry.queries()) and set(e.oracle_sql()) == set(registry.oracle_sql())
    monkeypatch.undo()
    importlib.reload(e)
