"""Queries of the corpus operators against their DuckDB counterparts, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from psephon.llm import lm, oracles, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda frame: sorted((tuple(None if v is None or v != v else v for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)
    assert key(got) == key(want)


def test_whole_model(spark, duck):
    """The whole model of order three: the query's SQL without the share that its history pairs must hold."""
    capped, whole = "cx >= greatest(3, n / 100000::DOUBLE)", "cx > 0"
    assert oracles.MODEL.count(capped) == 1
    want = duck.sql(oracles.MODEL.replace(capped, whole)).df().set_index("doc_id").sort_index()
    got = lm.score(registry.table(spark, SF, "documents"), share=None).toPandas().set_index("doc_id").sort_index()
    assert (got[["n_tokens", "n_known", "train_tokens"]] == want[["n_tokens", "n_known", "train_tokens"]]).all(axis=None)
    assert ((got[["base_score", "score"]] - want[["base_score", "score"]]).abs() < 1e-6).all(axis=None)
