"""Every corpus query that SQL can express, beside its SQL on the smallest tables; the others must run and keep all rows."""

import pytest

import suite
from geoledger.llm import queries
from tools import check

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name, monkeypatch):
    monkeypatch.setattr(suite, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(suite, "ORACLES", queries.ORACLES)
    assert check.compare(spark, duck, name, SF_DIR) is None


def test_all_operators_are_registered():
    import __spark_entry__

    registered = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in registered if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in registered


@pytest.mark.parametrize("name, table", [("op4_html_extraction", "pages"), ("op5_source_mix", "documents"),
                                         ("op9_toxicity", "documents"), ("op10_secret_scan", "documents")])
def test_one_row_each(spark, name, table):
    rows = queries.QUERIES[name](spark, SF_DIR)
    assert rows.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
