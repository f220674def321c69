"""The stream's own validation: every rule speaks, and only valid rows are stored."""

from datetime import datetime

from pyspark.sql import functions as F

from geoledger.streaming import ingest
from suite import QUERIES, streams
from suite.writes import batch

SF = "/root/testdata/sf0.001"


def broken(spark, sf_dir):
    """Four lines, three of which break a rule each: schema, time, topology."""
    rows = batch(spark, sf_dir).orderBy("l_orderkey", "l_linenumber").limit(4).collect()
    rows = [r.asDict() | {"id": f"i{n}"} for n, r in enumerate(rows)]
    rows[1]["collection"] = None
    rows[2]["datetime"], rows[2]["start_datetime"] = None, datetime(2024, 1, 1)
    rows[3]["l_partkey"] = -1
    return spark.createDataFrame([tuple(r.values()) for r in rows], batch(spark, sf_dir).schema)


def test_the_query_stores_valid_rows_only(spark, monkeypatch):
    monkeypatch.setattr(streams, "batch", broken)
    assert [r.id for r in QUERIES["st_validate"](spark, SF).collect()] == ["i0"]


def test_every_rule_files_its_dead_letter(spark):
    _, dead = streams.drain(spark, streams.located(broken(spark, SF)), error=streams.every_rule)
    got = {r.id: r.error.split(":")[0] for r in ingest.read_dead_letters(spark, dead).collect()}
    assert got == {"i1": "STAC validation failed", "i2": "Datetime Range Error", "i3": "Topology Error"}
    marked = streams.located(batch(spark, SF))
    assert marked.filter(F.col("l_quantity").isNotNull() & streams.every_rule(marked).isNotNull()).count() == 0
