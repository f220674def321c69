"""Summaries of partitions beside a store: equal to scans after every kind of write."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from geoledger.operators import discovery
from geoledger.operators.aggregate import unique_values
from geoledger.operators.fields import Fields
from geoledger.operators.text import by_free_text
from geoledger.plans.search import SearchOptions, SearchRequest, search
from geoledger.plans.summarised import StoreSummary
from geoledger.sources import store, summaries
from geoledger.sources.summaries import Summarised

WHAT = Summarised(values=("platform", "tags", "absent"), words=("title",), limit=3)
SCHEMA = (
    "id string, collection string, datetime timestamp_ntz, start_datetime timestamp_ntz, end_datetime timestamp_ntz, "
    "platform string, tags array<string>, title string, hidden boolean, note string")


def row(number, collection="c1", day=1, platform="a", tags=(), title="Harbour view", hidden=None, dated=True, note=None):
    at = dt.datetime(2024, 1, day, number % 24)
    return (f"i{number}", collection, at if dated else None, at, at + dt.timedelta(days=1), platform, list(tags), title, hidden, note)


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def some(spark):
    return rows_of(
        spark,
        row(1, platform="a", tags=["x", "y"], title="Harbour view"), row(2, day=2, platform="b", tags=[None, "y"], title="harbor at night"),
        row(3, day=3, platform=None, title=None, hidden=True), row(4, "c2", day=4, platform="c", title="Fields"),
        row(5, "c2", day=4, platform="d", title="mountain"), row(6, "c2", day=5, platform="e", title="Habrour"),
        row(7, "007", day=6, dated=False, title="harbour"), row(8, None, day=7, platform="z", title="nowhere"))


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def agree(spark, path):
    """Fields, values and one search by words and one count equal those of the items."""
    summary, items = StoreSummary(spark, path), store.read_items(spark, path)
    assert as_set(summary.queryables()) == as_set(discovery.queryables(items))
    assert as_set(summary.unique_values()) == as_set(unique_values(items, ["platform", "tags"], 3))
    found(summary, items, "harbuor", ["title^3"])
    counted(summary, items, SearchRequest(datetime="2024-01-02T00:30:00Z/2024-01-05T23:00:00Z"), SearchOptions(hide_path="hidden"))
    return summary


def found(summary, items, q, names, **options):
    want = as_set(items.filter(by_free_text(Fields.of(items), q, names)).select("collection", "id"))
    assert as_set(summary.free_text(q, names, **options).select("collection", "id")) == want
    return want


def counted(summary, items, request, options):
    assert summary.matched(request, options) == search(items, request, options).matched()


def test_requests(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_items(some(spark), path, True, summaries=WHAT)
    summary, items = agree(spark, path), store.read_items(spark, path)
    assert as_set(summary.queryables(["c2"], ["platform"])) == as_set(discovery.queryables(items.filter("collection = 'c2'"), ["platform"]))
    assert as_set(summary.enum_values().filter("name = 'platform'")) == as_set(discovery.enum_values(items, ["platform"], 3))
    assert len(found(summary, items, "harbuor", ["title", "id"])) == 4
    assert len(found(summary, items, ["mountian", "i3"], ["title", "id", "platform"])) == 1
    assert len(found(summary, items, "harbuor", ["title"], most_words=2)) == 4
    assert not found(summary, items, "nothing", ["title"])
    for request, options in (
        (SearchRequest(), SearchOptions()), (SearchRequest(collections=["c2", "007"]), SearchOptions(hide_path="hidden")),
        (SearchRequest(datetime="../2024-01-04T01:00:00Z"), SearchOptions(hide_path="note")),
        (SearchRequest(datetime="2024-01-06T00:00:00Z/.."), SearchOptions(nanos=False)), (SearchRequest(ids=["i1"]), SearchOptions()),
    ):
        counted(summary, items, request, options)


@pytest.mark.parametrize("by_date", [False, True])
def test_equal_to_scans_after_every_write(spark, tmp_path, by_date):
    path = str(tmp_path / "store")
    store.write_items(some(spark), path, by_date, summaries=WHAT)
    store.upsert_store(rows_of(spark, row(1, title="river", platform="q"), row(9, "c3", tags=["t"], title="harbour", note="n")), path, by_date)
    agree(spark, path)
    store.delete_from_store(rows_of(spark, row(5, "c2", day=4), row(4, "c2", day=4), row(8, None)), path, by_date)
    agree(spark, path)
    store.rename_in_store(spark, path, "c2", "c9", by_date)
    store.drop_collection_from_store(spark, path, "c3", by_date)
    summary = agree(spark, path)
    assert {r[0] for r in summary.partitions.select("collection").collect()} == {"c1", "c9", "007", None}


def test_a_write_that_was_cut_off(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write_items(some(spark), path, True, summaries=WHAT)

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "close_partitions", lost)
    with pytest.raises(KeyboardInterrupt):
        store.upsert_store(rows_of(spark, row(1, title="river", platform="q"), row(10, "c4", title="harbour")), path, True)
    monkeypatch.undo()
    agree(spark, path)
    store.upsert_store(rows_of(spark, row(10, "c4", title="hill")), path, True)
    agree(spark, path)


def test_versions_are_folded(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    monkeypatch.setattr(summaries, "MOST_VERSIONS", 2)
    store.write_items(some(spark), path, summaries=WHAT)
    for n in range(2):
        store.upsert_store(rows_of(spark, row(20 + n, f"n{n}", title=f"word{n}")), path)
        store.delete_from_store(rows_of(spark, row(20 + n, f"n{n - 1}")), path)
        assert len(summaries._versions(spark, path)) <= 3
    store.drop_collection_from_store(spark, path, "c1")
    agree(spark, path)


def test_words_skip_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_items(some(spark), path, summaries=WHAT)
    found = StoreSummary(spark, path).free_text("mountian", ["title"])
    assert [r.id for r in found.collect()] == ["i5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "levenshtein" not in plan.lower()


def test_tables_without_summaries(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_items(some(spark), path)
    with pytest.raises(ValueError, match="no summaries"):
        StoreSummary(spark, path)
    copy = str(tmp_path / "copy")
    store.write_items(some(spark).limit(0), copy, summaries=WHAT)
    assert summaries.what_of(spark, copy) == WHAT


def test_only_small_columns_are_read_for_counts(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_items(some(spark), path, True, summaries=WHAT)
    request = SearchRequest(datetime="2024-01-01T00:00:00Z/2024-01-31T00:00:00Z", collections=["c2"])
    assert StoreSummary(spark, path).matched(request) == 3
    shown = StoreSummary(spark, path).partitions.agg(F.sum("rows"), F.sum("shown")).first()
    assert tuple(shown) == (8, 7)
