"""Answers from the summaries of a store, after its rows were replaced and some deleted."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoledger.plans.search import SearchOptions, SearchRequest
from geoledger.plans.summarised import StoreSummary
from geoledger.sources import sample, store
from geoledger.sources.summaries import Summarised
from suite.filters import SQL_WORDS
from suite.pages import SQL_GROUPED
from suite.registry import ITEMS, case, in_time
from suite.schemas import SQL_QUERYABLES, described
from suite.scratch import fresh_dir

WHAT = Summarised(values=("platform", "title", "collection"), words=("title",))

_paths: dict[tuple[str, ...], str] = {}


def written_once(spark, sf_dir, name, write):
    """The summaries of a store that is written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _paths:
        path = fresh_dir(spark, name)
        write(path)
        _paths[key] = path
    return StoreSummary(spark, _paths[key])


def replaced(spark, sf_dir):
    """A store that held every third item with another platform and title, and a collection that is gone, before it got all items."""

    def write(path):
        titles = sample.items(spark, sf_dir).select("id", "collection", "title")
        items = described(spark, sf_dir).join(titles, ["id", "collection"])
        third = F.substring("id", 2, 20).cast("bigint") % 3 == 1
        stale = items.filter(third).withColumns({"platform": F.lit("stale"), "title": F.lit("purchase stale")})
        gone = stale.filter(F.col("collection") == "c3").withColumn("collection", F.lit("gone"))
        store.write_items(stale.unionByName(gone), path, summaries=WHAT)
        store.drop_collection_from_store(spark, path, "gone")
        store.upsert_store(items, path)

    return written_once(spark, sf_dir, "summarised", write)


def by_day(spark, sf_dir):
    """All items in a store by day, in a collection for each length of their collection's name."""

    def write(path):
        items = sample.items(spark, sf_dir).withColumn("collection", F.concat(F.lit("g"), F.length("collection").cast("string")))
        store.write_items(items, path, by_date=True, summaries=Summarised())

    return written_once(spark, sf_dir, "summarised-days", write)


SQL_PLATFORM = "CASE WHEN collection <> 'c3' THEN platform END"


@case("sd_queryables_summary", SQL_QUERYABLES)
def queryables(spark, sf_dir):
    return replaced(spark, sf_dir).queryables(exclude=["title"])


@case(
    "sd_enum_summary",
    f"SELECT DISTINCT collection, 'platform' AS name, {SQL_PLATFORM} AS value FROM items_v WHERE {SQL_PLATFORM} IS NOT NULL",
)
def enum(spark, sf_dir):
    return replaced(spark, sf_dir).enum_values().filter(F.col("name") == "platform")


_VALUES = " UNION ".join(
    f"SELECT '{name}' AS field, {value} AS value FROM items_v WHERE {value} IS NOT NULL"
    for name, value in (("platform", SQL_PLATFORM), ("title", "title"), ("collection", "collection")))


@case("agg_unique_values_summary", f"SELECT field, value FROM ({_VALUES}) QUALIFY count(*) OVER (PARTITION BY field) <= 100")
def unique_values(spark, sf_dir):
    return replaced(spark, sf_dir).unique_values()


@case(
    "f_free_text_vocabulary",
    f"SELECT id, collection FROM items_v WHERE len(list_filter({SQL_WORDS.format('title')}, lambda w: damerau_levenshtein(w, 'purchsae') <= 2)) > 0",
)
def free_text(spark, sf_dir):
    return replaced(spark, sf_dir).free_text("purchsae", ["title^3"]).select("id", "collection")


TIME = ("2024-01-05 06:00:00", "2024-01-25 18:00:00")


@case(
    "agg_number_matched_summary",
    f"SELECT count(*) AS matched FROM ({SQL_GROUPED}) WHERE collection IN ('g2', 'g3') AND {in_time(*TIME)} AND NOT coalesce(hidden, false)",
    views=ITEMS,
)
def number_matched(spark, sf_dir):
    # whole days by their summaries, the first and last day from the items
    low, high = (t.replace(" ", "T") + "Z" for t in TIME)
    request = SearchRequest(collections=["g2", "g3"], datetime=f"{low}/{high}")
    return by_day(spark, sf_dir).number_matched(request, SearchOptions(hide_path="hidden"))
