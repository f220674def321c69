from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geoledger.operators import aggregate as agg


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"i{n}", f"c{n % 150}", datetime(2020, 1 + n % 3, 1, n % 24), n % 50 * 1.0, "hot" if n % 3 else f"p{n}") for n in range(600)]
    return spark.createDataFrame(rows, "id string, collection string, datetime timestamp_ntz, `eo:cloud_cover` double, platform string")


def rows(df):
    return {(r["name"], r["key"]): r for r in df.collect()}


def test_terms_keep_the_total(items):
    got = [r for r in agg.terms(items, ["collection_frequency", "platform_frequency"]).collect()]
    for name in ("collection_frequency", "platform_frequency"):
        mine = [r for r in got if r["name"] == name]
        assert len(mine) == 100
        assert sum(r["frequency"] for r in mine) + mine[0]["overflow"] == 600
    top = [r for r in got if r["key"] == "hot"]
    assert top[0]["frequency"] == 400


def test_term_counts_are_combined_before_the_shuffle(items):
    plan = agg.terms(items, ["platform_frequency"])._jdf.queryExecution().executedPlan().toString()
    exchange = plan.rindex("Exchange hashpartitioning(name")
    assert plan.index("HashAggregate(keys=[name", exchange) > exchange


def test_histograms_have_no_gaps(items):
    thin = items.filter(F.col("`eo:cloud_cover`").isin(1.0, 44.0))
    got = rows(agg.histogram(thin, F.col("`eo:cloud_cover`"), "h", 5))
    assert {float(k[1]) for k in got} == {5.0 * n for n in range(9)}
    assert sum(r["frequency"] for r in got.values()) == thin.count()
    empty = agg.histogram(items.filter("false"), F.col("`eo:cloud_cover`"), "h", 5)
    assert empty.count() == 0


@pytest.mark.parametrize("interval, steps", [("month", 3), ("day", 61), ("hour", 60 * 24 + 24), ("year", 1), ("quarter", 1), ("week", 9)])
def test_calendar_histograms(items, interval, steps):
    got = agg.datetime_histogram(items, interval).collect()
    assert sum(r["frequency"] for r in got) == 600
    if interval != "week":
        assert abs(len(got) - steps) <= 1
    assert len({r["key"] for r in got}) == len(got)


def test_ranges_show_empty_ones(items):
    got = rows(agg.ranges(items.filter("`eo:cloud_cover` < 10"), F.col("`eo:cloud_cover`"), "c"))
    assert got["c", "40.0-*"]["frequency"] == 0 and got["c", "*-5.0"]["frequency"] == 60


def test_a_request(items):
    request = agg.AggregationRequest(["total_count", "datetime_max", "cloud_cover_frequency", "datetime_frequency"])
    got = agg.aggregate(items, request).collect()
    assert [r["value"] for r in got if r["name"] == "total_count"] == ["600"]
    assert [r["value"] for r in got if r["name"] == "datetime_max"] == ["2020-03-01T23:00:00Z"]


@pytest.mark.parametrize("bad", [
    {"aggregations": []},
    {"aggregations": ["total_count"], "datetime_interval": "decade"},
    {"aggregations": ["total_count"], "precision": {"centroid_geohash_grid_frequency": 13}},
    {"aggregations": ["total_count"], "precision": {"geometry_geotile_grid_frequency": -1}},
])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        agg.AggregationRequest(**bad).checked()


def test_only_offered_aggregations(spark):
    collections = spark.range(2).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") == 0, F.array(F.struct(F.lit("platform_frequency").alias("name")))).alias("aggregations"))
    agg.check_available(["total_count"], collections, [])
    agg.check_available(["platform_frequency", "total_count"], collections, ["c0"])
    for wanted in ([], ["c0", "c1"]):
        with pytest.raises(ValueError, match="platform_frequency"):
            agg.check_available(["platform_frequency"], collections, wanted)


def test_long_axes_are_answered(spark):
    far = spark.createDataFrame([(0.0,), (1e6,)], "v double")
    shown = agg.histogram(far, F.col("v"), "h", 5)
    found = shown.agg(F.count(F.lit(1)).alias("steps"), F.sum("frequency").alias("items"), F.max("frequency").alias("most")).first()
    assert tuple(found) == (200_001, 2, 1)


def test_a_request_answers_as_its_parts_do(spark, items):
    wanted = ["total_count", "datetime_min", "collection_frequency", "platform_frequency", "cloud_cover_frequency", "datetime_frequency"]
    together = {tuple(r) for r in agg.aggregate(items, agg.AggregationRequest(wanted)).collect()}
    alone = {tuple(r) for name in wanted for r in agg.aggregate(items, agg.AggregationRequest([name])).collect()}
    assert together == alone
