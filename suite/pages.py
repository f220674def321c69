"""Sorting, paging and field selection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from geoledger.operators import projection
from geoledger.operators.fields import Fields
from geoledger.operators.paging import Page, encode_token, sort_keys
from geoledger.plans import search as plan
from geoledger.plans.newest import EarlyPage, search_dated, stored_days
from geoledger.plans.search import SearchOptions, SearchRequest
from geoledger.sources import sample, store
from suite.filters import SQL_ORDER
from suite.registry import ANY_TIME, COLLECTIONS, case, in_time
from suite.scratch import fresh_dir


def sorted_page(spark, sf_dir, sortby, limit, token_values=None):
    items = sample.items(spark, sf_dir)
    return Page(items, sort_keys(Fields.of(items, sample.ITEM_ALIASES), sortby), limit, token_values).rows


@case("s_default", f"SELECT id, collection, datetime FROM items_v {SQL_ORDER} LIMIT 500")
def s_default(spark, sf_dir):
    return sorted_page(spark, sf_dir, None, 500).select("id", "collection", "datetime")


@case(
    "s_by_fields",
    "SELECT id, platform, cloud_cover FROM items_v ORDER BY platform DESC NULLS LAST, cloud_cover ASC NULLS LAST, id LIMIT 700",
)
def s_by_fields(spark, sf_dir):
    return sorted_page(spark, sf_dir, ["-platform", "+eo:cloud_cover"], 700).select("id", "platform", "cloud_cover")


@case(
    "s_by_missing_time",
    "SELECT id, datetime FROM items_v ORDER BY coalesce(datetime, TIMESTAMP '2100-01-01'), id LIMIT 9000",
)
def s_by_time(spark, sf_dir):
    return sorted_page(spark, sf_dir, ["datetime"], 9000).select("id", "datetime")


@case("s_collections", "SELECT id, title FROM collections_v WHERE type <> 'Catalog' ORDER BY title DESC, id LIMIT 4", views=COLLECTIONS)
def s_collections(spark, sf_dir):
    page = plan.search_collections(sample.collections(spark, sf_dir), SearchRequest(sortby=["-title"], limit=4))
    return page.rows.select("id", "title")


@case("l_limit", f"SELECT id, collection FROM items_v WHERE {ANY_TIME} {SQL_ORDER} LIMIT 10")
def l_limit(spark, sf_dir):
    return plan.search(sample.items(spark, sf_dir), SearchRequest()).rows.select("id", "collection")


@case(
    "l_keyset_page",
    f"SELECT id, collection, datetime FROM items_v WHERE {ANY_TIME} {SQL_ORDER} LIMIT 200 OFFSET 400",
)
def l_keyset_page(spark, sf_dir):
    items, token = sample.items(spark, sf_dir), None
    for _ in range(2):
        token = plan.search(items, SearchRequest(limit=200, token=token)).next_token()
    rows = plan.search(items, SearchRequest(limit=200, token=token)).rows
    return rows.select("id", "collection", "datetime")


@case(
    "l_keyset_page_after_value",
    "SELECT id, platform FROM items_v WHERE platform < 'purchase' OR (platform = 'purchase' AND id > 'e5') OR platform IS NULL "
    "ORDER BY platform DESC NULLS LAST, id LIMIT 300",
)
def l_keyset_value(spark, sf_dir):
    return sorted_page(spark, sf_dir, ["-platform"], 300, ["purchase", "e5"]).select("id", "platform")


@case("l_collection_page", "SELECT id, title FROM collections_v WHERE type <> 'Catalog' ORDER BY id LIMIT 3 OFFSET 3", views=COLLECTIONS)
def l_collection_page(spark, sf_dir):
    collections = sample.collections(spark, sf_dir)
    token = plan.search_collections(collections, SearchRequest(limit=3)).next_token()
    return plan.search_collections(collections, SearchRequest(limit=3, token=token)).rows.select("id", "title")


# ---------------------------------------------------------------- pages over a dated store, which read few days

_stores: dict[tuple[str, str], str] = {}


def dated_store(spark, sf_dir):
    """All items in a store by day, in a collection for each length of their collection's name; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        items = sample.items(spark, sf_dir)
        path = fresh_dir(spark, "dated")
        store.write_items(items.withColumn("collection", F.concat(F.lit("g"), F.length("collection").cast("string"))), path, by_date=True)
        _stores[key] = path
    return store.read_items(spark, _stores[key])


SQL_GROUPED = "SELECT * REPLACE ('g' || length(collection) AS collection) FROM items_v"


@case("s_default_dated", f"SELECT id, collection, datetime FROM ({SQL_GROUPED}) {SQL_ORDER} LIMIT 500")
def s_default_dated(spark, sf_dir):
    items = dated_store(spark, sf_dir)
    page = EarlyPage(items, sort_keys(Fields.of(items), None), 500, days=stored_days(items))
    return page.rows.select("id", "collection", "datetime")


@case("s_by_time_dated", f"SELECT id, datetime FROM items_v WHERE {ANY_TIME} ORDER BY coalesce(datetime, TIMESTAMP '2100-01-01'), id LIMIT 700")
def s_by_time_dated(spark, sf_dir):
    return search_dated(dated_store(spark, sf_dir), SearchRequest(sortby=["datetime"], limit=700)).rows.select("id", "datetime")


@case(
    "l_keyset_page_dated",
    f"SELECT id, collection, datetime FROM ({SQL_GROUPED}) WHERE {ANY_TIME} {SQL_ORDER} LIMIT 200 OFFSET 400",
)
def l_keyset_page_dated(spark, sf_dir):
    items, token = dated_store(spark, sf_dir), None
    for _ in range(2):
        token = search_dated(items, SearchRequest(limit=200, token=token)).next_token()
    return search_dated(items, SearchRequest(limit=200, token=token)).rows.select("id", "collection", "datetime")


@case(
    "l_deep_page_dated",
    f"SELECT id, datetime FROM items_v WHERE {ANY_TIME} AND (datetime IS NULL OR datetime < TIMESTAMP '2024-01-09 12:00:00') {SQL_ORDER} LIMIT 300",
)
def l_deep_page_dated(spark, sf_dir):
    token = encode_token(["2024-01-09T12:00:00Z", "1970-01-01T00:00:00Z", "", ""])
    return search_dated(dated_store(spark, sf_dir), SearchRequest(limit=300, token=token)).rows.select("id", "datetime")


@case(
    "l_page_without_datetime",
    f"SELECT id, start_datetime FROM items_v WHERE {ANY_TIME} AND datetime IS NULL AND start_datetime < TIMESTAMP '2024-01-20 06:00:00' "
    f"{SQL_ORDER} LIMIT 100",
)
def l_page_without_datetime(spark, sf_dir):
    token = encode_token(["1970-01-01T00:00:00Z", "2024-01-20T06:00:00Z", "", ""])
    return search_dated(dated_store(spark, sf_dir), SearchRequest(limit=100, token=token)).rows.select("id", "start_datetime")


@case(
    "f_search_dated",
    f"SELECT id, datetime, cloud_cover FROM ({SQL_GROUPED}) WHERE collection IN ('g2', 'g3') AND cloud_cover <= 40 "
    f"AND maxx >= -90 AND minx <= 60 AND maxy >= -60 AND miny <= 40 "
    f"AND {in_time('2024-01-05 00:00:00', '2024-01-25 00:00:00')} {SQL_ORDER} LIMIT 60",
)
def f_search_dated(spark, sf_dir):
    return search_dated(dated_store(spark, sf_dir), SearchRequest(
        collections=["g2", "g3"], datetime="2024-01-05T00:00:00Z/2024-01-25T00:00:00Z", bbox=[-90, -60, 60, 40],
        filter={"op": "<=", "args": [{"property": "cloud_cover"}, 40]}, limit=60)).rows.select("id", "datetime", "cloud_cover")


@case("agg_number_matched", f"SELECT count(*) AS matched FROM items_v WHERE {ANY_TIME} AND NOT coalesce(hidden, false)")
def number_matched(spark, sf_dir):
    filtered = plan.filter_items(sample.items(spark, sf_dir), SearchRequest(), SearchOptions(hide_path="hidden"))
    return filtered.agg(F.count(F.lit(1)).alias("matched"))


# ---------------------------------------------------------------- fields


def nested_items(spark, sf_dir):
    """Items with a properties struct and a map of assets."""
    items = sample.items(spark, sf_dir)

    def asset(kind, mime):
        return F.struct(F.concat(F.lit("s3://bucket/"), "id", F.lit(f"/{kind}")).alias("href"), F.lit(mime).alias("type"))

    return items.select(
        "id", "collection", "datetime",
        F.struct(
            F.col("cloud_cover").alias("eo:cloud_cover"), "platform", F.col("sun_elevation").alias("view:sun_elevation"),
            F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat")).alias("proj:centroid"),
        ).alias("properties"),
        F.create_map(
            F.lit("B1"), asset("b1", "image/tiff"), F.lit("B2"), asset("b2", "image/tiff"),
            F.lit("meta"), asset("meta", "text/xml"),
        ).alias("assets"),
    )


@case("p_include", 'SELECT id, cloud_cover AS "eo:cloud_cover", lon FROM items_v')
def p_include(spark, sf_dir):
    kept = projection.select_fields(
        nested_items(spark, sf_dir), ["id", "properties.eo:cloud_cover", "properties.proj:centroid.lon", "no.such"])
    return kept.select("id", "properties.`eo:cloud_cover`", "properties.`proj:centroid`.*")


@case("p_exclude", "SELECT id, collection, datetime, platform, lon, lat FROM items_v")
def p_exclude(spark, sf_dir):
    kept = projection.select_fields(
        nested_items(spark, sf_dir), exclude=["assets", "properties.eo:cloud_cover", "properties.view:sun_elevation"])
    return kept.select("id", "collection", "datetime", "properties.platform", "properties.`proj:centroid`.*")


@case(
    "p_wildcard",
    "SELECT id, k AS key, 's3://bucket/' || id || '/' || lower(k) AS href FROM items_v, (VALUES ('B1'), ('B2')) AS t(k)",
)
def p_wildcard(spark, sf_dir):
    kept = projection.select_fields(nested_items(spark, sf_dir), ["id", "assets.B*.href"])
    rows = kept.select("id", F.explode("assets").alias("key", "asset"))
    return rows.select("id", "key", "asset.*")


@case("p_empty", "SELECT id, collection FROM items_v")
def p_nothing(spark, sf_dir):
    return projection.select_fields(nested_items(spark, sf_dir), ["no.such.field"])


@case("p_drop_config", 'SELECT id, cloud_cover AS "eo:cloud_cover", lat FROM items_v')
def p_drop_config(spark, sf_dir):
    cut = projection.drop_paths(
        nested_items(spark, sf_dir),
        ["assets", "properties.platform", "properties.view:sun_elevation", "properties.proj:centroid.lon", "a.b"])
    return cut.select("id", "properties.`eo:cloud_cover`", "properties.`proj:centroid`.*")


NOW = "2024-03-01T12:00:00Z"


@case(
    "p_item_prepare",
    "SELECT id, CASE WHEN event_id % 2 = 0 THEN raw_ts ELSE TIMESTAMP '2024-03-01 12:00:00' END AS created, "
    "TIMESTAMP '2024-03-01 12:00:00' AS updated FROM items_v",
)
def p_item_prepare(spark, sf_dir):
    items = sample.items(spark, sf_dir)
    # an even number ends in an even digit
    items = items.withColumn("created", F.when(F.col("id").rlike("[02468]$"), F.col("raw_ts")))
    return projection.prepare_items(items, datetime(2024, 3, 1, 12)).select("id", "created", "updated")


@case(
    "p_collection_defaults",
    "SELECT id, type, title, '' AS description, '' AS license, '' AS stac_version, 0 AS n_keywords FROM collections_v",
    views=COLLECTIONS,
)
def p_collection_defaults(spark, sf_dir):
    full = projection.with_defaults(sample.collections(spark, sf_dir))
    return full.select("id", "type", "title", "description", "license", "stac_version", F.size("keywords").alias("n_keywords"))


@case(
    "p_bbox_shape",
    "SELECT id, p AS position, CASE WHEN p IN (1, 2) THEN maxx ELSE minx END AS x, CASE WHEN p IN (2, 3) THEN maxy ELSE miny END AS y "
    "FROM collections_v, range(0, 5) AS t(p) WHERE minx IS NOT NULL",
    views=COLLECTIONS,
)
def p_bbox_shape(spark, sf_dir):
    rows = sample.collections(spark, sf_dir).filter(F.col("minx").isNotNull())
    # every second box with heights
    flat = F.array("minx", "miny", "maxx", "maxy")
    high = F.array("minx", "miny", F.lit(0.0), "maxx", "maxy", F.lit(9.0))
    rows = rows.withColumn("extent", F.struct(F.struct(
        F.array(F.when(F.col("id").rlike("[02468]$"), high).otherwise(flat)).alias("bbox")).alias("spatial")))
    shaped = projection.with_bbox_shape(rows)
    points = shaped.select("id", F.posexplode("bbox_shape").alias("position", "p"))
    return points.select("id", F.col("position").cast("bigint").alias("position"), "p.x", "p.y")


SQL_ASSETS = (
    "SELECT id, k AS es_key, 's3://bucket/' || id || '/' || lower(k) AS href FROM items_v, "
    "(VALUES ('B1'), ('B2'), ('meta')) AS t(k)"
)


@case("p_assets_array", SQL_ASSETS)
def p_assets_array(spark, sf_dir):
    rows = projection.assets_to_array(nested_items(spark, sf_dir)).select("id", F.explode("assets").alias("a"))
    return rows.select("id", "a.es_key", "a.href")


@case("p_assets_map", SQL_ASSETS.replace("k AS es_key", "CASE WHEN k = 'meta' THEN 'asset_2' ELSE k END AS es_key"))
def p_assets_map(spark, sf_dir):
    listed = projection.assets_to_array(nested_items(spark, sf_dir))
    # the third entry loses its key and is named by its place
    nameless = F.transform("assets", lambda a: a.withField("es_key", F.nullif(a["es_key"], F.lit("meta"))))
    back = projection.assets_to_map(listed.withColumn("assets", nameless))
    rows = back.select("id", F.explode("assets").alias("es_key", "a"))
    return rows.select("id", "es_key", "a.href")


