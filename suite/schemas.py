"""Reading raw documents, typing them, and schema discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoledger.operators import discovery
from geoledger.plans import search as plan
from geoledger.plans.search import SearchRequest
from geoledger.sources import geojson, sample, typed
from suite.registry import case
from suite.scratch import fresh_dir


def documents(spark, sf_dir):
    """Item documents as text, as they would be posted."""
    items = sample.items(spark, sf_dir)
    number = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")

    def stamp(name):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(name)

    cloud = F.col("cloud_cover").cast("string")
    properties = F.struct(
        stamp("datetime"), stamp("start_datetime"), stamp("end_datetime"), "platform", "title",
        # a number, or for some items the number as text
        F.when(number % 4 != 0, F.col("cloud_cover")).alias("eo:cloud_cover"),
        F.when(number % 4 == 0, cloud).alias("cloud_text"),
        F.col("sun_elevation").alias("view:sun_elevation"),
        F.when(number % 10 == 0, number).alias("odd"),
        F.struct("lat", "lon").alias("proj:centroid"),
        F.lit(32756).alias("proj:epsg"),
    )
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    text = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), "id", "collection",
        point.alias("geometry"), properties.alias("properties")))
    return items.select("collection", "id", F.regexp_replace(text, '"cloud_text"', '"eo:cloud_cover"').alias("document"))


@case("src_feature_collection", "SELECT id, 'stamped' AS collection, platform FROM items_v")
def feature_collection(spark, sf_dir):
    # files of one FeatureCollection per line, a hundred features each
    folder = fresh_dir(spark, "features")
    docs = documents(spark, sf_dir).withColumn("part", F.floor(F.regexp_extract("id", "[0-9]+", 0).cast("bigint") / 100))
    grouped = docs.groupBy("part").agg(F.concat_ws(",", F.collect_list("document")).alias("features"))
    grouped.select(F.concat(
        F.lit('{"type":"FeatureCollection","features":['), "features", F.lit("]}")).alias("value")).write.text(folder)
    read = geojson.read_features(spark, folder, "stamped", lines=True)
    return read.select("id", "collection", F.get_json_object("document", "$.properties.platform").alias("platform"))


@case("src_collection", "SELECT 'c' || s_suppkey AS id, 'Collection' AS type, s_name AS title, 'n' || s_nationkey AS parent FROM supplier", views=None)
def read_collection(spark, sf_dir):
    folder = fresh_dir(spark, "collections")
    suppliers = sample.table(spark, sf_dir, "supplier")
    suppliers.select(F.to_json(F.struct(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("Collection").alias("type"),
        F.col("s_name").alias("title"),
        F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("parent_ids"))).alias("value")
    ).write.text(folder)
    rows = geojson.parse_collections(geojson.read_collections(spark, folder, lines=True))
    return rows.select("id", "type", "title", F.explode("parent_ids").alias("parent"))


@case(
    "col_query_summaries",
    "SELECT 'c' || s_suppkey AS id, s_acctbal AS best FROM supplier WHERE s_acctbal <= 5000 AND s_nationkey IN (3, 7, 11, 15, 19, 23)", views=None)
def query_summaries(spark, sf_dir):
    # members that are not fixed: a nested number, and a list
    suppliers = sample.table(spark, sf_dir, "supplier")
    summaries = F.struct(
        F.struct(F.col("s_acctbal").alias("minimum"), F.lit(9).alias("maximum")).alias("gsd"),
        F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("all")).alias("platform"))
    raw = suppliers.select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"), F.to_json(F.struct(
        F.lit("Collection").alias("type"), F.col("s_name").alias("title"), summaries.alias("summaries"))).alias("document"))
    rows = geojson.parse_collections(raw)
    wanted = SearchRequest(
        query={"summaries.gsd.minimum": {"lte": 5000}}, limit=10_000,
        filter={"op": "in", "args": [{"property": "summaries.platform"}, ["n3", "n7", "n11", "n15", "n19", "n23"]]})
    return plan.search_collections(rows, wanted).rows.select("id", F.col("summaries.gsd.minimum").alias("best"))


SQL_TYPED = (
    "SELECT id, collection, datetime, start_datetime, CAST(cloud_cover AS DOUBLE) AS cloud_cover, platform, sun_elevation, title, "
    "32756 AS epsg, lat, lon AS minx, CASE WHEN event_id % 10 = 0 THEN CAST(event_id AS DOUBLE) END AS odd FROM items_v"
)


@case("typed_projection", SQL_TYPED)
def typed_projection(spark, sf_dir):
    docs = documents(spark, sf_dir)
    mapping = typed.mapping_for(typed.observed_fields(docs))
    rows, _ = typed.split_rejected(typed.typed(docs, mapping))
    return rows.select(
        "id", "collection", "datetime", "start_datetime", F.col("properties.`eo:cloud_cover`").alias("cloud_cover"),
        "properties.platform", F.col("properties.`view:sun_elevation`").alias("sun_elevation"), "properties.title",
        F.col("properties.`proj:epsg`").alias("epsg"), F.col("properties.`proj:centroid`.lat").alias("lat"),
        "minx", "properties.odd",
    )


@case(
    "typed_mixed",
    "SELECT id, CAST(cloud_cover AS DOUBLE) AS n, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS words, title AS first FROM items_v",
)
def typed_mixed(spark, sf_dir):
    # a number or its text, and one word or a list of words
    number = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    whole = F.to_json(F.struct(F.col("cloud_cover").alias("n"), F.when(number % 3 != 0, F.col("title")).alias("kw")))
    several = F.to_json(F.struct(F.col("cloud_cover").cast("string").alias("n"), F.array("title", "id").alias("kw")))
    docs = sample.items(spark, sf_dir).select("collection", "id", F.concat(
        F.lit('{"properties":'), F.when(number % 3 == 0, several).otherwise(whole), F.lit("}")).alias("document"))
    rows, _ = typed.split_rejected(typed.typed(docs, typed.mapping_for(typed.observed_fields(docs))))
    return rows.select("id", "properties.n", F.size("properties.kw").alias("words"), F.get("properties.kw", 0).alias("first"))


KNOWN = {
    **typed.BASE_FIELDS, "properties.eo:cloud_cover": {"type": "double"}, "properties.view:sun_elevation": {"type": "double"},
    "properties.platform": {"type": "keyword"}, "properties.title": {"type": "text"}, "properties.proj:epsg": {"type": "integer"},
    "properties.proj:centroid": {"type": "geo_point"},
}


@case("schema_mode", "SELECT id, CASE WHEN event_id % 10 = 0 THEN 'mapping set to strict, unknown field [odd]' END AS error FROM items_v")
def schema_mode(spark, sf_dir):
    rows = typed.typed(documents(spark, sf_dir), typed.mapping_for({}, KNOWN, mode="strict"), mode="strict")
    return rows.select("id", "error")


@case("schema_mode_unindexed", "SELECT id, CASE WHEN event_id % 10 = 0 THEN event_id END AS odd FROM items_v")
def schema_unindexed(spark, sf_dir):
    rows = typed.typed(documents(spark, sf_dir), typed.mapping_for({}, KNOWN, mode="false"), mode="false")
    odd = F.try_element_at("extra", F.lit("odd")).cast("bigint")
    return rows.select("id", odd.alias("odd"))


@case(
    "schema_coerce",
    "SELECT id, CAST(cloud_cover AS DOUBLE) AS coerced, CASE WHEN event_id % 4 = 0 THEN 'field [properties.eo:cloud_cover] of type [double] takes no text' END AS error FROM items_v",
)
def schema_coerce(spark, sf_dir):
    docs, mapping = documents(spark, sf_dir), typed.mapping_for({}, KNOWN, mode="false")
    coerced = typed.typed(docs, mapping, "false", coerce=True)
    strict = typed.typed(docs, mapping, "false", coerce=False)
    # the coerced value beside the reason for which the uncoerced run rejects the same row
    return coerced.select("id", F.col("properties.`eo:cloud_cover`").alias("coerced")).join(
        strict.select("id", "error"), "id")


# ---------------------------------------------------------------- discovery

FIELDS = [
    ("id", "Id", "string", None), ("collection", "Collection", "string", None), ("datetime", "Datetime", "string", "date-time"),
    ("start_datetime", "Start Datetime", "string", "date-time"), ("cloud_cover", "Cloud Cover", "integer", None),
    ("platform", "Platform", "string", None), ("sun_elevation", "Sun Elevation", "number", None),
    ("hidden", "Hidden", "boolean", None),
]


def described(spark, sf_dir):
    """Items of which one collection has no platform and one no flag."""
    items = sample.items(spark, sf_dir).select(*[f[0] for f in FIELDS])
    return items.withColumns({
        "platform": F.when(F.col("collection") != "c3", F.col("platform")),
        "hidden": F.when(F.col("collection") != "c7", F.col("hidden")),
    })


def _text(value):
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


_FIELD_ROWS = ", ".join(f"('{n}', '{t}', '{k}', {_text(f)})" for n, t, k, f in FIELDS)
SQL_QUERYABLES = (
    f"SELECT c.collection, f.name, f.title, f.type, f.format FROM (SELECT DISTINCT collection FROM items_v) c, (VALUES {_FIELD_ROWS}) AS f(name, title, type, format) "
    "WHERE NOT (c.collection = 'c3' AND f.name = 'platform') AND NOT (c.collection = 'c7' AND f.name = 'hidden')"
)


@case("sd_queryables", SQL_QUERYABLES)
def queryables(spark, sf_dir):
    return discovery.queryables(described(spark, sf_dir))


@case("sd_exclude", SQL_QUERYABLES + " AND f.name NOT IN ('hidden', 'cloud_cover')")
def excluded(spark, sf_dir):
    return discovery.queryables(described(spark, sf_dir), ["hidden", "properties.cloud_cover"])


SQL_UNION = f"SELECT name, title, type, format FROM (VALUES {_FIELD_ROWS}) AS f(name, title, type, format)"


@case("sd_union", SQL_UNION, views=None)
def union(spark, sf_dir):
    return discovery.union_queryables(discovery.queryables(described(spark, sf_dir)))


@case(
    "set_queryables_union",
    "SELECT name, min(type) AS type FROM (SELECT 'platform' AS name, 'string' AS type FROM events UNION ALL SELECT 'status', 'string' FROM orders "
    "UNION ALL SELECT 'price', 'number' FROM orders) GROUP BY name",
    views=None,
)
def union_of_tables(spark, sf_dir):
    events = sample.table(spark, sf_dir, "events").select(
        F.lit("a").alias("collection"), F.col("event_type").alias("platform"))
    orders = sample.table(spark, sf_dir, "orders").select(
        F.lit("b").alias("collection"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    both = events.unionByName(orders, allowMissingColumns=True)
    return discovery.union_queryables(discovery.queryables(both).filter(F.col("name") != "collection")).select("name", "type")


@case(
    "sd_enum",
    "SELECT DISTINCT collection, 'platform' AS name, platform AS value FROM items_v WHERE platform IS NOT NULL AND collection <> 'c3'",
)
def enum(spark, sf_dir):
    per_collection = discovery.queryables(described(spark, sf_dir))
    listed = discovery.with_enum(per_collection, discovery.enum_values(described(spark, sf_dir)))
    return listed.select("collection", "name", F.explode("enum").alias("value"))


_BASE = (
    "('id', 'ID'), ('collection', 'Collection'), ('geometry', 'Geometry'), ('datetime', 'Acquisition Timestamp'), "
    "('created', 'Creation Timestamp'), ('updated', 'Creation Timestamp')"
)


@case(
    "sd_defaults_file",
    "SELECT 'p' || n_nationkey AS name, n_name AS description, n_regionkey AS region FROM nation",
)
def defaults_file(spark, sf_dir):
    # a file of queryables with a field for each nation
    entry = F.to_json(F.struct(F.col("n_name").alias("description"), F.col("n_regionkey").alias("region")))
    members = sample.table(spark, sf_dir, "nation").select(F.concat(F.lit('"p'), F.col("n_nationkey").cast("string"), F.lit('": '), entry).alias("m"))
    path = fresh_dir(spark, "queryables")
    members.agg(F.concat(F.lit('{"properties": {'), F.concat_ws(", ", F.collect_list("m")), F.lit("}}")).alias("value")).write.text(path)
    fields = discovery.root_queryables(spark, path)
    return fields.select("name", "description", F.get_json_object("definition", "$.region").cast("int").alias("region"))


@case(
    "sd_defaults",
    f"SELECT c.collection, b.name, b.description FROM (SELECT DISTINCT collection FROM items_v) c, (VALUES {_BASE}) AS b(name, description)",
)
def defaults(spark, sf_dir):
    # the base fields beside every collection that has items
    collections = sample.items(spark, sf_dir).select("collection").distinct()
    return collections.select("collection", F.explode(discovery.base_entries()).alias("b")).select("collection", "b.*")
