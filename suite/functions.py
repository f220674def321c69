"""Scalar functions and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoledger.functions import geometry, grids, ids, times
from geoledger.operators import projection, validation
from geoledger.operators.fields import Fields
from geoledger.sources import sample
from suite.aggregates import RFC, TILE, sql_hash_cell, sql_hash_name
from suite.registry import case


def items(spark, sf_dir, geom=False):
    return sample.items(spark, sf_dir, geom)


@case("fn_doc_id", "SELECT id || '|' || collection AS key, id, collection FROM items_v")
def doc_id(spark, sf_dir):
    keyed = items(spark, sf_dir).select(ids.doc_id(F.col("id"), F.col("collection")).alias("key"))
    return keyed.select("key", ids.split_doc_id(F.col("key")).alias("k")).select("key", "k.*")


ISO = "strftime(raw_ts, '%Y-%m-%dT%H:%M:%S.%f')"


def iso_text():
    """Event times as text: plain, with an offset, or broken."""
    text = F.date_format("raw_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    number = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    return F.when(number % 3 == 0, F.concat(text, F.lit("Z"))).when(
        number % 3 == 1, F.concat(text, F.lit("+02:00"))).otherwise(F.lit("not a time"))


@case(
    "fn_interval",
    "SELECT id, CASE event_id % 3 WHEN 0 THEN raw_ts WHEN 1 THEN raw_ts - INTERVAL 2 HOUR END AS utc FROM items_v",
)
def interval(spark, sf_dir):
    return items(spark, sf_dir).select("id", times.parse_utc(iso_text()).alias("utc"))


@case("fn_extract_date", "SELECT id, CASE WHEN event_id % 3 < 2 THEN CAST(raw_ts AS DATE) END AS day FROM items_v")
def extract_date(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("text", F.nullif(iso_text(), F.lit("not a time")))
    return rows.select("id", times.extract_date(F.col("text")).alias("day"))


@case("fn_rfc3339", f"SELECT id, {RFC.format('datetime')} AS text FROM items_v")
def rfc3339(spark, sf_dir):
    return items(spark, sf_dir).select("id", times.rfc3339(F.col("datetime")).alias("text"))


@case(
    "fn_queue_score",
    "SELECT id, CASE event_id % 3 WHEN 0 THEN epoch_us(raw_ts) / 1000000.0::DOUBLE WHEN 1 THEN epoch_us(raw_ts - INTERVAL 2 HOUR) / 1000000.0::DOUBLE "
    "ELSE 0.0::DOUBLE END AS score FROM items_v",
)
def queue_score(spark, sf_dir):
    return items(spark, sf_dir).select("id", times.queue_score(iso_text()).alias("score"))


@case(
    "fn_bbox_polygon",
    "SELECT id, CAST(p AS INTEGER) AS position, CASE WHEN p IN (1, 2) THEN maxx ELSE minx END AS x, CASE WHEN p IN (2, 3) THEN maxy ELSE miny END AS y "
    "FROM items_v, range(0, 5) AS t(p)",
)
def bbox_polygon(spark, sf_dir):
    ring = geometry.bbox_polygon(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    return items(spark, sf_dir).select("id", F.posexplode(ring).alias("position", "p")).select("id", "position", "p.*")


@case("fn_remove_path", "SELECT id, lat FROM items_v")
def remove_path(spark, sf_dir):
    nested = items(spark, sf_dir).select("id", F.struct(F.struct("lon", "lat").alias("b")).alias("a"))
    return projection.drop_paths(nested, ["a.b.lon", "a.x.y", "z"]).select("id", "a.b.*")


@case("g_geohash", "SELECT id, " + sql_hash_name("x", "y", 7) + " AS cell FROM (SELECT id, {} AS x, {} AS y FROM items_v)".format(
    *sql_hash_cell("lon", "lat", 7)))
def geohash(spark, sf_dir):
    return items(spark, sf_dir).select("id", grids.geohash(F.col("lon"), F.col("lat"), 7).alias("cell"))


@case("g_geotile", f"SELECT id, '12/' || {TILE[0].format(lon='lon', z=12)} || '/' || {TILE[1].format(lat='lat', z=12)} AS cell FROM items_v")
def geotile(spark, sf_dir):
    return items(spark, sf_dir).select("id", grids.geotile(F.col("lon"), F.col("lat"), 12).alias("cell"))


# ---------------------------------------------------------------- validation


def broken_items(spark, sf_dir):
    """Items some of which break a time rule."""
    number = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    early = F.col("start_datetime") - F.expr("INTERVAL 5 DAY")
    return items(spark, sf_dir).withColumns({
        # end before start, a lone start, a datetime before its start
        "end_datetime": F.when(number % 12 == 0, early).when(number % 15 == 0, F.lit(None)).otherwise(F.col("end_datetime")),
        "start_datetime": F.when(number % 33 == 0, F.col("start_datetime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("start_datetime")),
    })


def shown(column: str) -> str:
    return RFC.format(column)


SQL_BROKEN = (
    "(SELECT * REPLACE (CASE WHEN event_id % 12 = 0 THEN start_datetime - INTERVAL 5 DAY WHEN event_id % 15 = 0 THEN NULL ELSE end_datetime END AS end_datetime, "
    "CASE WHEN event_id % 33 = 0 THEN start_datetime + INTERVAL 1 DAY ELSE start_datetime END AS start_datetime) FROM items_v)"
)
SQL_TIME_ERROR = (
    "CASE WHEN datetime IS NULL AND (start_datetime IS NULL OR end_datetime IS NULL) THEN "
    "'If ''datetime'' is null, both ''start_datetime'' and ''end_datetime'' must be set' "
    "WHEN (start_datetime IS NULL) <> (end_datetime IS NULL) THEN "
    "'Both ''start_datetime'' and ''end_datetime'' must be set together, or both must be null' "
    f"WHEN start_datetime > end_datetime THEN '''start_datetime'' (' || {shown('start_datetime')} || ') must be <= ''end_datetime'' (' || {shown('end_datetime')} || ')' "
    f"WHEN start_datetime > datetime THEN '''datetime'' (' || {shown('datetime')} || ') must be >= ''start_datetime'' (' || {shown('start_datetime')} || ')' "
    f"WHEN datetime > end_datetime THEN '''datetime'' (' || {shown('datetime')} || ') must be <= ''end_datetime'' (' || {shown('end_datetime')} || ')' END"
)
SQL_ERRORS = f"(SELECT id, collection, 'Datetime Range Error: ' || {SQL_TIME_ERROR} AS error FROM {SQL_BROKEN})"


@case("v_datetime_range", f"SELECT id, error FROM {SQL_ERRORS}")
def datetime_range(spark, sf_dir):
    rows = broken_items(spark, sf_dir)
    return rows.select("id", validation.datetime_error(Fields.of(rows)).alias("error"))


@case("agg_error_groups", f"SELECT error, count(*) AS items FROM {SQL_ERRORS} WHERE error IS NOT NULL GROUP BY error")
def error_groups(spark, sf_dir):
    rows = broken_items(spark, sf_dir)
    _, invalid = validation.split_valid(rows, validation.datetime_error(Fields.of(rows)))
    return validation.error_groups(invalid)


@case("agg_error_ids", f"SELECT error, count(*) OVER (PARTITION BY error) AS items, collection, id FROM {SQL_ERRORS} WHERE error IS NOT NULL")
def error_ids(spark, sf_dir):
    rows = broken_items(spark, sf_dir)
    _, invalid = validation.split_valid(rows, validation.datetime_error(Fields.of(rows)))
    return validation.errors_with_ids(invalid)


def shifted_geometry(spark, sf_dir):
    """Items moved east by 1.5 degrees, so that some leave the globe."""
    rows = items(spark, sf_dir)
    half = (F.col("maxx") - F.col("minx")) / 2
    return rows.select("id", "collection", geometry.box_geometry(
        F.col("lon") + 1.5 - half, F.col("miny"), F.col("lon") + 1.5 + half, F.col("maxy")).alias("geometry"))


@case(
    "v_bounds",
    "SELECT id, lon + 1.5::DOUBLE + (maxx - minx) / 2::DOUBLE > 180 AS broken FROM items_v",
)
def bounds(spark, sf_dir):
    rows = shifted_geometry(spark, sf_dir)
    return rows.select("id", validation.bounds_error(geometry.points_of(F.col("geometry"))).isNotNull().alias("broken"))


@case(
    "v_ring",
    "SELECT id, CASE event_id % 4 WHEN 0 THEN 'Polygon ring must have at least 4 coordinates (closed loop).' "
    "WHEN 1 THEN 'Geometry has too many vertices (10). Maximum allowed is 8.' "
    "WHEN 2 THEN CASE WHEN abs(lon) > 90 THEN 'Geometry crosses the antimeridian without proper truncation/splitting between longitude ' || "
    "CAST(lon AS VARCHAR) || ' and ' || CAST(-lon AS VARCHAR) || '.' END END AS error FROM items_v",
)
def ring(spark, sf_dir):
    number = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")

    def point(x):
        return F.struct(x.alias("x"), F.col("lat").alias("y"))

    west, east = point(F.col("lon")), point(-F.col("lon"))
    same = F.array_repeat(west, 10)
    made = F.when(number % 4 == 0, F.slice(same, 1, 3)).when(number % 4 == 1, same).when(
        number % 4 == 2, F.array(west, east, east, west)).otherwise(F.slice(same, 1, 5))
    return items(spark, sf_dir).select("id", validation.ring_error(made, 8).alias("error"))


@case(
    "v_topology_batch",
    "SELECT id, lon + 1.5::DOUBLE + (maxx - minx) / 2::DOUBLE <= 180 AS valid FROM items_v",
)
def topology_batch(spark, sf_dir):
    rows = shifted_geometry(spark, sf_dir)
    valid, invalid = validation.split_valid(rows, validation.topology_error(F.col("geometry")))
    return valid.select("id", F.lit(True).alias("valid")).unionAll(invalid.select("id", F.lit(False).alias("valid")))


def raw_documents(spark, sf_dir):
    """Documents some of which lack a member or hold the wrong kind."""
    e = F.col("event_id")
    members = [
        F.when(e % 10 != 1, F.lit("Feature")).alias("type"),
        F.lit("1.0.0").alias("stac_version"),
        F.concat(F.lit("e"), e.cast("string")).alias("id"),
        F.when(e % 10 != 2, F.lit(None).cast("string")).otherwise(F.lit("nowhere")).alias("geometry"),
        F.struct(F.when(e % 10 != 3, F.col("event_type")).alias("datetime")).alias("properties"),
        F.when(e % 10 != 4, F.array().cast("array<string>")).alias("links"),
        F.create_map().cast("map<string,string>").alias("assets"),
    ]
    text = F.to_json(F.struct(*members), {"ignoreNullFields": "true"})
    with_geometry = F.when(e % 10 != 2, F.regexp_replace(text, r'"id":', '"geometry":null,"id":')).otherwise(text)
    return sample.table(spark, sf_dir, "events").select("event_id", F.parse_json(with_geometry).alias("document"))


@case(
    "v_schema",
    "SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'STAC validation failed: type is required' "
    "WHEN 2 THEN 'STAC validation failed: geometry must be object or null' "
    "WHEN 3 THEN 'STAC validation failed: properties.datetime is required' "
    "WHEN 4 THEN 'STAC validation failed: links is required' END AS error FROM events",
    views=None,
)
def schema(spark, sf_dir):
    rows = raw_documents(spark, sf_dir)
    return rows.select("event_id", validation.schema_error(F.col("document")).alias("error"))


@case(
    "v_order",
    f"SELECT id, coalesce('Datetime Range Error: ' || {SQL_TIME_ERROR}, CASE WHEN maxy > 80 THEN "
    "'Topology Error: Coordinates out of global WGS84 bounds' END) AS error "
    f"FROM {SQL_BROKEN}",
)
def order(spark, sf_dir):
    rows = broken_items(spark, sf_dir)
    # everything north of 80 degrees is pushed off the globe
    rows = rows.withColumn("maxy", F.when(F.col("maxy") > 80, F.col("maxy") + 20).otherwise(F.col("maxy")))
    return rows.select("id", validation.item_error(rows).alias("error"))


@case("v_threshold", f"SELECT count(*) AS errors, count(*) > 100 AS refused FROM {SQL_ERRORS} WHERE error IS NOT NULL")
def threshold(spark, sf_dir):
    rows = broken_items(spark, sf_dir)
    _, invalid = validation.split_valid(rows, validation.datetime_error(Fields.of(rows)))
    errors = invalid.count()
    try:
        validation.check_threshold(errors, max_errors=100)
        refused = False
    except validation.BatchRejected:
        refused = True
    return invalid.agg(F.count(F.lit(1)).alias("errors"), F.lit(refused).alias("refused"))
