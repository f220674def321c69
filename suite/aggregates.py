"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoledger.operators import aggregate as agg
from geoledger.plans import search as plan
from geoledger.plans.search import SearchOptions, SearchRequest
from geoledger.session import materialised
from geoledger.sources import sample
from suite.registry import COLLECTIONS, ITEMS, case, in_time

FREQ = "'frequency_distribution' AS data_type"
RFC = "CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ') END"


def out(name: str, key: str = "NULL", frequency: str = "NULL", low: str = "NULL", high: str = "NULL",
        value: str = "NULL", overflow: str = "0", data_type: str = "frequency_distribution") -> str:
    """The output columns in SQL."""
    return (
        f"'{name}' AS name, '{data_type}' AS data_type, CAST({key} AS VARCHAR) AS key, CAST({frequency} AS BIGINT) AS frequency, "
        f"CAST({low} AS DOUBLE) AS range_from, CAST({high} AS DOUBLE) AS range_to, CAST({value} AS VARCHAR) AS value, "
        f"CAST({overflow} AS BIGINT) AS overflow"
    )


def items(spark, sf_dir):
    """Items under the property names the aggregations read."""
    return sample.items(spark, sf_dir).withColumnsRenamed(
        {"cloud_cover": "eo:cloud_cover", "sun_elevation": "view:sun_elevation"})


SQL_TOTAL = f"SELECT {out('total_count', value='count(id)', overflow='NULL', data_type='integer')} FROM items_v"
SQL_MIN = f"SELECT {out('datetime_min', value=RFC.format('min(datetime)'), overflow='NULL', data_type='datetime')} FROM items_v"
SQL_MAX = f"SELECT {out('datetime_max', value=RFC.format('max(datetime)'), overflow='NULL', data_type='datetime')} FROM items_v"


@case("agg_total_count", SQL_TOTAL)
def total_count(spark, sf_dir):
    return agg.metrics(items(spark, sf_dir), ["total_count"])


@case("agg_datetime_min", SQL_MIN)
def datetime_min(spark, sf_dir):
    return agg.metrics(items(spark, sf_dir), ["datetime_min"])


@case("agg_datetime_max", SQL_MAX)
def datetime_max(spark, sf_dir):
    return agg.metrics(items(spark, sf_dir), ["datetime_max"])


def sql_terms(name: str, key: str, size: int) -> str:
    return (
        f"SELECT {out(name, 'k', 'n', overflow='total - sum(n) OVER ()')} FROM (SELECT k, n, sum(n) OVER () AS total, "
        f"row_number() OVER (ORDER BY n DESC, k) AS place FROM (SELECT {key} AS k, count(*) AS n FROM items_v "
        f"WHERE {key} IS NOT NULL GROUP BY 1)) WHERE place <= {size}"
    )


SQL_COLLECTIONS = sql_terms("collection_frequency", "collection", 100)


@case("agg_collection_frequency", SQL_COLLECTIONS)
def collection_frequency(spark, sf_dir):
    return agg.terms(items(spark, sf_dir), ["collection_frequency"])


@case("agg_platform_frequency", sql_terms("platform_frequency", "platform", 100))
def platform_frequency(spark, sf_dir):
    return agg.terms(items(spark, sf_dir), ["platform_frequency"])


@case("agg_grid_code_frequency", sql_terms("grid_code_frequency", "coalesce(CASE WHEN event_id % 4 <> 0 THEN 'g-' || (user_id % 50) END, 'none')", 10000))
def grid_code_frequency(spark, sf_dir):
    number = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    user = F.regexp_extract("title", "[0-9]+$", 0).cast("bigint")
    coded = items(spark, sf_dir).withColumn(
        "grid:code", F.when(number % 4 != 0, F.concat(F.lit("g-"), (user % 50).cast("string"))))
    return agg.terms(coded, ["grid_code_frequency"])


@case(
    "w_top_terms",
    " UNION ALL ".join(f"SELECT * FROM ({sql_terms(n, k, s)})" for n, k, s in (
        ("title", "title", 40), ("collection", "collection", 3))),
)
def top_terms(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("key")) for n in ("title", "collection")])
    counts = (
        items(spark, sf_dir).select(F.explode(pairs).alias("t")).select("t.*")
        .groupBy("name", "key").agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = agg.top_terms(counts, {"title": 40, "collection": 3})
    return ranked.select(
        "name", F.lit("frequency_distribution").alias("data_type"), "key", F.col("n").alias("frequency"),
        F.lit(None).cast("double").alias("range_from"), F.lit(None).cast("double").alias("range_to"),
        F.lit(None).cast("string").alias("value"), "overflow")


SQL_CLOUD = (
    f"SELECT {out('cloud_cover_frequency', 'k', 'count(cloud_cover)', 'lo', 'hi')} FROM (VALUES ('*-5.0', NULL, 5.0), "
    "('5.0-15.0', 5.0, 15.0), ('15.0-40.0', 15.0, 40.0), ('40.0-*', 40.0, NULL)) AS r(k, lo, hi) LEFT JOIN items_v "
    "ON (lo IS NULL OR cloud_cover >= lo) AND (hi IS NULL OR cloud_cover < hi) GROUP BY k, lo, hi"
)


@case("agg_cloud_cover_frequency", SQL_CLOUD)
def cloud_cover_frequency(spark, sf_dir):
    return agg.ranges(items(spark, sf_dir), F.col("`eo:cloud_cover`"), "cloud_cover_frequency")


def sql_histogram(name: str, column: str) -> str:
    return (
        f"SELECT {out(name, 'CAST(s * 5 AS DOUBLE)', 'count(' + column + ')')} FROM (SELECT unnest(generate_series("
        f"(SELECT CAST(min(floor({column} / 5.0)) AS BIGINT) FROM items_v), (SELECT CAST(max(floor({column} / 5.0)) AS BIGINT) FROM items_v))) AS s) "
        f"LEFT JOIN items_v ON CAST(floor({column} / 5.0) AS BIGINT) = s GROUP BY s"
    )


SQL_SUN = sql_histogram("sun_elevation_frequency", "sun_elevation")


@case("agg_sun_elevation_frequency", SQL_SUN)
def sun_elevation(spark, sf_dir):
    return agg.histogram(items(spark, sf_dir), F.col("`view:sun_elevation`"), "sun_elevation_frequency", 5)


@case("agg_sun_azimuth_frequency", sql_histogram("sun_azimuth_frequency", "lon"))
def sun_azimuth(spark, sf_dir):
    return agg.histogram(items(spark, sf_dir), F.col("lon"), "sun_azimuth_frequency", 5)


@case("agg_off_nadir_frequency", sql_histogram("off_nadir_frequency", "cloud_cover"))
def off_nadir(spark, sf_dir):
    return agg.histogram(items(spark, sf_dir), F.col("`eo:cloud_cover`"), "off_nadir_frequency", 5)


def sql_dates(unit: str) -> str:
    step = {"quarter": "3 MONTH", "week": "7 DAY"}.get(unit, f"1 {unit}")
    first, last = (f"(SELECT CAST(date_trunc('{unit}', {f}(datetime)) AS TIMESTAMP) FROM items_v)" for f in ("min", "max"))
    return (
        f"SELECT {out('datetime_frequency', RFC.format('s'), 'count(datetime)')} FROM (SELECT unnest(generate_series("
        f"{first}, {last}, INTERVAL {step})) AS s) LEFT JOIN items_v ON CAST(date_trunc('{unit}', datetime) AS TIMESTAMP) = s GROUP BY s"
    )


SQL_MONTHS = sql_dates("month")


def date_case(unit: str, name: str):
    @case(name, sql_dates(unit))
    def query(spark, sf_dir):
        return agg.datetime_histogram(items(spark, sf_dir), unit)


date_case("month", "agg_datetime_frequency")
for _unit in ("year", "quarter", "week", "day", "hour", "minute"):
    date_case(_unit, f"agg_datetime_frequency_{_unit}")


@case(
    "agg_datetime_frequency_second",
    f"WITH {ITEMS}, s AS ({sql_dates('second')}) SELECT key, frequency, 0 AS steps FROM s WHERE frequency > 0 "
    "UNION ALL SELECT substr(key, 1, 10), sum(frequency)::BIGINT, count(*) FROM s GROUP BY 1",
    views=None,
)
def datetime_second(spark, sf_dir):
    # every step that has rows, and per day the number of all steps
    found = agg.datetime_histogram(items(spark, sf_dir), "second")
    per_day = found.groupBy(F.substring("key", 1, 10).alias("key")).agg(F.sum("frequency").alias("frequency"), F.count(F.lit(1)).alias("steps"))
    return found.filter("frequency > 0").select("key", "frequency", F.lit(0).cast("bigint").alias("steps")).unionByName(per_day)


# ---------------------------------------------------------------- grids

TILE = (
    "CAST(least(greatest(floor(({lon} + 180) / 360.0 * (1 << {z})), 0), (1 << {z}) - 1) AS BIGINT)",
    "CAST(least(greatest(floor((0.5 - ln((1 + sin(radians(greatest(least({lat}, 85.0511287798066), -85.0511287798066)))) / "
    "(1 - sin(radians(greatest(least({lat}, 85.0511287798066), -85.0511287798066))))) / (4 * pi())) * (1 << {z})), 0), (1 << {z}) - 1) AS BIGINT)",
)
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def sql_hash_cell(lon: str, lat: str, p: int) -> tuple[str, str]:
    xb, yb = 5 * p - 5 * p // 2, 5 * p // 2
    return (
        f"CAST(least(greatest(floor(({lon} + 180) / 360.0 * {1 << xb}), 0), {(1 << xb) - 1}) AS BIGINT)",
        f"CAST(least(greatest(floor(({lat} + 90) / 180.0 * {1 << yb}), 0), {(1 << yb) - 1}) AS BIGINT)",
    )


def sql_hash_name(x: str, y: str, p: int) -> str:
    xb, yb = 5 * p - 5 * p // 2, 5 * p // 2
    chars = []
    for c in range(p):
        bits = []
        for place in range(5):
            b = 5 * c + place
            src, shift = (x, xb - 1 - b // 2) if b % 2 == 0 else (y, yb - 1 - b // 2)
            bits.append(f"((({src} >> {shift}) & 1) << {4 - place})")
        chars.append(f"substr('{ALPHABET}', CAST({' + '.join(bits)} AS INTEGER) + 1, 1)")
    return " || ".join(chars)


def sql_grid(name: str, cells: str) -> str:
    return (
        f"SELECT {out(name, 'k', 'n')} FROM (SELECT k, n, row_number() OVER (ORDER BY n DESC, k DESC) AS place FROM "
        f"(SELECT k, count(*) AS n FROM ({cells}) GROUP BY k)) WHERE place <= 10000"
    )


_gx, _gy = sql_hash_cell("lon", "lat", 5)
SQL_CENTROID_HASH = sql_grid(
    "centroid_geohash_grid_frequency",
    f"SELECT {sql_hash_name('x', 'y', 5)} AS k FROM (SELECT {_gx} AS x, {_gy} AS y FROM items_v)",
)


@case("agg_centroid_geohash_grid", SQL_CENTROID_HASH)
def centroid_geohash(spark, sf_dir):
    return agg.centroid_grid(items(spark, sf_dir), "geohash", 5)


@case(
    "agg_centroid_geotile_grid",
    sql_grid("centroid_geotile_grid_frequency",
             f"SELECT '6/' || {TILE[0].format(lon='lon', z=6)} || '/' || {TILE[1].format(lat='lat', z=6)} AS k FROM items_v"),
)
def centroid_geotile(spark, sf_dir):
    return agg.centroid_grid(items(spark, sf_dir), "geotile", 6)


_x0, _y0 = sql_hash_cell("minx", "miny", 4)
_x1, _y1 = sql_hash_cell("maxx", "maxy", 4)


def sql_cells(x0: str, y0: str, x1: str, y1: str) -> str:
    return (
        f"SELECT x, unnest(generate_series(y0, y1)) AS y FROM (SELECT unnest(generate_series({x0}, {x1})) AS x, {y0} AS y0, {y1} AS y1 FROM items_v)"
    )


@case(
    "agg_geometry_geohash_grid",
    sql_grid("geometry_geohash_grid_frequency", f"SELECT {sql_hash_name('x', 'y', 4)} AS k FROM ({sql_cells(_x0, _y0, _x1, _y1)})"),
)
def geometry_geohash(spark, sf_dir):
    return agg.geometry_grid(items(spark, sf_dir), "geohash", 4)


@case(
    "agg_geometry_geohash_grid_shapes",
    sql_grid("geometry_geohash_grid_frequency", f"SELECT {sql_hash_name('x', 'y', 4)} AS k FROM ({sql_cells(_x0, _y0, _x1, _y1)})"),
)
def geometry_geohash_shapes(spark, sf_dir):
    # the same boxes as rings with a sixth point, so that the spans of every shape are computed
    rows = sample.items(spark, sf_dir, geometry=True)
    longer = F.transform("geometry.parts", lambda p: F.struct(p["dim"].alias("dim"), F.transform(
        p["rings"], lambda r: F.when(F.size(r) == 5, F.concat(r, F.slice(r, 5, 1))).otherwise(r)).alias("rings")))
    rows = rows.withColumn("geometry", F.struct(F.lit("Polygon").alias("type"), longer.alias("parts")))
    return agg.geometry_grid(materialised(rows), "geohash", 4)


@case(
    "agg_geometry_geohash_grid_boxes",
    sql_grid("geometry_geohash_grid_frequency", f"SELECT {sql_hash_name('x', 'y', 4)} AS k FROM ({sql_cells(_x0, _y0, _x1, _y1)})"),
)
def geometry_geohash_boxes(spark, sf_dir):
    # geometries that fill their bounds need no exact test
    return agg.geometry_grid(materialised(sample.items(spark, sf_dir, geometry=True)), "geohash", 4)


_TILES = sql_cells(
    TILE[0].format(lon="minx", z=8), TILE[1].format(lat="maxy", z=8), TILE[0].format(lon="maxx", z=8), TILE[1].format(lat="miny", z=8))


@case("agg_geometry_geotile_grid", sql_grid("geometry_geotile_grid_frequency", f"SELECT '8/' || x || '/' || y AS k FROM ({_TILES})"))
def geometry_geotile(spark, sf_dir):
    return agg.geometry_grid(items(spark, sf_dir), "geotile", 8)


# finer grids, whose cells are found from coarse ones down

_x0, _y0 = sql_hash_cell("minx", "miny", 5)
_x1, _y1 = sql_hash_cell("maxx", "maxy", 5)


@case(
    "agg_geometry_geohash_grid_5",
    sql_grid("geometry_geohash_grid_frequency", f"SELECT {sql_hash_name('x', 'y', 5)} AS k FROM ({sql_cells(_x0, _y0, _x1, _y1)})"),
)
def geometry_geohash_5(spark, sf_dir):
    return agg.geometry_grid(items(spark, sf_dir), "geohash", 5)


_TILES = sql_cells(
    TILE[0].format(lon="minx", z=11), TILE[1].format(lat="maxy", z=11), TILE[0].format(lon="maxx", z=11), TILE[1].format(lat="miny", z=11))


@case("agg_geometry_geotile_grid_11", sql_grid("geometry_geotile_grid_frequency", f"SELECT '11/' || x || '/' || y AS k FROM ({_TILES})"))
def geometry_geotile_11(spark, sf_dir):
    return agg.geometry_grid(items(spark, sf_dir), "geotile", 11)


# a box of one degree holds millions of these cells; tested against brute force on a small fixture
@case("agg_geometry_geohash_grid_9")
def geometry_geohash_9(spark, sf_dir):
    return agg.geometry_grid(items(spark, sf_dir), "geohash", 9)


@case("agg_geometry_geotile_grid_22")
def geometry_geotile_22(spark, sf_dir):
    return agg.geometry_grid(items(spark, sf_dir), "geotile", 22)


# ---------------------------------------------------------------- whole requests

_BUNDLE_WHERE = in_time("2024-01-03 00:00:00", "2024-01-28 00:00:00") + " AND cloud_cover <= 60"
_BUNDLE_ITEMS = ITEMS.replace("items_v AS (", "all_v AS (", 1) + f", items_v AS (SELECT * FROM all_v WHERE {_BUNDLE_WHERE})"


@case(
    "agg_bundle", " UNION ALL ".join([SQL_TOTAL, SQL_MIN, SQL_MAX, f"SELECT * FROM ({SQL_COLLECTIONS})", SQL_CLOUD, SQL_SUN, SQL_MONTHS]),
    views=_BUNDLE_ITEMS,
)
def bundle(spark, sf_dir):
    request = SearchRequest(
        datetime="2024-01-03T00:00:00Z/2024-01-28T00:00:00Z",
        filter={"op": "<=", "args": [{"property": "eo:cloud_cover"}, 60]},
    )
    filtered = plan.filter_items(items(spark, sf_dir), request, SearchOptions(hide_path="hidden"), aggregating=True)
    return agg.aggregate(filtered, agg.AggregationRequest([
        "total_count", "datetime_min", "datetime_max", "collection_frequency", "cloud_cover_frequency",
        "sun_elevation_frequency", "datetime_frequency",
    ]))


_DEFAULTS = (
    "('total_count'), ('datetime_max'), ('datetime_min'), ('datetime_frequency'), ('collection_frequency'), "
    "('geometry_geohash_grid_frequency'), ('geometry_geotile_grid_frequency')"
)


@case(
    "agg_available",
    f"SELECT id AS collection, name FROM collections_v, (VALUES {_DEFAULTS}) AS d(name) WHERE type <> 'Catalog' AND id NOT IN ('c2', 'c5') "
    "UNION ALL SELECT id, name FROM collections_v, (VALUES ('total_count'), ('platform_frequency')) AS d(name) WHERE id IN ('c2', 'c5')",
    views=COLLECTIONS,
)
def available(spark, sf_dir):
    rows = sample.collections(spark, sf_dir).filter(F.col("type") != "Catalog")
    own = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("total_count", "platform_frequency")])
    return agg.available(rows.withColumn("aggregations", F.when(F.col("id").isin("c2", "c5"), own)))


_VALUES = " UNION ".join(f"SELECT '{c}' AS field, {c} AS value FROM items_v WHERE {c} IS NOT NULL" for c in ("platform", "title", "collection"))


@case(
    "agg_unique_values",
    f"SELECT field, value FROM ({_VALUES}) QUALIFY count(*) OVER (PARTITION BY field) <= 100",
)
def unique_values(spark, sf_dir):
    # a field with more than 100 values is left out
    return agg.unique_values(items(spark, sf_dir), ["platform", "title", "collection"])
