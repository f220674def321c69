"""Item and collection conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.operators import filters, spatial, text
from geoledger.operators.cql2 import cql2
from geoledger.operators.fields import Fields
from geoledger.plans import search as plan
from geoledger.plans.search import SearchOptions, SearchRequest
from geoledger.sources import sample
from suite.registry import ANY_TIME, COLLECTIONS, case, in_time

KEY = "id, collection"


def keys(df: DataFrame) -> DataFrame:
    return df.select("id", "collection")


def item_case(name: str, condition, where: str, geometry: bool = False):
    """Keys of the items that satisfy a condition built from the fields."""

    @case(name, f"SELECT {KEY} FROM items_v WHERE {where}")
    def query(spark, sf_dir):
        items = sample.items(spark, sf_dir, geometry)
        return keys(items.filter(condition(Fields.of(items, sample.ITEM_ALIASES))))


def cql_case(name: str, expr: dict, where: str, geometry: bool = False):
    item_case(name, lambda f: cql2(f, expr), where, geometry)


def op(name: str, *args):
    return {"op": name, "args": list(args)}


def prop(name: str):
    return {"property": name}


# ---------------------------------------------------------------- scans, ids, collections

WANTED_IDS = [f"e{n}" for n in (3, 17, 40, 41, 999, 123456789)]


@case("src_items_scan", "SELECT id, collection, datetime FROM items_v WHERE collection IN ('c1', 'c4')")
def items_scan(spark, sf_dir):
    items = sample.items(spark, sf_dir)
    return filters.keep_listed(items, "collection", ["c1", "c4"]).select("id", "collection", "datetime")


item_case("f_ids", lambda f: filters.by_ids(f, WANTED_IDS), f"id IN ({', '.join(repr(i) for i in WANTED_IDS)})")
item_case("f_collections", lambda f: filters.by_collections(f, ["c2", "c7"]), "collection IN ('c2', 'c7')")


@case("get_item", "SELECT id, collection, title FROM items_v WHERE collection = 'c6' AND id = 'e1' AND NOT coalesce(hidden, false)")
def get_item(spark, sf_dir):
    found = plan.get_item(sample.items(spark, sf_dir), "c6", "e1", hide_path="hidden")
    return found.select("id", "collection", "title")


# ---------------------------------------------------------------- time

A, B = "2024-01-08T06:00:00Z", "2024-01-12T18:30:00Z"
SQL_A, SQL_B = "2024-01-08 06:00:00", "2024-01-12 18:30:00"

item_case("f_datetime_use_datetime", lambda f: filters.by_datetime(f, f"{A}/{B}"), in_time(SQL_A, SQL_B))
item_case(
    "f_datetime_range_only", lambda f: filters.by_datetime(f, f"{A}/{B}", use_datetime=False),
    f"start_datetime <= TIMESTAMP '{SQL_B}' AND end_datetime >= TIMESTAMP '{SQL_A}'",
)
item_case(
    "f_datetime_open", lambda f: filters.by_datetime(f, f"{B}/.."), in_time(SQL_B, "2262-04-11 23:47:16.854775"),
)
item_case("f_datetime_missing", lambda f: filters.by_datetime(f, None), ANY_TIME)

# ---------------------------------------------------------------- space

BOX = [-60.03, -40.02, 75.07, 35.04]
SQL_BOX = f"minx <= {BOX[2]} AND maxx >= {BOX[0]} AND miny <= {BOX[3]} AND maxy >= {BOX[1]}"
item_case("f_bbox", lambda f: spatial.by_bbox(f, BOX), SQL_BOX)
item_case("f_bbox_antimeridian", lambda f: spatial.by_bbox(f, [170.03, -40.02, -165.04, 35.04]),
          "(maxx >= 170.03 OR minx <= -165.04) AND miny <= 35.04 AND maxy >= -40.02")
item_case("f_bbox_3d", lambda f: spatial.by_bbox(f, spatial.bbox_2d([*BOX[:2], 0, *BOX[2:], 900])), SQL_BOX)

# An L: the box without its upper right notch. In SQL, its two rectangles.
NOTCH = (10.03, -5.02)
ELL = {
    "type": "Polygon",
    "coordinates": [[
        [BOX[0], BOX[1]], [BOX[2], BOX[1]], [BOX[2], NOTCH[1]], [NOTCH[0], NOTCH[1]], [NOTCH[0], BOX[3]],
        [BOX[0], BOX[3]], [BOX[0], BOX[1]],
    ]],
}
SQL_MEETS_ELL = (
    f"((minx <= {BOX[2]} AND maxx >= {BOX[0]} AND miny <= {NOTCH[1]} AND maxy >= {BOX[1]}) OR "
    f"(minx <= {NOTCH[0]} AND maxx >= {BOX[0]} AND miny <= {BOX[3]} AND maxy >= {BOX[1]}))"
)
SQL_IN_ELL = (
    f"minx >= {BOX[0]} AND maxx <= {BOX[2]} AND miny >= {BOX[1]} AND maxy <= {BOX[3]} "
    f"AND NOT (maxx > {NOTCH[0]} AND maxy > {NOTCH[1]})"
)
# A triangle small enough to lie inside some items.
TRIANGLE = {"type": "Polygon", "coordinates": [[[20.02, 10.02], [20.61, 10.13], [20.24, 10.57], [20.02, 10.02]]]}
SQL_HAS_TRIANGLE = "minx <= 20.02 AND maxx >= 20.61 AND miny <= 10.02 AND maxy >= 10.57"
# Points and a line for the other geometry types.
POINTS = {"type": "MultiPoint", "coordinates": [[20.31, 10.22], [-33.41, 0.41], [56.52, -46.47]]}
SQL_MEETS_POINTS = " OR ".join(
    f"({x} BETWEEN minx AND maxx AND {y} BETWEEN miny AND maxy)" for x, y in POINTS["coordinates"])
LINE = {"type": "LineString", "coordinates": [[-120.03, 12.33], [140.07, 12.33]]}
SQL_MEETS_LINE = "minx <= 140.07 AND maxx >= -120.03 AND 12.33 BETWEEN miny AND maxy"

item_case("f_intersects", lambda f: spatial.by_intersects(f, ELL), SQL_MEETS_ELL, geometry=True)
item_case("f_intersects_line", lambda f: spatial.by_intersects(f, LINE), SQL_MEETS_LINE, geometry=True)
item_case("g_intersects", lambda f: spatial.spatial(f, "intersects", POINTS), SQL_MEETS_POINTS, geometry=True)
item_case("g_contains", lambda f: spatial.spatial(f, "contains", TRIANGLE), SQL_HAS_TRIANGLE, geometry=True)
item_case("g_within", lambda f: spatial.spatial(f, "within", ELL), SQL_IN_ELL)


def fine(ring: list[list[float]], pieces: int) -> list[list[float]]:
    """The same ring with every side cut into pieces; sides run along the axes, so nothing moves."""
    return [
        [a[0] + (b[0] - a[0]) * k / pieces, a[1] + (b[1] - a[1]) * k / pieces] for a, b in zip(ring, ring[1:]) for k in range(pieces)
    ] + [ring[-1]]


# The same L with 4,998 vertices, as many as validation lets pass.
FINE_ELL = {"type": "Polygon", "coordinates": [fine(ELL["coordinates"][0], 833)]}
item_case("f_intersects_fine", lambda f: spatial.by_intersects(f, FINE_ELL), SQL_MEETS_ELL, geometry=True)
item_case("g_within_fine", lambda f: spatial.spatial(f, "within", FINE_ELL), SQL_IN_ELL)
item_case("g_disjoint", lambda f: spatial.spatial(f, "disjoint", ELL), f"NOT {SQL_MEETS_ELL}")

# ---------------------------------------------------------------- property queries

QUERY_CASES = {
    "q_eq": ({"cloud_cover": {"eq": 40}}, "cloud_cover = 40"),
    "q_ne": ({"platform": {"neq": "click"}}, "NOT coalesce(platform = 'click', false)"),
    "q_lt": ({"sun_elevation": {"lt": 2.5}}, "sun_elevation < 2.5"),
    "q_lte": ({"cloud_cover": {"lte": 3}}, "cloud_cover <= 3"),
    "q_gt": ({"sun_elevation": {"gt": 120}}, "sun_elevation > 120"),
    "q_gte": ({"cloud_cover": {"gte": 97}, "platform": {"ne": "view"}},
              "cloud_cover >= 97 AND NOT coalesce(platform = 'view', false)"),
    "q_in": ({"platform": {"in": ["error", "view"]}}, "platform IN ('error', 'view')"),
}
for _name, (_query, _where) in QUERY_CASES.items():
    item_case(_name, lambda f, q=_query: filters.by_query(f, q), _where)


@case("q_contains", f"SELECT {KEY} FROM items_v WHERE list_contains(string_split(title, ' '), '12')")
def q_contains(spark, sf_dir):
    items = sample.items(spark, sf_dir).withColumn("keywords", F.split("title", " "))
    return keys(items.filter(filters.by_query(Fields.of(items), {"keywords": {"contains": "12"}})))


# ---------------------------------------------------------------- text

SQL_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+(?:[''.][\p{{L}}\p{{N}}_]+)*')"
TERMS = ["ention", "sich"]

item_case(
    "f_free_text", lambda f: text.by_free_text(f, "signup, c4", fuzzy=False),
    # keyword fields are compared with the whole query, which no id or collection equals
    f"list_has_any({SQL_WORDS.format('title')}, ['signup', 'c4'])",
)
item_case(
    "f_free_text_fuzzy", lambda f: text.by_free_text(f, ["purchsae"]),
    f"len(list_filter({SQL_WORDS.format('title')}, lambda w: damerau_levenshtein(w, 'purchsae') <= 2)) > 0",
)


@case("f_free_text_documents", f"SELECT doc_id FROM documents WHERE list_has_any({SQL_WORDS.format('text')}, ['ention', 'sich'])", views=None)
def free_text_documents(spark, sf_dir):
    documents = sample.table(spark, sf_dir, "documents").withColumnRenamed("text", "description")
    wanted = text.by_free_text(Fields.of(documents), TERMS, ["description"], fuzzy=False)
    return documents.filter(wanted).select("doc_id")


@case(
    "f_free_text_fields",
    f"SELECT p_partkey FROM part WHERE len(list_filter({SQL_WORDS.format('p_name')}, lambda w: damerau_levenshtein(w, 'wigdet') <= 2)) > 0",
    views=None,
)
def free_text_fields(spark, sf_dir):
    parts = sample.table(spark, sf_dir, "part").withColumnRenamed("p_name", "title")
    return parts.filter(text.by_free_text(Fields.of(parts), "wigdet", ["title^3"])).select("p_partkey")


item_case("f_hidden", lambda f: filters.visible(f, "hidden"), "NOT coalesce(hidden, false)")

# ---------------------------------------------------------------- the whole search

FLAGSHIP = SearchRequest(
    collections=["c1", "c2", "c3"], datetime="2024-01-05T00:00:00Z/2024-01-25T00:00:00Z", bbox=[-90, -60, 90, 60],
    filter=op("and", op("<=", prop("eo:cloud_cover"), 20)), limit=10,
)
SQL_FLAGSHIP_WHERE = (
    f"collection IN ('c1', 'c2', 'c3') AND {in_time('2024-01-05 00:00:00', '2024-01-25 00:00:00')} "
    "AND minx <= 90 AND maxx >= -90 AND miny <= 60 AND maxy >= -60 AND cloud_cover <= 20"
)
SQL_ORDER = (
    "ORDER BY coalesce(datetime, TIMESTAMP '1970-01-01') DESC, coalesce(start_datetime, TIMESTAMP '1970-01-01') DESC, "
    "id DESC, collection DESC"
)
OPTIONS = SearchOptions(aliases=sample.ITEM_ALIASES, hide_path="hidden")


@case(
    "f_search",
    f"SELECT id, collection, datetime, cloud_cover, platform FROM items_v WHERE {SQL_FLAGSHIP_WHERE} "
    f"AND NOT coalesce(hidden, false) {SQL_ORDER} LIMIT 10",
)
def flagship(spark, sf_dir):
    page = plan.search(sample.items(spark, sf_dir), FLAGSHIP, OPTIONS)
    return page.rows.select("id", "collection", "datetime", "cloud_cover", "platform")


@case(
    "f_search_all",
    f"SELECT id, collection FROM items_v WHERE {in_time(SQL_A, SQL_B)} AND {SQL_BOX} "
    f"AND list_has_any({SQL_WORDS.format('title')}, ['error', 'view']) AND sun_elevation >= 3.5 AND cloud_cover <> 7 "
    "AND (platform LIKE 'v%' OR platform IS NULL)",
)
def search_everything(spark, sf_dir):
    request = SearchRequest(
        datetime=f"{A}/{B}", bbox=BOX, q="error,view", query={"sun_elevation": {"gte": 3.5}},
        filter=op("and", op("<>", prop("cloud_cover"), 7),
                  op("or", op("like", prop("platform"), "V%"), op("isNull", prop("platform")))),
    )
    options = SearchOptions(aliases=sample.ITEM_ALIASES, fuzzy=False)
    return keys(plan.filter_items(sample.items(spark, sf_dir), request, options))


# ---------------------------------------------------------------- CQL2

cql_case(
    "cql_and", op("and", op("<=", prop("eo:cloud_cover"), 30), op("=", prop("platform"), "view"), op(">", prop("sun_elevation"), 10)),
    "cloud_cover <= 30 AND platform = 'view' AND sun_elevation > 10",
)
cql_case("cql_or", op("or", op("<", prop("cloud_cover"), 5), op("=", prop("platform"), "signup")),
         "coalesce(cloud_cover < 5, false) OR coalesce(platform = 'signup', false)")
cql_case("cql_not", op("not", op("and", op("=", prop("platform"), "view"), op("<", prop("cloud_cover"), 50))),
         "NOT (coalesce(platform = 'view', false) AND coalesce(cloud_cover < 50, false))")
cql_case("cql_eq", op("=", prop("properties.platform"), "error"), "platform = 'error'")
cql_case("cql_neq", op("<>", prop("platform"), "error"), "NOT coalesce(platform = 'error', false)")
cql_case("cql_lt", op("<", prop("eo:cloud_cover"), 10), "cloud_cover < 10")
cql_case("cql_lte", op("<=", prop("eo:cloud_cover"), 10), "cloud_cover <= 10")
cql_case("cql_gt", op(">", prop("view:sun_elevation"), 77.7), "sun_elevation > 77.7")
cql_case("cql_gte", op(">=", prop("view:sun_elevation"), 77.7), "sun_elevation >= 77.7")
cql_case("cql_timestamp", op(">=", prop("datetime"), {"timestamp": "2024-01-20T12:00:00Z"}), "datetime >= TIMESTAMP '2024-01-20 12:00:00'")
cql_case("cql_isnull", op("isNull", prop("datetime")), "datetime IS NULL")
cql_case("cql_between", op("between", prop("cloud_cover"), [20, 25]), "cloud_cover BETWEEN 20 AND 25")
cql_case("cql_in", op("in", prop("collection"), ["c3", "c5"]), "collection IN ('c3', 'c5')")
cql_case("cql_like", op("like", prop("title"), "%R U_er 1%"), "title ILIKE '%r u_er 1%'")
cql_case("cql_s_intersects", op("s_intersects", prop("geometry"), {"op": "polygon", "args": [ELL["coordinates"][0]]}), SQL_MEETS_ELL)
cql_case("cql_s_contains", op("s_contains", prop("geometry"), {"op": "point", "args": [20.31, 10.22]}),
         "20.31 BETWEEN minx AND maxx AND 10.22 BETWEEN miny AND maxy", geometry=True)
cql_case("cql_s_within", op("s_within", prop("geometry"), ELL), SQL_IN_ELL, geometry=True)
cql_case("cql_s_disjoint", op("s_disjoint", prop("geometry"), LINE), f"NOT ({SQL_MEETS_LINE})", geometry=True)
cql_case("set_excluded", op("not", op("in", prop("collection"), ["c0", "c9"])), "NOT collection IN ('c0', 'c9')")

# ---------------------------------------------------------------- collections


def collection_case(name: str, request: SearchRequest, where: str, **options):
    @case(name, f"SELECT id, title FROM collections_v WHERE type <> 'Catalog' AND {where}", views=COLLECTIONS)
    def query(spark, sf_dir):
        found = plan.filter_collections(sample.collections(spark, sf_dir), request, **options)
        return found.select("id", "title")


collection_case("col_free_text", SearchRequest(q="c4"), "(damerau_levenshtein(id, 'c4') = 0 OR list_contains(regexp_extract_all(lower(title), '[a-z0-9_]+'), 'c4'))", fuzzy=True)
collection_case("col_bbox", SearchRequest(bbox=[-179.9, 84.7, -100.0, 90.0]), "minx <= -100.0 AND maxx >= -179.9 AND miny <= 90.0 AND maxy >= 84.7")
collection_case("col_datetime", SearchRequest(datetime="2024-01-30T20:00:00Z/.."),
                "(t_min <= TIMESTAMP '2999-12-31 23:59:59' OR t_max <= TIMESTAMP '2999-12-31 23:59:59') "
                "AND (t_min >= TIMESTAMP '2024-01-30 20:00:00' OR t_max >= TIMESTAMP '2024-01-30 20:00:00')")
collection_case("col_cql2", SearchRequest(filter=op("like", prop("title"), "supplier#%3")), "title ILIKE 'supplier#%3'")
collection_case("col_query", SearchRequest(query={"id": {"in": ["c1", "c3", "n3"]}}), "id IN ('c1', 'c3', 'n3')")
collection_case("col_exclude_catalogs", SearchRequest(), "true")


@case("get_collection", "SELECT id, type, title FROM collections_v WHERE id = 'c5'", views=COLLECTIONS)
def get_collection(spark, sf_dir):
    return plan.get_collection(sample.collections(spark, sf_dir), "c5").select("id", "type", "title")
