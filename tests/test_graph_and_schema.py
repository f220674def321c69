import json

import pytest
from pyspark.sql import functions as F

from geoledger.operators import discovery, graph, validation
from geoledger.operators.fields import Fields
from geoledger.plans.search import SearchRequest
from geoledger.sources import geojson, typed


@pytest.fixture(scope="module")
def resources(spark):
    rows = [
        ("root_cat", "Catalog", []), ("a", "Catalog", ["root_cat"]), ("b", "Catalog", ["root_cat", "a"]),
        # a loop, and an empty catalog
        ("x", "Catalog", ["a", "y"]), ("y", "Catalog", ["x"]), ("empty", "Catalog", ["root_cat"]),
        ("c1", "Collection", ["b"]), ("c2", None, ["x", "b"]), ("c3", "Collection", ["y"]), ("c4", "Collection", None),
        ("c5", "Collection", ["root_cat", "a"]),
    ]
    return spark.createDataFrame(rows, "id string, type string, parent_ids array<string>")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"i{n}", f"c{n % 5 + 1}") for n in range(20)]
    df = spark.createDataFrame(rows, "id string, collection string")
    stamp = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumns({n: stamp for n in ("datetime", "start_datetime", "end_datetime")})


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


@pytest.mark.parametrize("catalog, want", [
    ("root_cat", {"c1", "c2", "c3", "c5"}), ("b", {"c1", "c2"}), ("x", {"c2", "c3"}), ("y", {"c2", "c3"}), ("empty", set()),
])
def test_descendants(resources, catalog, want):
    assert ids(graph.descendant_collections(resources, catalog)) == want


def test_scoped_search(resources, items):
    def found(catalog, asked=()):
        page = graph.catalog_search(items, resources, catalog, SearchRequest(collections=asked, limit=100))
        return {r["collection"] for r in page.rows.collect()}

    assert found("b") == {"c1", "c2"}
    assert found("b", ["c2", "c3"]) == {"c2"}
    assert found("empty") == set()
    with pytest.raises(graph.OutOfScope):
        found("b", ["c3"])
    with pytest.raises(LookupError):
        found("c1")


def test_children_and_members(resources, items):
    assert [r["id"] for r in graph.children(resources, "root_cat").rows.collect()] == ["a", "b", "c5", "empty"]
    assert ids(graph.children(resources, "root_cat", "Collection").rows) == {"c5"}
    assert ids(graph.children(resources, "b", "Collection").rows) == {"c1", "c2"}
    assert graph.member_items(items, resources, "b", "c1", SearchRequest(limit=50)).rows.count() == 4
    with pytest.raises(LookupError):
        graph.member_items(items, resources, "a", "c1")
    with pytest.raises(LookupError):
        graph.get_catalog(resources, "c1")


def test_links(spark, resources):
    def parents(df, of):
        return df.filter(F.col("id") == of).first()["parent_ids"]

    assert parents(graph.link(resources, "c4", "a"), "c4") == ["a"]
    assert parents(graph.link(resources, "c1", "b"), "c1") == ["b"]
    assert parents(graph.unlink(resources, "c2", "x"), "c2") == ["b"]
    new = spark.createDataFrame([("b", "other"), ("fresh", "new")], "id string, title string")
    put = graph.put_catalogs(resources.withColumn("title", F.lit("t")), new)
    assert parents(put, "b") == ["root_cat", "a"] and put.filter("id = 'fresh'").first()["type"] == "Catalog"
    assert "x" not in ids(graph.delete_catalog(resources, "x")) and "c1" in ids(graph.delete_catalog(resources, "c1"))


def test_parents(resources):
    def rows(context, of):
        got = graph.parents(resources, context).filter(F.col("id") == of).orderBy("position").collect()
        return [(r["parent"], r["relation"]) for r in got]

    assert rows(None, "c2") == [("root", "parent"), ("x", "related"), ("b", "related")]
    assert rows("b", "c2") == [("b", "parent"), ("x", "related")]
    assert rows(None, "root_cat") == [("root", "parent")]
    assert rows(None, "b") == [("root_cat", "parent"), ("a", "related")]


# ---------------------------------------------------------------- typed documents


def test_templates():
    assert typed.template_type("properties.title", "string") == {"type": "text"}
    assert typed.template_type("properties.n", "long") == {"type": "double"}
    assert typed.template_type("properties.proj:epsg", "long") == {"type": "integer"}
    assert typed.template_type("properties.flag", "boolean") == {"type": "boolean"}
    custom = typed.merge_templates(typed.BASE_TEMPLATES, [
        {"strings": {"match_mapping_type": "string", "mapping": {"type": "text"}}},
        {"codes": {"path_match": "properties.code*", "mapping": {"type": "long"}}}])
    assert len(custom) == len(typed.BASE_TEMPLATES) + 1
    assert typed.template_type("properties.word", "string", custom) == {"type": "text"}
    for bad in ({}, {"a": 1, "b": 2}, {"a": {"mapping": {"type": "x"}}}, {"a": {"match": "x"}}, {"": {"match": "x", "mapping": {"type": "x"}}}):
        with pytest.raises(ValueError):
            typed.merge_templates(typed.BASE_TEMPLATES, [bad])


def test_field_merge():
    base = {"a": {"type": "keyword"}, "b": {"c": {"d": 1}}}
    assert typed.merge_fields(base, {"a": {"type": "long"}, "b": {"c": {"e": 2}}}) == {"a": {"type": "long"}, "b": {"c": {"d": 1, "e": 2}}}
    assert base["a"] == {"type": "keyword"}
    assert typed.dynamic_mode(None) == "true" and typed.dynamic_mode("STRICT") == "strict"
    with pytest.raises(ValueError):
        typed.dynamic_mode("maybe")


def test_typed_documents(spark):
    docs = [
        {"id": "a", "collection": "c", "geometry": {"type": "Point", "coordinates": [1, 2]},
         "properties": {"datetime": "2020-01-01T00:00:00Z", "n": 1, "s": "x", "tags": ["p", "q"], "proj:centroid": {"lat": 1.5, "lon": 2},
                        "deep": {"k": 2.5}, "proj:projjson": {"any": [1]}, "ok": True}, "assets": {"B": {"href": "h"}}},
        {"id": "b", "collection": "c", "geometry": None, "properties": {"datetime": "soon", "n": "7", "deep": {"k": "z"}}},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "document string")
    mapping = typed.mapping_for(typed.observed_fields(df), {**typed.BASE_FIELDS, "properties.n": {"type": "double"}, "properties.deep.k": {"type": "double"}})
    rows = {r["id"]: r for r in typed.typed(df, mapping).collect()}
    a, b = rows["a"], rows["b"]
    assert a["error"] is None and a["minx"] == 1.0 and a["maxy"] == 2.0
    props = a["properties"].asDict(recursive=True)
    assert (props["n"], props["s"], props["tags"], props["proj:centroid"], props["deep"], props["ok"]) == (
        1.0, "x", ["p", "q"], {"lat": 1.5, "lon": 2.0}, {"k": 2.5}, True)
    assert b["error"] == "failed to parse field [properties.datetime] of type [date_nanos]"
    assert b["properties"]["n"] == 7.0 and b["geometry"] is None
    good, bad = typed.split_rejected(typed.typed(df, mapping))
    assert ids(good) == {"a"} and ids(bad) == {"b"}


def test_feature_files(spark, tmp_path):
    features = [{"type": "Feature", "id": f"f{n}", "collection": "own", "properties": {}, "geometry": {"type": "Point", "coordinates": [n, n]}} for n in range(3)]
    (tmp_path / "one.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=2))
    (tmp_path / "two.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{**features[0], "id": "g"}]}))
    got = geojson.read_features(spark, str(tmp_path), "stamped").collect()
    assert {(r["collection"], r["id"]) for r in got} == {("stamped", i) for i in ("f0", "f1", "f2", "g")}
    assert json.loads(got[0]["document"])["type"] == "Feature"
    assert {r["collection"] for r in geojson.read_features(spark, str(tmp_path)).collect()} == {"own"}


def test_collection_files(spark, tmp_path):
    doc = {"id": "x", "type": "Collection", "extent": {"spatial": {"bbox": [[1, 2, 3, 4]]}, "temporal": {"interval": [["2013-06-01T00:00:00Z", None]]}}}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    row = geojson.parse_collections(geojson.read_collections(spark, str(tmp_path), "renamed")).first()
    assert row["id"] == "renamed" and row["extent"]["spatial"]["bbox"] == [[1.0, 2.0, 3.0, 4.0]]
    assert row["extent"]["temporal"]["interval"][0][0].year == 2013


# ---------------------------------------------------------------- validation and discovery


def test_ring_and_bounds_messages(spark):
    def first(ring, **kw):
        df = spark.createDataFrame([(ring,)], "r array<struct<x:double,y:double>>")
        return df.select(validation.ring_error(F.col("r"), **kw), validation.bounds_error(F.col("r"))).first()

    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert tuple(first(square)) == (None, None)
    assert first(square[:3])[0] == validation.MSG_SHORT_RING
    assert "too many vertices (4)" in first(square, max_vertices=3)[0]
    assert "between longitude -170.0 and 170.0" in first([(-170.0, 0.0), (170.0, 0.0), (170.0, 1.0), (-170.0, 0.0)])[0]
    assert first([(181.0, 0.0), (0.0, 0.0)])[1] == "Coordinates out of global WGS84 bounds: [181.0, 0.0]"


def test_time_rules_on_text(spark):
    rows = [("a", "2020-01-01T00:00:00Z", None, None), ("b", None, "2020-01-01T00:00:00Z", None), ("c", "then", None, None),
            ("d", None, "2020-01-02T00:00:00Z", "2020-01-01T00:00:00Z"), ("e", "2019-01-01T00:00:00Z", "2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z"),
            ("f", "2020-06-01T00:00:00Z", None, "2021-01-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "id string, datetime string, start_datetime string, end_datetime string")
    got = {r["id"]: r["e"] for r in df.select("id", validation.datetime_error(Fields.of(df)).alias("e")).collect()}
    prefix = validation.DATETIME_PREFIX
    assert got == {
        "a": None, "b": prefix + validation.MSG_NEEDS_BOTH, "c": prefix + "Invalid ISO 8601 format for 'datetime': then",
        "d": prefix + "'start_datetime' (2020-01-02T00:00:00Z) must be <= 'end_datetime' (2020-01-01T00:00:00Z)",
        "e": prefix + "'datetime' (2019-01-01T00:00:00Z) must be >= 'start_datetime' (2020-01-01T00:00:00Z)",
        "f": prefix + validation.MSG_PAIR}


def test_exclusions():
    excluded = ["properties.auth:schemes", " storage ", ""]
    assert discovery.is_excluded("properties.auth:schemes.s3.type", excluded)
    assert discovery.is_excluded("auth:schemes", excluded) and discovery.is_excluded("properties.storage", excluded)
    assert not discovery.is_excluded("properties.storages", excluded) and not discovery.is_excluded("assets.auth:schemes", excluded)


def test_queryables_of_nested_items(spark):
    df = spark.range(4).select(
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("collection"),
        F.struct(F.when(F.col("id") % 2 == 0, F.lit(1.0)).alias("eo:cloud_cover"), F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")).alias("proj:centroid"),
                 F.array(F.lit("k")).alias("keywords"), F.lit("s").alias("platform")).alias("properties"),
        F.lit(0.0).alias("minx"))
    got = {(r["collection"], r["name"]): (r["type"], r["title"]) for r in discovery.queryables(df).collect()}
    assert got["c0", "eo:cloud_cover"] == ("number", "Eo:Cloud Cover") and ("c1", "eo:cloud_cover") not in got
    assert got["c1", "proj:centroid"] == ("object", "Proj:Centroid") and got["c1", "keywords"][0] == "string"
    assert ("c0", "minx") not in got
    listed = discovery.with_enum(discovery.queryables(df), discovery.enum_values(df)).filter("name = 'platform'").collect()
    assert [r["enum"] for r in listed] == [["s"], ["s"]]
    assert discovery.enum_values(df, limit=0).count() == 0


def test_queryables_of_a_file(spark, tmp_path):
    base = {(r["name"], r["description"]) for r in discovery.root_queryables(spark, str(tmp_path / "none")).collect()}
    assert base == set(discovery.BASE_QUERYABLES.items())
    path = tmp_path / "queryables.json"
    path.write_text(json.dumps({"title": "t", "properties": {"id": {"description": "ID", "type": "string"}, "size": {"minimum": 0}}}, indent=1))
    rows = {r["name"]: r for r in discovery.root_queryables(spark, str(path)).collect()}
    assert set(rows) == {"id", "size"} and rows["id"]["description"] == "ID" and rows["size"]["description"] is None
    assert json.loads(rows["size"]["definition"]) == {"minimum": 0}
    path.write_text("{}")
    assert discovery.root_queryables(spark, str(path)).count() == 0
    path.write_text("[1]")
    with pytest.raises(Exception, match="not a JSON object"):
        discovery.root_queryables(spark, str(path)).collect()


def test_lists_of_values_end_at_the_limit(spark):
    rows = spark.createDataFrame([("a", f"p{n % 5}") for n in range(50)] + [("b", f"p{n}") for n in range(6)] + [("c", None)], "collection string, platform string")
    got = sorted((r["collection"], r["value"]) for r in discovery.enum_values(rows, limit=5).collect())
    assert got == [("a", f"p{n}") for n in range(5)]
