"""Operator matrices on hand-made items."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geoledger.operators import filters
from geoledger.operators.cql2 import cql2, cql2_properties
from geoledger.operators.fields import Fields, negate
from geoledger.operators.text import allowed_typos, by_free_text, near
from geoledger.plans.search import (
    SearchOptions, SearchRequest, check_fields, collection_bbox, collection_datetime, filter_collections, filter_items,
)


def op(name, *args):
    return {"op": name, "args": list(args)}


def prop(name):
    return {"property": name}


ROWS = [
    # id, collection, cloud, platform, tags, dt, start, end, hidden, title
    ("a", "c1", 5, "sat-1", ["x", "y"], datetime(2020, 1, 1), None, None, False, "Ocean Temperature map"),
    ("b", "c1", 50, "sat-2", [], None, datetime(2020, 1, 1), datetime(2020, 3, 1), True, "ocean salinity"),
    ("c", "c2", None, None, None, datetime(2020, 2, 1), datetime(2020, 1, 15), datetime(2020, 2, 15), None, None),
    ("d", "c2", 20, "SAT-1", ["y"], None, None, None, False, "Land cover"),
    ("e", "c3", 20, "other", ["z"], datetime(1960, 1, 1), None, None, None, "Déjà vu, tempertaure"),
]


@pytest.fixture(scope="module")
def items(spark):
    flat = spark.createDataFrame(
        ROWS, "id string, collection string, cloud int, platform string, tags array<string>, datetime timestamp_ntz, "
        "start_datetime timestamp_ntz, end_datetime timestamp_ntz, hidden boolean, title string")
    return flat.withColumn("properties", F.struct(
        F.col("cloud").cast("double").alias("eo:cloud_cover"), "platform", "tags", "title",
        F.struct("hidden").alias("_private"))).drop("cloud", "platform", "tags", "hidden", "title")


def found(items, condition):
    return {r["id"] for r in items.filter(condition).select("id").collect()}


@pytest.mark.parametrize("expr, want", [
    (op("=", prop("eo:cloud_cover"), 20), "de"),
    (op("=", prop("properties.eo:cloud_cover"), 20.0), "de"),
    (op("=", prop("eo:cloud_cover"), "20"), "de"),
    (op("<>", prop("eo:cloud_cover"), 20), "abc"),
    (op("<", prop("eo:cloud_cover"), 20), "a"),
    (op("<=", prop("eo:cloud_cover"), 20), "ade"),
    (op(">", prop("eo:cloud_cover"), 20), "b"),
    (op(">=", prop("eo:cloud_cover"), 20), "bde"),
    (op("not", op("<", prop("eo:cloud_cover"), 20)), "bcde"),
    (op("not", op("and", op("=", prop("platform"), "sat-1"), op("<", prop("eo:cloud_cover"), 99))), "bcde"),
    (op("not", op("or", op("=", prop("platform"), "sat-1"), op("=", prop("id"), "e"))), "bcd"),
    (op("not", op("not", op("=", prop("platform"), "sat-1"))), "a"),
    (op("and", op("=", prop("id"), "a"), op("=", prop("collection"), "c1")), "a"),
    (op("or", op("=", prop("id"), "a"), op("isNull", prop("platform"))), "ac"),
    (op("isNull", prop("tags")), "bc"),
    (op("isNull", prop("no_such")), "abcde"),
    (op("=", prop("no_such"), 1), ""),
    (op("<>", prop("no_such"), 1), "abcde"),
    (op("between", prop("eo:cloud_cover"), [5, 20]), "ade"),
    (op("between", prop("eo:cloud_cover"), 5, 20), "ade"),
    (op("in", prop("id"), ["a", "c", "zz"]), "ac"),
    (op("in", prop("id"), []), ""),
    (op("like", prop("platform"), "sat-_"), "abd"),
    (op("not", op("like", prop("platform"), "sat%")), "ce"),
    (op("=", prop("tags"), "y"), "ad"),
    (op("<>", prop("tags"), "y"), "bce"),
    (op("like", prop("tags"), "%"), "ade"),
    (op("=", prop("datetime"), {"timestamp": "2020-02-01T00:00:00Z"}), "c"),
    (op("<>", prop("datetime"), {"timestamp": "2020-02-01T00:00:00Z"}), "abde"),
    (op("between", prop("datetime"), [{"timestamp": "2020-01-01T00:00:00Z"}, {"timestamp": "2020-01-01T02:00:00+02:00"}]), "a"),
    (op("AND", op("=", prop("id"), "a")), "a"),
])
def test_cql2(items, expr, want):
    assert found(items, cql2(Fields.of(items), expr)) == set(want)


@pytest.mark.parametrize("expr", [
    op("in", prop("id"), "a"), op("like", prop("id"), "\\"), op("between", prop("id"), 1), op("maybe", prop("id")),
    op("=", "id", "a"), op("=", prop("eo:cloud_cover"), "cloudy"), op("=", prop("datetime"), "then"),
])
def test_bad_cql2(items, expr):
    with pytest.raises(ValueError):
        cql2(Fields.of(items), expr)


def test_a_filter_and_its_negation_part_the_rows(items):
    fields = Fields.of(items)
    for expr in (op("=", prop("platform"), "sat-1"), op("like", prop("platform"), "s%"), op("isNull", prop("tags"))):
        yes, no = found(items, cql2(fields, expr)), found(items, negate(cql2(fields, expr)))
        assert yes | no == set("abcde") and not yes & no


def test_properties_of_a_filter():
    expr = op("and", op("=", prop("properties.a:b"), 1), op("not", op("like", prop("assets.c"), "x")), op("=", prop("d"), 1))
    assert cql2_properties(expr) == {"a:b", "c", "d"}
    check_fields({"d"}, ["d", "e"])
    with pytest.raises(ValueError, match="a:b, c"):
        check_fields({"d", "c", "a:b"}, ["d"])


@pytest.mark.parametrize("query, want", [
    ({"eo:cloud_cover": {"eq": 20}}, "de"),
    ({"eo:cloud_cover": {"gte": 5, "lt": 50}}, "ade"),
    ({"platform": {"ne": "sat-1"}}, "bcde"),
    ({"platform": {"in": ["sat-1", "other"]}}, "ae"),
    ({"platform": {"in": "other"}}, "e"),
    ({"tags": {"contains": "y"}}, "ad"),
    ({"tags": {"contains": "q"}}, ""),
])
def test_query_operators(items, query, want):
    assert found(items, filters.by_query(Fields.of(items), query)) == set(want)


@pytest.mark.parametrize("interval, use_datetime, want", [
    (None, True, "abc"),
    ("2020-01-01T00:00:00Z", True, "ab"),
    ("2020-02-10T00:00:00Z/..", True, "b"),
    ("../2020-01-20T00:00:00Z", True, "ab"),
    ("2020-02-10T00:00:00Z/..", False, "bc"),
    (None, False, "bc"),
])
def test_time(items, interval, use_datetime, want):
    assert found(items, filters.by_datetime(Fields.of(items), interval, use_datetime)) == set(want)


def test_searches_skip_hidden_rows_and_aggregations_do_not(items):
    options = SearchOptions(hide_path="properties._private.hidden")
    assert {r["id"] for r in filter_items(items, SearchRequest(), options).collect()} == set("ac")
    assert {r["id"] for r in filter_items(items, SearchRequest(), options, aggregating=True).collect()} == set("abcde")


@pytest.mark.parametrize("q, want", [
    ("ocean", "ab"), ("OCEAN", "ab"), ("temperature", "ae"), ("temperatrue", "ae"), ("salinity,cover", "bd"),
    (["land", "map"], "ad"), ("lnad", "d"), ("déjà", "e"), ("c1", "ab"), ("a", "a"), ("zzz", ""),
])
def test_free_text(items, q, want):
    assert found(items, by_free_text(Fields.of(items), q)) == set(want)


def test_free_text_on_chosen_fields(items):
    fields = Fields.of(items)
    assert found(items, by_free_text(fields, "sat-2", ["properties.platform^5"])) == set("ab")
    assert found(items, by_free_text(fields, "sat-2", ["properties.platform"], fuzzy=False)) == {"b"}
    assert found(items, by_free_text(fields, "ocean", ["properties.platform"])) == set()


def edit_distance(a, b):
    """Optimal string alignment, straight from its definition."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_typos_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(7)
    words = {"".join(p) for n in range(1, 6) for p in itertools.product("ab", repeat=n)}
    words |= {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(400)}
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "w string").repartition(4)
    for word in ("abcdab", "aabbccd", "abc", "abab", "ab"):
        typos = allowed_typos(word)
        got = {r["w"] for r in rows.filter(near(F.col("w"), word, typos)).collect()}
        assert got == {w for w in words if edit_distance(w, word) <= typos}


# ---------------------------------------------------------------- collections


@pytest.fixture(scope="module")
def collections(spark):
    rows = [
        ("open", "Collection", [[datetime(2013, 6, 1), None]], 0.0, 0.0, 10.0, 10.0),
        ("closed", "Collection", [[datetime(2010, 1, 1), datetime(2012, 1, 1)]], 20.0, 20.0, 30.0, 30.0),
        ("gap", None, [[datetime(2000, 1, 1), datetime(2001, 1, 1)], [datetime(2015, 1, 1), datetime(2016, 1, 1)]], -5.0, -5.0, 0.0, 0.0),
        ("cat", "Catalog", None, None, None, None, None),
    ]
    return spark.createDataFrame(
        rows, "id string, type string, interval array<array<timestamp_ntz>>, minx double, miny double, maxx double, maxy double")


@pytest.mark.parametrize("probe, want, sane", [
    ("2020-01-01T00:00:00Z/..", set(), {"open"}),
    ("2011-01-01T00:00:00Z", {"closed", "gap"}, {"closed", "gap", "open"}),
    ("../2000-06-01T00:00:00Z", {"gap"}, {"gap", "open"}),
    ("2013-01-01T00:00:00Z/2014-01-01T00:00:00Z", {"open", "gap"}, {"open", "gap"}),
])
def test_collection_time(collections, probe, want, sane):
    dates = F.flatten("interval")
    got = {r["id"] for r in collections.filter(collection_datetime(dates, probe)).collect()}
    assert got == want
    got = {r["id"] for r in collections.filter(collection_datetime(dates, probe, open_end=True)).collect()}
    assert want <= got


@pytest.mark.parametrize("bbox, want", [
    ([5, 5, 25, 25], {"open", "closed"}), ("-1,-1,1,1", {"open", "gap"}), ([1, 2, 3], {"open", "closed", "gap", "cat"}),
    ("west", {"open", "closed", "gap", "cat"}),
])
def test_collection_box(collections, bbox, want):
    got = {r["id"] for r in collections.filter(collection_bbox(Fields.of(collections), bbox)).collect()}
    assert got == want


def test_catalogs_are_not_collections(collections):
    assert {r["id"] for r in filter_collections(collections, SearchRequest()).collect()} == {"open", "closed", "gap"}
