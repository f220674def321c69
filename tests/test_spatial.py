"""Exact relations against sampling and against hand-made shapes."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.functions import geometry as g
from geoledger.functions import grids, predicates
from geoledger.operators import aggregate as agg
from geoledger.operators.fields import Fields
from geoledger.operators.spatial import by_bbox, spatial
from geoledger.session import materialised


def box(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


DONUT = {"type": "Polygon", "coordinates": [box(0, 0, 10, 10)["coordinates"][0], box(4, 4, 6, 6)["coordinates"][0]]}
SHAPES = {
    "point_in": {"type": "Point", "coordinates": [1, 1]},
    "point_hole": {"type": "Point", "coordinates": [5, 5]},
    "point_edge": {"type": "Point", "coordinates": [0, 5]},
    "line_across": {"type": "LineString", "coordinates": [[-5, 5], [15, 5]]},
    "line_hole": {"type": "LineString", "coordinates": [[4.5, 5], [5.5, 5]]},
    "line_edge": {"type": "LineString", "coordinates": [[0, 0], [0, 10]]},
    "box_in": box(1, 1, 3, 3),
    "box_over_hole": box(3, 3, 7, 7),
    "box_in_hole": box(4.5, 4.5, 5.5, 5.5),
    "box_around": box(-5, -5, 20, 20),
    "box_half": box(8, 8, 12, 12),
    "box_far": box(20, 20, 21, 21),
    "box_touch": box(10, 0, 12, 2),
    "same": DONUT,
    "multi": {"type": "MultiPolygon", "coordinates": [box(1, 1, 2, 2)["coordinates"], box(50, 50, 51, 51)["coordinates"]]},
    "points": {"type": "MultiPoint", "coordinates": [[1, 1], [9, 9]]},
    "mixed": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [5, 5]}, {"type": "Point", "coordinates": [2, 2]}]},
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(name, json.dumps(shape)) for name, shape in SHAPES.items()] + [("none", None), ("bad", "{}")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("geometry", g.geometry_from_json(F.col("text")))
    return materialised(df.withColumns(g.bounds_of(F.col("geometry"))))


def found(df, condition):
    return {r["id"] for r in df.filter(condition).select("id").collect()}


def test_relations_to_a_donut(shapes):
    fields = Fields.of(shapes)
    disjoint = {"point_hole", "line_hole", "box_in_hole", "box_far"}
    assert found(shapes, spatial(fields, "disjoint", DONUT)) == disjoint
    assert found(shapes, spatial(fields, "intersects", DONUT)) == set(SHAPES) - disjoint
    assert found(shapes, spatial(fields, "within", DONUT)) == {"point_in", "point_edge", "line_edge", "box_in", "same", "points"}
    assert found(shapes, spatial(fields, "contains", DONUT)) == {"same", "box_around"}


def test_relations_to_a_box_and_a_point(shapes):
    fields = Fields.of(shapes)
    assert found(shapes, by_bbox(fields, [4.5, 4.5, 5.5, 5.5])) == {
        "point_hole", "line_across", "line_hole", "box_over_hole", "box_in_hole", "box_around", "mixed"}
    assert found(shapes, spatial(fields, "contains", SHAPES["point_hole"])) == {
        "point_hole", "line_across", "line_hole", "box_over_hole", "box_in_hole", "box_around", "mixed"}
    assert found(shapes, spatial(fields, "within", box(0, 0, 5, 5))) == {"point_in", "point_hole", "point_edge", "box_in", "mixed"}


def inside(points, ring):
    """Even-odd rule by hand."""
    odd = np.zeros(len(points), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        cross = (ay > points[:, 1]) != (by > points[:, 1])
        odd ^= cross & (points[:, 0] < (bx - ax) * (points[:, 1] - ay) / ((by - ay) or 1) + ax)
    return odd


def star(rng, cx, cy, r):
    angles = sorted(rng.uniform(0, 2 * np.pi) for _ in range(rng.randint(3, 9)))
    ring = [[cx + r * rng.uniform(.3, 1) * np.cos(a), cy + r * rng.uniform(.3, 1) * np.sin(a)] for a in angles]
    return ring + ring[:1]


def polygon(*rings):
    return json.dumps({"type": "Polygon", "coordinates": rings})


def test_relations_agree_with_sampling(spark):
    rng = random.Random(3)
    rings = [(star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(.3, 3)), star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(.3, 3)))
             for _ in range(300)]
    pairs = spark.createDataFrame([(n, polygon(a), polygon(b)) for n, (a, b) in enumerate(rings)], "n int, a string, b string")
    a, b = (predicates.shape_of(g.geometry_from_json(F.col(c))) for c in ("a", "b"))
    rows = pairs.select("n", predicates.intersects(a, b).alias("ab"), predicates.intersects(b, a).alias("ba"), predicates.covers(b, a).alias("within"))
    decided = 0
    for r in rows.collect():
        first, second = rings[r.n]
        low, high = np.min(first, axis=0), np.max(first, axis=0)
        points = np.random.default_rng(r.n).uniform(low, high, (4000, 2))
        in_a, in_b = inside(points, first), inside(points, second)
        assert r.ab == r.ba
        if (in_a & in_b).any():
            assert r.ab
        if (in_a & ~in_b).any():
            assert not r.within
        if r.within or not r.ab:
            decided += 1
            assert not (in_a & (~in_b if r.within else in_b)).any()
    assert decided > 20


def test_intersection_is_symmetric(shapes):
    met = {name: found(shapes, spatial(Fields.of(shapes), "intersects", literal)) for name, literal in SHAPES.items()}
    assert all(name in others for name, others in met.items())
    assert all((a in met[b]) == (b in met[a]) for a in SHAPES for b in SHAPES)


@pytest.mark.parametrize("literal, want", [
    ({"op": "point", "args": [1, 2]}, {"type": "Point", "coordinates": [1, 2]}),
    ({"op": "linestring", "args": [[[0, 0], [1, 1]]]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}),
    ({"op": "polygon", "args": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}),
    ({"op": "polygon", "args": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}),
    ({"op": "polygon", "args": [[0, 0, 1, 0, 1, 1, 0, 0]]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}),
])
def test_call_form(literal, want):
    assert g.normalise_literal(literal) == want


@pytest.mark.parametrize("relation", ["intersects", "within", "contains", "disjoint"])
def test_relations_run_in_the_plan(shapes, relation):
    plan = shapes.filter(spatial(Fields.of(shapes), relation, DONUT))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shapes_that_fill_their_bounds(shapes):
    boxed = g.is_box(F.col("geometry"), *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    assert found(shapes, boxed) == {n for n in SHAPES if n.startswith(("point_", "box_"))}


def test_a_bow_tie_is_no_box(spark):
    tie = {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]]}
    row = spark.createDataFrame([(json.dumps(tie),)], "text string").select(g.geometry_from_json(F.col("text")).alias("geometry"))
    row = row.withColumns(g.bounds_of(F.col("geometry")))
    assert not row.select(g.is_box(F.col("geometry"), *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])).first()[0]


def test_known_cells(spark):
    row = spark.range(1).select(F.lit(150.8636).alias("lon"), F.lit(-33.1689).alias("lat"))
    got = row.select(
        grids.geohash(F.col("lon"), F.col("lat"), 5).alias("h"), grids.geotile(F.col("lon"), F.col("lat"), 5).alias("t"),
        grids.geohash(F.lit(180.0), F.lit(90.0), 12).alias("corner"), grids.geotile(F.lit(180.0), F.lit(-90.0), 3).alias("south"),
    ).first()
    assert got["h"] == "r6572" and got["t"] == "5/29/19"
    assert got["corner"] == "z" * 12 and got["south"] == "3/7/7"


def test_cells_of_a_triangle(spark):
    triangle = {"type": "Polygon", "coordinates": [[[0.1, 0.1], [44, 0.1], [0.1, 44], [0.1, 0.1]]]}
    df = spark.createDataFrame([("t", json.dumps(triangle))], "id string, text string").withColumn(
        "geometry", g.geometry_from_json(F.col("text")))
    df = materialised(df.withColumns(g.bounds_of(F.col("geometry"))))
    got = {r["key"] for r in agg.geometry_grid(df, "geohash", 2).collect()}
    # every cell that holds a point of a fine raster of the triangle, and no cell beyond its bounds
    xs = np.arange(0.1, 44, 0.25)
    raster = [(float(x), float(y)) for x in xs for y in xs if (x - .1) + (y - .1) < 43.9]
    cells = spark.createDataFrame(raster, "lon double, lat double")
    want = {r[0] for r in cells.select(grids.geohash(F.col("lon"), F.col("lat"), 2)).distinct().collect()}
    bounds = agg.geometry_grid(df.drop("geometry"), "geohash", 2).count()
    assert want <= got and len(got) < bounds


def test_strips_against_cells(spark):
    rng, rows = random.Random(5), []
    for n in range(30):
        # corners all around, so that the shrunken copy is a hole inside
        corners = rng.randint(5, 9)
        angles = [2 * np.pi * (k + rng.random()) / corners for k in range(corners)]
        ring = [[4 * rng.uniform(.3, 1) * np.cos(a), 4 * rng.uniform(.3, 1) * np.sin(a)] for a in angles]
        hole = [[x * .2, y * .2] for x, y in ring]
        rows.append((n, json.dumps({"type": "GeometryCollection", "geometries": [
            {"type": "Polygon", "coordinates": [ring + ring[:1], hole + hole[:1]]},
            {"type": "LineString", "coordinates": [[-5, 3.31], [5, 4.12]]}, {"type": "Point", "coordinates": [1.03, 1.07]}]})))
    df = spark.createDataFrame(rows, "n int, text string").select("n", predicates.shape_of(g.geometry_from_json(F.col("text"))).alias("shape"))
    df = df.select("*", F.explode(F.lit([float(x) for x in np.arange(-5, 5, 1.25)])).alias("x"))
    df = df.select("*", F.explode(F.lit([float(y) for y in np.arange(-5, 5, 0.5)])).alias("y"))
    right, top = F.col("x") + 1.25, F.col("y") + 0.5
    cell = predicates.shape_of(g.box_geometry(F.col("x"), F.col("y"), right, top))
    spans = predicates.strip_spans(F.col("shape"), F.col("x"), right)
    hit = F.exists(spans, lambda s: (s["low"] <= top) & (s["high"] >= F.col("y")))
    got = df.select(hit.alias("hit"), predicates.intersects(F.col("shape"), cell).alias("met"))
    assert got.filter("hit <> met").count() == 0 and got.filter("hit").count() > 1000


def test_a_fine_grid_over_a_wide_box(spark):
    df = spark.createDataFrame([("w", 10.0, 20.0, 10.2, 20.3)] * 2 + [("p", 10.1, 20.1, 10.1, 20.1)], "id string, minx double, miny double, maxx double, maxy double")
    rows = agg.geometry_grid(df, "geohash", 8).collect()
    assert len(rows) == 10_000 and rows[0]["frequency"] == 3 and {r["frequency"] for r in rows[1:]} == {2}


def test_a_box_across_the_antimeridian(spark):
    rows = [("west", 175.0), ("east", -175.0), ("zero", 0.5)]
    df = spark.createDataFrame([(n, x, 0.0, x + 1, 1.0) for n, x in rows], "id string, minx double, miny double, maxx double, maxy double")
    assert found(df, by_bbox(Fields.of(df), [170, -10, -170, 10])) == {"west", "east"}
    assert found(df, by_bbox(Fields.of(df), [-170, -10, 170, 10])) == {"zero"}


def ragged(rng, n, turn=False):
    """Literals of many edges: a coast, a comb of long teeth, islands with a lagoon, and a long line."""
    angles = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 20 + 4 * np.sin(7 * angles) + np.array([rng.uniform(0, 1) for _ in angles])
    coast = np.stack([radius * np.cos(angles), radius * np.sin(angles)], axis=1).tolist()
    teeth = [[-20 + 40 * i / n, 18.0 if i % 2 else -18.0 + 30 * (i % 4 == 0)] for i in range(n)]
    comb = [[-20.0, -19.0], *teeth, [20.0, -19.0]]
    islands = []
    for k in range(9):
        cx, cy = -16 + 16 * (k % 3), -16 + 16 * (k // 3)
        outer = np.stack([cx + 6 * np.cos(angles[::9]), cy + 6 * np.sin(angles[::9])], axis=1).tolist()
        lagoon = np.stack([cx + 2 * np.cos(angles[::9]), cy + 2 * np.sin(angles[::9])], axis=1).tolist()
        islands.append([outer + outer[:1], lagoon + lagoon[:1]])
    shapes = {
        "coast": {"type": "Polygon", "coordinates": [coast + coast[:1]]}, "comb": {"type": "Polygon", "coordinates": [comb + comb[:1]]},
        "islands": {"type": "MultiPolygon", "coordinates": islands}, "line": {"type": "LineString", "coordinates": coast},
        "points": {"type": "MultiPoint", "coordinates": coast},
    }
    if turn:
        return {name: json.loads(json.dumps(s), parse_float=float) | {"coordinates": _turned(s["coordinates"])} for name, s in shapes.items()}
    return shapes


def _turned(coordinates):
    return coordinates[::-1] if isinstance(coordinates[0], float) else [_turned(c) for c in coordinates]


@pytest.mark.parametrize("turn", [False, True])
def test_slabs_agree_with_the_whole_literal(spark, turn):
    rng = random.Random(11)
    rows = []
    for n in range(250):
        cx, cy = rng.uniform(-26, 26), rng.uniform(-26, 26)
        size = rng.choice([.05, .5, 3, 15])
        rows.append((n, json.dumps(rng.choice([
            {"type": "Polygon", "coordinates": [star(rng, cx, cy, size)]}, box(cx, cy, cx + size, cy + size),
            {"type": "LineString", "coordinates": [[cx, cy], [cx + size, cy + rng.uniform(-size, size)]]}, {"type": "Point", "coordinates": [cx, cy]}]))))
    df = spark.createDataFrame(rows, "n int, text string").withColumn("geometry", g.geometry_from_json(F.col("text")))
    df = materialised(df.withColumns(g.bounds_of(F.col("geometry"))).repartition(8))
    # corners of the literal itself touch it
    for name, literal in ragged(rng, 120, turn).items():
        parts = g.literal_parts(literal)
        whole = predicates.literal_shape(parts)
        if name == "points":
            assert predicates.literal_slabs(parts) is None
            continue
        slabs, flip = predicates.literal_slabs(parts)
        if name == "comb":
            assert flip == (not turn)
        low, high = ("minx", "maxx") if flip else ("miny", "maxy")
        near = predicates.nearby(slabs, F.col(low), F.col(high))
        plain, turned = predicates.shape_of(F.col("geometry")), predicates.shape_of(F.col("geometry"), flip)
        got = df.select(
            predicates.intersects(plain, whole).alias("a"), g._let(near, lambda s: predicates.intersects(turned, s)).alias("b"),
            predicates.covers(whole, plain).alias("c"), g._let(near, lambda s: predicates.covers(s, turned)).alias("d")).collect()
        assert all(r.a == r.b and r.c == r.d for r in got), name
        assert any(r.a for r in got) and not all(r.a for r in got)
        assert name == "line" or any(r.c for r in got)


def test_slabs_hold_every_edge_of_a_range_once(spark):
    rng = random.Random(5)
    for turn in (False, True):
        for literal in ragged(rng, 400, turn).values():
            parts = g.literal_parts(literal)
            index = predicates.literal_slabs(parts)
            if index is None:
                assert literal["type"] == "MultiPoint"
                continue
            slabs, flip = index
            ranges = [(a, a + rng.choice([0, .01, 1, 50])) for a in (rng.uniform(-30, 30) for _ in range(40))]
            found = spark.createDataFrame(ranges, "low double, high double").select(
                "low", "high", F.flatten(F.transform(predicates.nearby(slabs, F.col("low"), F.col("high")), lambda p: p["edges"])).alias("edges")).collect()
            every = np.concatenate([predicates._literal_edges(dim, rings) for dim, rings in parts])
            every = every[:, [1, 0, 3, 2]] if flip else every
            for r in found:
                got = [tuple(e) for e in r.edges]
                needed = {tuple(e) for e in every.tolist() if min(e[1], e[3]) <= r.high and max(e[1], e[3]) >= r.low}
                assert len(got) == len(set(got)) and needed <= set(got)


def test_a_low_row_meets_few_edges():
    """5,000 vertices: a slab lists some tens of them, and all slabs together a few entries for each."""
    rng = random.Random(7)
    for name, literal in ragged(rng, 5000).items():
        if name in ("islands", "points"):
            continue
        dim, rings = g.literal_parts(literal)[0]
        kept = min((predicates._slab_part(dim, [r[:, ::step] for r in rings]) for step in (1, -1)),
                   key=lambda p: sum(map(len, p["passing"])) / len(p["starts"]))
        listed = sorted(len(a) + len(b) for a, b in zip(kept["starts"], kept["passing"]))
        assert listed[len(listed) // 2] < 150 and sum(listed) <= 5 * 5001, name
