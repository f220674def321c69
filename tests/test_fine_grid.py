"""Fine geometry grids: the cells found from coarse ones down are those of the grid spelled out."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geoledger.functions import geometry as g
from geoledger.operators import aggregate as agg
from geoledger.operators import fine_grid
from geoledger.session import materialised

BOUNDS = "minx double, miny double, maxx double, maxy double"


def both(df, kind, precision, monkeypatch, size=None):
    """Rows found from coarse cells down, and rows of the grid spelled out."""
    if size:
        monkeypatch.setattr(agg, "GRID_BUCKETS", size)
    out = []
    for spelled in (0, 99):
        monkeypatch.setattr(agg, "SPELLED", {"geohash": spelled, "geotile": spelled})
        out.append(sorted((r["key"], r["frequency"]) for r in agg.geometry_grid(df, kind, precision).collect()))
    return out


@pytest.mark.parametrize("kind, precision", [("geohash", 1), ("geohash", 5), ("geotile", 3), ("geotile", 10), ("geotile", 11)])
@pytest.mark.parametrize("size", [7, 10_000])
def test_boxes(spark, monkeypatch, kind, precision, size):
    rng, rows = random.Random(precision), []
    for _ in range(150):
        x, y = rng.uniform(-3, 3), rng.uniform(50, 54)
        rows.append((x, y, x + rng.choice([0.0, .3, 1.5]), y + rng.choice([0.0, .2, 1.0])))
    rows += [(-180.0, -90.0, -179.8, -89.9), (179.9, 89.9, 180.0, 90.0), (-2.0, 51.0, -2.0, 51.0), (None,) * 4] + rows[:40] * 3
    found, spelled = both(spark.createDataFrame(rows, BOUNDS), kind, precision, monkeypatch, size)
    assert found == spelled and len(found) > 2


@pytest.mark.parametrize("kind, precision", [("geohash", 5), ("geotile", 11)])
@pytest.mark.parametrize("size", [20, 10_000])
def test_shapes(spark, monkeypatch, kind, precision, size):
    """Polygons with holes, lines and points beside boxes."""
    rng, rows = random.Random(3), []
    for n in range(12):
        x, y = rng.uniform(0, 1), rng.uniform(0, 1)
        hole = [[x + .5, y + .5], [x + .6, y + .5], [x + .55, y + .7], [x + .5, y + .5]]
        rows.append({"type": "Polygon", "coordinates": [[[x, y], [x + 1.4, y + .2], [x + 1.1, y + 1.3], [x - .1, y + 1], [x, y]], hole]})
        rows.append({"type": "LineString", "coordinates": [[x, y], [x + .7, y + .9], [x + 1.5, y]]})
        rows.append({"type": "Point", "coordinates": [x, y]})
        rows.append({"type": "Polygon", "coordinates": [[[x, y], [x + 1, y], [x + 1, y + .5], [x, y + .5], [x, y]]]})
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "text string").withColumn("geometry", g.geometry_from_json(F.col("text")))
    df = materialised(df.withColumns(g.bounds_of(F.col("geometry"))))
    found, spelled = both(df, kind, precision, monkeypatch, size)
    assert found == spelled and len(found) >= 20


@pytest.mark.parametrize("kind, precision", [("geohash", 9), ("geohash", 12), ("geotile", 22), ("geotile", 29)])
def test_boxes_of_a_degree_at_the_finest_cells(spark, kind, precision):
    """The overlap of three boxes, far more cells than are shown: the largest keys of it, each counted three times."""
    df = spark.createDataFrame([(0.0, 10.0, 1.0, 11.0), (0.4, 10.3, 1.4, 11.3), (0.2, 10.6, 1.2, 11.6)] + [(5.0 + k, 10.0, 6.0 + k, 11.0) for k in range(20)], BOUNDS)
    rows = agg.geometry_grid(df, kind, precision).collect()
    assert len(rows) == 10_000 == len({r["key"] for r in rows}) and {r["frequency"] for r in rows} == {3}
    column, row, name, _ = agg._GRID_FUNCTIONS[kind]
    x, y = F.lit(0.4 + 0.6 * 0.5), F.lit(10.6 + 0.4 * 0.5)
    inner = spark.range(1).select(name(column(x, precision), row(y, precision), precision).alias("k")).first()["k"]
    assert min(r["key"] for r in rows) > inner


def test_tied_tiles_are_taken_by_text(spark, monkeypatch):
    """Keys of tiles are texts: 9/99/… comes after 9/100/…"""
    for size in (3, 50, 500):
        found, spelled = both(spark.createDataFrame([(-120.0, 20.0, -100.0, 40.0)], BOUNDS), "geotile", 9, monkeypatch, size)
        assert found == spelled and len(found) == size


@pytest.mark.parametrize("low, high", [(0, 0), (7, 7), (0, 130), (95, 105), (980, 1003), (123, 4567)])
def test_extremes_of_texts(spark, low, high):
    a, b = (F.lit(v).cast("long") for v in (low, high))
    row = spark.range(1).select(fine_grid._extreme(a, b, False).alias("first"), fine_grid._extreme(a, b, True).alias("last")).first()
    texts = sorted(map(str, range(low, high + 1)))
    assert (row["first"], row["last"]) == (texts[0], texts[-1])


def test_no_rows(spark):
    assert agg.geometry_grid(spark.createDataFrame([], BOUNDS), "geohash", 9).count() == 0


def test_edges_are_turned_once_per_row(spark):
    # below the rows' split into strips: a wide shape has many
    text = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [9, 1], [5, 7], [0, 0]]]})
    shape = spark.createDataFrame([(text,)], "text string").select(g.geometry_from_json(F.col("text")).alias("geometry"))
    plan = agg.geometry_grid(shape.withColumns(g.bounds_of(F.col("geometry"))), "geohash", 4)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    strips = max(i for i, line in enumerate(lines) if "explode(sequence(x0" in line)
    assert any("AS shape" in line and "slope" in line for line in lines[strips:])
