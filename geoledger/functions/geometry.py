"""Geometries as Spark structs, and literal geometries.

A geometry is a list of parts; a part has a dimension (0 point, 1 line, 2 polygon) and rings of points. All
sets are closed: touching counts as sharing a point, and a shape lies within another when none of it is
outside. Polygon interiors follow the even-odd rule per part.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_TYPE = "struct<x:double,y:double>"
PARTS_TYPE = f"array<struct<dim:int,rings:array<array<{POINT_TYPE}>>>>"
GEOMETRY_TYPE = f"struct<type:string,parts:{PARTS_TYPE}>"

# Distance in degrees under which a point counts as lying on a line.
EPS = 1e-9

Part = tuple[int, list[np.ndarray]]


# ---------------------------------------------------------------- columns


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), 0)


def _point(xy: Column) -> Column:
    return F.struct(xy.getItem(0).alias("x"), xy.getItem(1).alias("y"))


def _ring(points: Column) -> Column:
    return F.transform(points, _point)


def _part(dim: int, rings: Column) -> Column:
    return F.struct(F.lit(dim).alias("dim"), rings.alias("rings"))


def _members(text: Column) -> Column:
    """Type, raw coordinates and raw member geometries of a GeoJSON text."""
    return F.from_json(text, "type string, coordinates string, geometries array<string>")


def _parts_of(geometry: Column) -> Column:
    """Parts of one geometry that is not a collection."""
    kind, raw = geometry["type"], geometry["coordinates"]

    def nested(depth: int) -> Column:
        return F.from_json(raw, "array<" * depth + "double" + ">" * depth)

    return (
        F.when(kind == "Point", _let(nested(1), lambda p: F.array(_part(0, F.array(F.array(_point(p)))))))
        .when(kind == "MultiPoint", F.transform(nested(2), lambda p: _part(0, F.array(F.array(_point(p))))))
        .when(kind == "LineString", F.array(_part(1, F.array(_ring(nested(2))))))
        .when(kind == "MultiLineString", F.transform(nested(3), lambda line: _part(1, F.array(_ring(line)))))
        .when(kind == "Polygon", F.array(_part(2, F.transform(nested(3), _ring))))
        .when(kind == "MultiPolygon", F.transform(nested(4), lambda poly: _part(2, F.transform(poly, _ring))))
    )


def geometry_from_json(text: Column) -> Column:
    """GeoJSON text to a geometry struct; null for null or unknown shapes."""

    def build(geometry: Column) -> Column:
        inner = F.flatten(F.transform(geometry["geometries"], lambda g: _let(_members(g), _parts_of)))
        parts = F.when(geometry["type"] == "GeometryCollection", inner).otherwise(_parts_of(geometry))
        made = _let(parts, lambda p: F.when(
            p.isNotNull(), F.struct(geometry["type"].alias("type"), p.alias("parts")).cast(GEOMETRY_TYPE)))
        return F.when(geometry["type"].isNotNull(), made)

    return _let(_members(text), build)


def bbox_polygon(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Closed ring of a box, counter-clockwise from the lower left corner."""
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def box_geometry(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A box as a geometry: a point when it has no extent, else a polygon."""
    point = F.struct(F.lit("Point").alias("type"), F.array(_part(0, F.array(F.array(
        F.struct(minx.alias("x"), miny.alias("y")))))).alias("parts")).cast(GEOMETRY_TYPE)
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(_part(2, F.array(
        bbox_polygon(minx, miny, maxx, maxy)))).alias("parts")).cast(GEOMETRY_TYPE)
    return F.when(minx.isNotNull(), F.when((minx == maxx) & (miny == maxy), point).otherwise(polygon))


def points_of(geometry: Column) -> Column:
    """All points of a geometry in one array."""
    return F.flatten(F.flatten(F.transform(geometry["parts"], lambda p: p["rings"])))


def bounds_of(geometry: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy of a geometry."""
    points = points_of(geometry)
    return {
        "minx": F.array_min(points["x"]),
        "miny": F.array_min(points["y"]),
        "maxx": F.array_max(points["x"]),
        "maxy": F.array_max(points["y"]),
    }


def is_box(geometry: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The geometry fills its bounds: a point, or one ring around the four corners. Never null."""
    parts = geometry["parts"]
    first = F.get(parts, 0)
    ring = F.get(first["rings"], 0)
    a, b, c = (F.get(ring, n) for n in range(3))

    def side(p: Column, q: Column) -> Column:
        return (p["x"] == q["x"]) != (p["y"] == q["y"])

    corners = F.forall(ring, lambda p: p["x"].isin(minx, maxx) & p["y"].isin(miny, maxy))
    # four distinct corners whose first two steps run along the sides go around the box
    rectangle = (
        (first["dim"] == 2) & (F.size(parts) == 1) & (F.size(first["rings"]) == 1) & (F.size(ring) == 5)
        & (F.size(F.array_distinct(ring)) == 4) & side(a, b) & side(b, c) & corners
    )
    return F.coalesce((geometry["type"] == "Point") | rectangle, F.lit(False))


# ---------------------------------------------------------------- literals


def normalise_literal(geometry: Any) -> dict[str, Any]:
    """A filter's geometry as GeoJSON. Call form: `{"op": "polygon" | "point" | "linestring", "args": [...]}`.

    A polygon's argument may be a list of rings, one bare ring, or a flat list of numbers taken in pairs.
    """
    if not isinstance(geometry, dict):
        raise ValueError(f"not a geometry: {geometry!r}")
    if "type" in geometry and ("coordinates" in geometry or "geometries" in geometry):
        return geometry
    op, args = geometry.get("op"), geometry.get("args") or []
    if op == "point" and len(args) >= 2:
        return {"type": "Point", "coordinates": list(args[:2])}
    if op == "linestring" and args:
        return {"type": "LineString", "coordinates": args[0]}
    if op == "polygon" and args and isinstance(args[0], list) and args[0]:
        rings = args[0]
        if not isinstance(rings[0], list):
            if len(rings) < 6 or len(rings) % 2:
                raise ValueError("a flat polygon needs at least three coordinate pairs")
            rings = [[list(pair) for pair in zip(rings[::2], rings[1::2])]]
        elif not isinstance(rings[0][0], list):
            rings = [rings]
        return {"type": "Polygon", "coordinates": rings}
    raise ValueError(f"not a geometry: {geometry!r}")


def literal_parts(geometry: dict[str, Any]) -> list[Part]:
    """GeoJSON to (dimension, rings) parts; heights are dropped."""
    geometry = normalise_literal(geometry)
    kind = geometry["type"].lower()
    if kind == "geometrycollection":
        return [part for member in geometry["geometries"] for part in literal_parts(member)]
    coords = geometry["coordinates"]

    def ring(points: list) -> np.ndarray:
        return np.array([p[:2] for p in points], dtype=float).reshape(-1, 2)

    shapes = {
        "point": lambda: [(0, [ring([coords])])],
        "multipoint": lambda: [(0, [ring([p])]) for p in coords],
        "linestring": lambda: [(1, [ring(coords)])],
        "multilinestring": lambda: [(1, [ring(line)]) for line in coords],
        "polygon": lambda: [(2, [ring(r) for r in coords])],
        "multipolygon": lambda: [(2, [ring(r) for r in poly]) for poly in coords],
    }
    if kind not in shapes:
        raise ValueError(f"unknown geometry type {geometry['type']!r}")
    return shapes[kind]()


def literal_bounds(parts: list[Part]) -> tuple[float, float, float, float]:
    points = np.concatenate([r for _, rings in parts for r in rings])
    (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
    return float(x0), float(y0), float(x1), float(y1)


def literal_is_box(parts: list[Part]) -> bool:
    """True when the literal is one point or one axis-aligned rectangle: bounds then decide everything."""
    if len(parts) != 1 or len(parts[0][1]) != 1:
        return False
    dim, (ring,) = parts[0][0], parts[0][1]
    if dim == 0:
        return True
    x0, y0, x1, y1 = literal_bounds(parts)
    corners = {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}
    steps = np.diff(ring, axis=0)
    return (
        dim == 2 and len(ring) == 5 and {tuple(p) for p in ring.tolist()} == corners
        and bool(np.all((steps == 0).any(axis=1)))
    )
