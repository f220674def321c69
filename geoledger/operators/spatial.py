"""Spatial conditions. Bounds decide where they can; the rest is compared with the literal's edges near the row."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoledger.functions.geometry import (
    _let, box_geometry, is_box, literal_bounds, literal_is_box, literal_parts,
)
from geoledger.functions.predicates import covers, intersects, literal_shape, literal_slabs, nearby, shape_of
from geoledger.operators.fields import Fields, holds

BOUNDS = ("minx", "miny", "maxx", "maxy")
RELATIONS = ("intersects", "contains", "within", "disjoint")


def bbox_2d(bbox: list[float]) -> list[float]:
    """Four numbers of a box; of six the heights are dropped."""
    if len(bbox) == 6:
        return [bbox[0], bbox[1], bbox[3], bbox[4]]
    if len(bbox) != 4:
        raise ValueError("a box has four or six numbers")
    return list(bbox)


def box_literal(bbox: list[float]) -> dict[str, Any]:
    x0, y0, x1, y1 = bbox_2d(bbox)
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def boxes_of(bbox: list[float]) -> list[list[float]]:
    """The box, or the two on either side of the antimeridian when its west lies east of its east."""
    x0, y0, x1, y1 = bbox_2d(bbox)
    return [[x0, y0, x1, y1]] if x0 <= x1 else [[x0, y0, 180.0, y1], [-180.0, y0, x1, y1]]


def by_bbox(fields: Fields, bbox: list[float]) -> Column:
    """The row's geometry shares a point with the box, which may lie across the antimeridian."""
    return reduce(Column.__or__, [spatial(fields, "intersects", box_literal(box)) for box in boxes_of(bbox)])


def by_intersects(fields: Fields, geometry: dict[str, Any]) -> Column:
    """The row's geometry shares a point with a GeoJSON geometry."""
    return spatial(fields, "intersects", geometry)


def spatial(fields: Fields, relation: str, geometry: dict[str, Any], name: str = "geometry") -> Column:
    """The row's geometry stands in `relation` to a literal one. Rows without geometry never match.

    The frame carries bounds (minx, miny, maxx, maxy) and, unless all its shapes are boxes, a geometry struct.
    """
    if relation not in RELATIONS:
        raise ValueError(f"unknown spatial relation {relation!r}")
    bounds = [fields.get(part) for part in BOUNDS]
    if None in bounds:
        raise ValueError("the frame has no bounds columns minx, miny, maxx, maxy")
    minx, miny, maxx, maxy = (b.column for b in bounds)
    parts = literal_parts(geometry)
    x0, y0, x1, y1 = (F.lit(v) for v in literal_bounds(parts))

    overlap = (minx <= x1) & (maxx >= x0) & (miny <= y1) & (maxy >= y0)
    inside = (minx >= x0) & (maxx <= x1) & (miny >= y0) & (maxy <= y1)
    around = (minx <= x0) & (maxx >= x1) & (miny <= y0) & (maxy >= y1)
    possible = {"intersects": overlap, "disjoint": overlap, "within": inside, "contains": around}[relation]

    shape = fields.get(name)
    box_literal_ = literal_is_box(parts)
    if shape is None and box_literal_:
        matched = possible
    else:
        geom = shape.column if shape is not None else box_geometry(minx, miny, maxx, maxy)
        compare = {"within": lambda row, given: covers(given, row), "contains": covers}.get(relation, intersects)
        # bounds leave to "contains" only rows that reach around the whole literal
        index = None if relation == "contains" else literal_slabs(parts)
        if index is None:
            related = compare(shape_of(geom), literal_shape(parts))
        else:
            slabs, flip = index
            near = nearby(slabs, *((minx, maxx) if flip else (miny, maxy)))
            related = _let(shape_of(geom, flip), lambda row: _let(near, lambda given: compare(row, given)))

        def exact(wanted: Column) -> Column:
            return F.when(holds(wanted) & geom.isNotNull(), related).otherwise(False)

        if box_literal_ and relation != "contains":
            # bounds decide a shape inside a box, and a shape that is a box itself
            sure = inside | is_box(geom, minx, miny, maxx, maxy)
            matched = possible & (sure | exact(possible & ~sure))
        else:
            matched = possible & exact(possible)
    if relation == "disjoint":
        present = shape.column.isNotNull() if shape is not None else minx.isNotNull()
        return present & ~holds(matched)
    return matched
