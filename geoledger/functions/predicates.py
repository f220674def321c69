"""Exact spatial relations as columns: everything runs in the row, on arrays of edges.

A shape is an array of parts (dim, x, y, edges): the dimension, the first point, and the edges of all rings. Sets are
closed: touching counts. Polygon interiors follow the even-odd rule per part. A shape lies within another when no
point of it is outside: its edges are cut where the other's cross them, and the middles of the pieces are looked up.

A literal is cut into slabs on the driver, so that a row meets the edges near it only (`literal_slabs`, `nearby`).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoledger.functions.geometry import EPS, Part, _let

EDGE = "struct<ax:double,ay:double,bx:double,by:double>"
SHAPE = f"array<struct<dim:int,x:double,y:double,edges:array<{EDGE}>>>"
SLABS = (
    "array<struct<dim:int,x:double,y:double,low:double,high:double,width:int,coarse:array<double>,breaks:array<double>,"
    f"starts:array<array<{EDGE}>>,passing:array<array<{EDGE}>>>>"
)
# Edges that start in a slab, and entries of edges in later slabs for each edge, that a literal's slabs aim at.
SLAB_EDGES = 16
SLAB_REPEATS = 4
# Degrees by which a row's range is widened: more than any tolerance of the relations.
MARGIN = 1e-6


def shape_of(geometry: Column, flip: bool = False) -> Column:
    """Parts of a geometry column with their edges; `flip` swaps the axes, which changes no relation."""
    first_axis, second_axis = ("y", "x") if flip else ("x", "y")

    def edges(ring: Column) -> Column:
        def edge(q: Column, i: Column) -> Column:
            p = F.get(ring, i)
            return F.struct(
                p[first_axis].alias("ax"), p[second_axis].alias("ay"), q[first_axis].alias("bx"), q[second_axis].alias("by"))

        return F.transform(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), edge)

    def part(p: Column) -> Column:
        first = F.get(F.get(p["rings"], 0), 0)
        found = F.when(p["dim"] > 0, F.flatten(F.transform(p["rings"], edges))).otherwise(F.array().cast(f"array<{EDGE}>"))
        return F.struct(p["dim"].alias("dim"), first[first_axis].alias("x"), first[second_axis].alias("y"), found.alias("edges"))

    return F.transform(geometry["parts"], part)


def _literal_edges(dim: int, rings: Sequence[np.ndarray]) -> np.ndarray:
    """(ax, ay, bx, by) of all edges of a part."""
    none = np.empty((0, 4))
    return np.concatenate([none, *[np.hstack([r[:-1], r[1:]]) for r in (rings if dim else [])]])


def _edge_rows(edges: np.ndarray) -> list[dict[str, float]]:
    return [dict(zip(("ax", "ay", "bx", "by"), e)) for e in edges.tolist()]


def literal_shape(parts: Sequence[Part]) -> Column:
    """A literal geometry as a constant shape."""
    rows = []
    for dim, rings in parts:
        x, y = rings[0][0].tolist()
        rows.append({"dim": dim, "x": x, "y": y, "edges": _edge_rows(_literal_edges(dim, rings))})
    return F.from_json(F.lit(json.dumps(rows)), SHAPE)


def _slab_breaks(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ends of slabs in which about as many edges start. Where edges run through many slabs the slabs get fewer."""
    step = SLAB_EDGES
    while True:
        breaks = np.unique(np.sort(low)[step::step])
        runs = np.searchsorted(breaks, high, "right") - np.searchsorted(breaks, low, "right")
        if runs.sum() <= SLAB_REPEATS * len(low):
            return breaks
        step *= 2


def _slab_part(dim: int, rings: Sequence[np.ndarray]) -> dict:
    edges = _literal_edges(dim, rings)
    ends = edges[:, [1, 3]]
    low, high = ends.min(axis=1), ends.max(axis=1)
    breaks = _slab_breaks(low, high)
    first, last = (np.searchsorted(breaks, v, "right") for v in (low, high))
    starts = [_edge_rows(edges[first == k]) for k in range(len(breaks) + 1)]
    passing = [_edge_rows(edges[(first < k) & (last >= k)]) for k in range(len(breaks) + 1)]
    width = max(1, int(np.ceil(np.sqrt(len(breaks)))))
    x, y = rings[0][0].tolist()
    levels = np.concatenate([r[:, 1] for r in rings])
    return {
        "dim": dim, "x": x, "y": y, "low": float(levels.min()), "high": float(levels.max()), "width": width,
        "coarse": breaks[width - 1::width].tolist(), "breaks": breaks.tolist(), "starts": starts, "passing": passing,
    }


def literal_slabs(parts: Sequence[Part]) -> tuple[Column, bool] | None:
    """A literal geometry as a constant index of its edges, and whether its axes are swapped; None where no part has two slabs.

    Each part is cut into slabs of latitude. An edge is listed where it starts, and again in later slabs that it runs
    through. The axes are swapped where slabs of longitude come out finer, as for a comb of meridians. A star whose edges
    all run through both ranges keeps few slabs and is compared nearly edge by edge.
    """
    choices = []
    for flip in (False, True):
        turned = [(dim, [r[:, ::-1] for r in rings] if flip else rings) for dim, rings in parts]
        choices.append([_slab_part(dim, rings) for dim, rings in turned])

    def met(part_rows: list[dict]) -> float:
        """Edges listed in a slab, over all slabs and parts: those that a low row compares itself with."""
        return sum(sum(map(len, p["starts"])) + sum(map(len, p["passing"])) for p in part_rows) / sum(len(p["starts"]) for p in part_rows)

    flip = met(choices[1]) < met(choices[0])
    if not any(p["breaks"] for p in choices[flip]):
        return None
    return F.from_json(F.lit(json.dumps(choices[flip])), SLABS), flip


def nearby(slabs: Column, low: Column, high: Column) -> Column:
    """The shape of a literal as far as it matters to a row that lies between `low` and `high`.

    Every edge with a point in that range is there once: those running through the first slab, and those that start in
    one of them. A ray to the right meets no others, so points of the row find the same parity as on the whole literal.
    """

    def slab(p: Column, at: Column) -> Column:
        def passed(ends: Column) -> Column:
            return F.size(F.filter(ends, lambda end: end <= at))

        return _let(passed(p["coarse"]) * p["width"], lambda done: done + passed(F.slice(p["breaks"], done + 1, p["width"])))

    def part(p: Column) -> Column:
        def edges(i: Column) -> Column:
            return F.concat(F.get(p["passing"], i), F.flatten(F.slice(p["starts"], i + 1, slab(p, high + MARGIN) - i + 1)))

        return F.struct(p["dim"].alias("dim"), p["x"].alias("x"), p["y"].alias("y"), _let(slab(p, low - MARGIN), edges).alias("edges"))

    return F.transform(F.filter(slabs, lambda p: (p["low"] <= high + MARGIN) & (p["high"] >= low - MARGIN)), part)


def _divided(a: Column, b: Column) -> Column:
    """a / b, or a where b is 0; callers rule that case out."""
    return a / F.when(b == 0, F.lit(1.0)).otherwise(b)


def _near(x: Column, y: Column, e: Column) -> Column:
    """The point lies on the edge."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    wx, wy = x - e["ax"], y - e["ay"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _divided(wx * dx + wy * dy, dx * dx + dy * dy)))
    return _let(t, lambda t: (wx - t * dx) * (wx - t * dx) + (wy - t * dy) * (wy - t * dy) <= EPS * EPS)


def _odd(x: Column, y: Column, edges: Column) -> Column:
    """A ray to the right of the point crosses the edges an odd number of times."""

    def crossed(e: Column) -> Column:
        straddles = (e["ay"] > y) != (e["by"] > y)
        at = _divided((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]
        return straddles & (x < at)

    return F.size(F.filter(edges, crossed)) % 2 == 1


def holds_point(shape: Column, x: Column, y: Column) -> Column:
    """The point lies in the closed set."""

    def part(p: Column) -> Column:
        spot = (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y) <= EPS * EPS
        edge = F.exists(p["edges"], lambda e: _near(x, y, e))
        return F.when(p["dim"] == 0, spot).otherwise(edge | ((p["dim"] == 2) & _odd(x, y, p["edges"])))

    return F.exists(shape, part)


def _turn(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _touch(e: Column, f: Column) -> Column:
    """Two edges share a point."""
    ux, uy = e["bx"] - e["ax"], e["by"] - e["ay"]
    vx, vy = f["bx"] - f["ax"], f["by"] - f["ay"]
    c_side = _turn(ux, uy, f["ax"] - e["ax"], f["ay"] - e["ay"])
    d_side = _turn(ux, uy, f["bx"] - e["ax"], f["by"] - e["ay"])
    p_side = _turn(vx, vy, e["ax"] - f["ax"], e["ay"] - f["ay"])
    q_side = _turn(vx, vy, e["bx"] - f["ax"], e["by"] - f["ay"])
    apart = (F.greatest(e["ax"], e["bx"]) < F.least(f["ax"], f["bx"]) - EPS) | (F.least(e["ax"], e["bx"]) > F.greatest(f["ax"], f["bx"]) + EPS) | (
        F.greatest(e["ay"], e["by"]) < F.least(f["ay"], f["by"]) - EPS) | (F.least(e["ay"], e["by"]) > F.greatest(f["ay"], f["by"]) + EPS)
    proper = (c_side * d_side < 0) & (p_side * q_side < 0)
    return ~apart & (proper | _near(e["ax"], e["ay"], f) | _near(e["bx"], e["by"], f) | _near(f["ax"], f["ay"], e) | _near(f["bx"], f["by"], e))


def _edges(shape: Column) -> Column:
    return F.flatten(F.transform(shape, lambda p: p["edges"]))


def intersects(a: Column, b: Column) -> Column:
    """The shapes share a point. Without a shared boundary point, one of them holds a point of the other."""
    heads = F.exists(a, lambda p: holds_point(b, p["x"], p["y"])) | F.exists(b, lambda p: holds_point(a, p["x"], p["y"]))
    met = _let(_edges(b), lambda f: F.exists(_edges(a), lambda e: F.exists(f, lambda g: _touch(e, g))))
    return heads | met


def _probes(e: Column, cutters: Column) -> Column:
    """The ends of an edge, and the middles of the pieces into which other edges cut it."""
    ux, uy = e["bx"] - e["ax"], e["by"] - e["ay"]
    length2 = ux * ux + uy * uy

    def cuts(f: Column) -> Column:
        vx, vy = f["bx"] - f["ax"], f["by"] - f["ay"]
        wx, wy = f["ax"] - e["ax"], f["ay"] - e["ay"]
        turn = _turn(ux, uy, vx, vy)
        s = _divided(_turn(wx, wy, ux, uy), turn)
        crossing = F.when((turn != 0) & (s >= -EPS) & (s <= 1 + EPS), _divided(_turn(wx, wy, vx, vy), turn))

        def foot(x: Column, y: Column) -> Column:
            t = _divided((x - e["ax"]) * ux + (y - e["ay"]) * uy, length2)
            ox, oy = x - e["ax"] - t * ux, y - e["ay"] - t * uy
            return F.when(ox * ox + oy * oy <= EPS * EPS, t)

        return F.array(crossing, foot(f["ax"], f["ay"]), foot(f["bx"], f["by"]))

    inner = F.filter(F.flatten(F.transform(cutters, cuts)), lambda t: t.isNotNull() & (t > 0) & (t < 1))
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))

    def middles(ts: Column) -> Column:
        pairs = F.transform(F.slice(ts, 2, F.size(ts)), lambda t, i: F.struct(F.get(ts, i).alias("a"), t.alias("b")))
        # pieces shorter than the tolerance are rounding, not geometry
        real = F.filter(pairs, lambda p: (p["b"] - p["a"]) * (p["b"] - p["a"]) * length2 > 16 * EPS * EPS)
        at = F.transform(real, lambda p: (p["a"] + p["b"]) / 2)
        return F.transform(F.concat(F.array(F.lit(0.0), F.lit(1.0)), at), lambda t: F.struct(
            (e["ax"] + t * ux).alias("x"), (e["ay"] + t * uy).alias("y")))

    return _let(stops, middles)


def covers(outer: Column, inner: Column) -> Column:
    """No point of `inner` lies outside `outer`."""

    def strictly(p: Column, x: Column, y: Column) -> Column:
        return _odd(x, y, p["edges"]) & ~F.exists(p["edges"], lambda e: _near(x, y, e))

    def with_edges(outer_edges: Column) -> Column:
        def part(p: Column) -> Column:
            border = F.forall(p["edges"], lambda e: F.forall(_probes(e, outer_edges), lambda q: holds_point(outer, q["x"], q["y"])))
            # a hole or notch of the outer shape must not open inside the inner polygon
            opened = F.exists(outer, lambda o: (o["dim"] == 2) & F.exists(
                o["edges"], lambda e: F.exists(_probes(e, p["edges"]), lambda q: strictly(p, q["x"], q["y"]))))
            filled = F.exists(outer, lambda o: o["dim"] == 2) & ~opened
            # most rows end here: a corner outside, or no boundary that meets another
            corners = F.forall(p["edges"], lambda e: holds_point(outer, e["ax"], e["ay"]))
            met = F.exists(p["edges"], lambda e: F.exists(outer_edges, lambda f: _touch(e, f)))
            around = F.exists(outer, lambda o: (o["dim"] == 2) & F.exists(o["edges"], lambda e: strictly(p, e["ax"], e["ay"])))
            return (
                F.when(p["dim"] == 0, holds_point(outer, p["x"], p["y"]))
                .when(~corners, F.lit(False))
                .when(~met, (p["dim"] < 2) | ~around)
                .otherwise(border & ((p["dim"] < 2) | filled))
            )

        return F.forall(inner, part)

    return (F.size(inner) > 0) & _let(_edges(outer), with_edges)


def eastward(shape: Column) -> Column:
    """The shape with edges that lead east and their slopes, as `spans_between` wants them: the same for every strip, so made once per row."""

    def turned(e: Column) -> Column:
        back = e["ax"] > e["bx"]
        ends = {"ax": ("ax", "bx"), "ay": ("ay", "by"), "bx": ("bx", "ax"), "by": ("by", "ay")}
        return F.struct(*[F.when(back, e[there]).otherwise(e[here]).alias(n) for n, (here, there) in ends.items()])

    def sloped(e: Column) -> Column:
        return e.withField("slope", _divided(e["by"] - e["ay"], e["bx"] - e["ax"]))

    return F.transform(shape, lambda p: F.struct(
        p["dim"].alias("dim"), p["x"].alias("x"), p["y"].alias("y"), F.transform(F.transform(p["edges"], turned), sloped).alias("edges")))


def strip_spans(shape: Column, left: Column, right: Column) -> Column:
    """(low, high): latitude spans that a shape covers between two longitudes; spans may overlap."""
    return spans_between(eastward(shape), left, right)


def spans_between(shape: Column, left: Column, right: Column) -> Column:
    """`strip_spans` of a shape whose edges lead east.

    A piece of a polygon in a strip is bounded by edges clipped to the strip and by the strip's own lines, and that
    outline is closed: the spans of the clipped edges and of the interior on both lines are all.
    """

    def span(low: Column, high: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"))

    def height(e: Column, x: Column) -> Column:
        return e["ay"] + e["slope"] * (x - e["ax"])

    def inside(edges: Column, x: Column) -> Column:
        # half-open in longitude, so that a vertex on the line counts once and crossings come in pairs
        cut = F.filter(edges, lambda e: (e["ax"] <= x) & (e["bx"] > x))
        at = F.sort_array(F.array_compact(F.transform(cut, lambda e: height(e, x))))
        paired = _let(at, lambda ys: F.filter(F.transform(ys, lambda y, i: F.struct(
            y.alias("low"), F.get(ys, i + 1).alias("high"), i.alias("i"))), lambda s: (s["i"] % 2 == 0) & s["high"].isNotNull()))
        return F.transform(paired, lambda s: span(s["low"], s["high"]))

    none = F.array().cast("array<struct<low:double,high:double>>")

    def between(strip: Column) -> Column:
        west, east = strip["left"], strip["right"]

        def clipped(e: Column) -> Column:
            first = F.when(e["ax"] < west, height(e, west)).otherwise(e["ay"])
            last = F.when(e["bx"] > east, height(e, east)).otherwise(e["by"])
            return span(first, last)

        def part(p: Column) -> Column:
            def spans(edges: Column) -> Column:
                border = F.transform(F.transform(edges, clipped), lambda s: span(F.least(s["low"], s["high"]), F.greatest(s["low"], s["high"])))
                lines = F.when(p["dim"] == 2, F.concat(inside(edges, west), inside(edges, east))).otherwise(none)
                return F.concat(border, lines)

            point = F.when((p["x"] >= west) & (p["x"] <= east), F.array(span(p["y"], p["y"]))).otherwise(none)
            near = F.filter(p["edges"], lambda e: (e["ax"] <= east) & (e["bx"] >= west))
            return F.when(p["dim"] == 0, point).otherwise(_let(near, spans))

        return F.flatten(F.transform(shape, part))

    # the lines' expressions are computed once, not for every edge
    return _let(F.struct(left.alias("left"), right.alias("right")), between)
