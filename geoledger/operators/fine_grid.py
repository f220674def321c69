"""Most frequent cells of a fine grid, found from coarse cells down; cells that can't be among them are never made.

A cell at any level stands for all finest cells in it. Rows that cover it count for each of these (`full`), rows that
only meet it may count (`part`), so a finest cell's count lies between `full` and `full + part`. Once the cells with
the largest `full` hold as many finest cells as are asked for, their least count is a threshold that no result falls
below, and cells whose upper bound lies under it are dropped with their rows. Ties are bounded the same way by the
first and last key of a cell. Covered cells hand their count down as a number; only rows that cross a cell's border
go on into it, cut to the cell, and equal cuts are counted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.functions import grids
from geoledger.functions.predicates import spans_between
from geoledger.session import materialised

RANGE = ("x0", "x1", "y0", "y1")
# First level, and levels between two steps: a cell has 32 or 64 cells of the next step.
FIRST = {"geohash": 3, "geotile": 7}
STEP = {"geohash": 1, "geotile": 3}

_FUNCTIONS = {
    "geohash": (grids.geohash_row, grids.geohash_name, grids.geohash_cell_box),
    "geotile": (grids.geotile_row, grids.geotile_name, grids.geotile_cell_box),
}


def bits(kind: str, level: int) -> tuple[int, int]:
    """Bits of column and row numbers at a level."""
    return grids.geohash_bits(level) if kind == "geohash" else (level, level)


def levels(kind: str, precision: int) -> list[int]:
    """Levels from coarse to the wanted one."""
    found = [precision]
    while found[0] > FIRST[kind]:
        found.insert(0, max(FIRST[kind], found[0] - STEP[kind]))
    return found


def _extreme(low: Column, high: Column, most: bool) -> Column:
    """First or last of the whole numbers between two, in the order of their texts."""
    # in each number of digits the order is that of the numbers
    borders = [F.lit(10 ** d - 1 if most else 10 ** d).cast("long") for d in range(1, 10)]
    texts = [(high if most else low).cast("string"), *[F.when((b >= low) & (b <= high), b.cast("string")) for b in borders]]
    return F.greatest(*texts) if most else F.least(*texts)


def key_bound(kind: str, level: int, precision: int, most: bool) -> Column:
    """First or last key, as text, of the finest cells in the cell (kx, ky)."""
    if kind == "geohash":
        end = grids.GEOHASH_ALPHABET[-1 if most else 0] * (precision - level)
        return F.concat(grids.geohash_name(F.col("kx"), F.col("ky"), level), F.lit(end))
    shift = precision - level
    x, y = (_extreme(F.shiftleft(c, shift), F.shiftleft(F.col(c) + 1, shift) - 1, most) for c in ("kx", "ky"))
    return F.concat_ws("/", F.lit(str(precision)), x, y)


def _meeting(rows: DataFrame, kind: str, level: int, parent: int | None, precision: int, shaped: bool) -> DataFrame:
    """The rows once for each cell (kx, ky) of the level that they meet inside their parent cell; `covers` the whole cell or not."""
    (bx, by), (fx, fy) = bits(kind, level), bits(kind, precision)
    sx, sy = fx - bx, fy - by
    last = level == precision

    def inside(low: str, high: str, shift: int) -> Column:
        # the ranges were cut to the parent cell
        return F.explode(F.sequence(F.shiftright(low, shift), F.shiftright(high, shift)))

    row, _, box = _FUNCTIONS[kind]
    found = rows.withColumn("kx", inside("x0", "x1", sx))
    if shaped:
        left, _, right, _ = box(F.col("kx"), F.lit(0), level)
        border = F.transform("shape", lambda p: F.struct(F.least(p["dim"], F.lit(1)).alias("dim"), p["x"].alias("x"), p["y"].alias("y"), p["edges"].alias("edges")))
        found = found.withColumns({
            "spans": F.when(F.col("shape").isNotNull(), spans_between(F.col("shape"), left, right)),
            "border": F.when(F.col("shape").isNotNull(), spans_between(border, left, right))})
    found = found.withColumn("ky", inside("y0", "y1", sy))
    covers = reduce(Column.__and__, [
        (F.col(low) <= F.shiftleft(c, shift)) & (F.col(high) >= F.shiftleft(F.col(c) + 1, shift) - 1)
        for c, low, high, shift in (("kx", "x0", "x1", sx), ("ky", "y0", "y1", sy))])
    if shaped:
        # a row more on either side before the last level: sums rounded there may differ
        more = 0 if last else 1

        def met(spans: str) -> Column:
            low, high = ("low", "high") if kind == "geohash" else ("high", "low")
            return F.exists(spans, lambda s: F.col("ky").between(row(s[low], level) - more, row(s[high], level) + more))

        plain = F.col("shape").isNull()
        found = found.filter(plain | met("spans"))
        covers = F.when(plain, covers).otherwise(F.lit(True) if last else ~met("border"))
        found = found.withColumn("covers", covers).drop("spans", "border")
    else:
        found = found.withColumn("covers", covers)
    return found


def frequent_cells(rows: DataFrame, kind: str, precision: int, size: int) -> DataFrame:
    """(cx, cy, weight) of cells that include the `size` most frequent ones, larger keys first among equals.

    `rows` has the range of finest cells (x0, x1, y0, y1) under a row's bounds, `weight` rows that share it, and
    `shape` with edges that lead east, null where the row fills its range, if some row doesn't.
    """
    shaped = "shape" in rows.columns
    full: DataFrame | None = None
    parent: int | None = None
    for level in levels(kind, precision):
        (bx, by), (fx, fy) = bits(kind, level), bits(kind, precision)
        sx, sy = fx - bx, fy - by
        met = _meeting(rows, kind, level, parent, precision, shaped)
        stats = met.select("kx", "ky", F.when(F.col("covers"), F.col("weight")).otherwise(0).alias("full"), F.when(F.col("covers"), 0).otherwise(F.col("weight")).alias("part"))
        if full is not None:
            px, py = bits(kind, parent)
            children = full.filter("full > 0").withColumn("kx", F.explode(F.sequence(F.shiftleft("cx", bx - px), F.shiftleft(F.col("cx") + 1, bx - px) - 1)))
            children = children.withColumn("ky", F.explode(F.sequence(F.shiftleft("cy", by - py), F.shiftleft(F.col("cy") + 1, by - py) - 1)))
            stats = stats.unionByName(children.select("kx", "ky", "full", F.lit(0).cast("long").alias("part")))
        stats = stats.groupBy("kx", "ky").agg(F.sum("full").alias("full"), F.sum("part").alias("part"))
        if level == precision:
            return stats.select(F.col("kx").alias("cx"), F.col("ky").alias("cy"), (F.col("full") + F.col("part")).alias("weight"))
        stats = materialised(stats)

        # so many cells hold `size` finest ones
        needed = -(-size // (1 << sx + sy))
        first = stats.select("full", key_bound(kind, level, precision, False).alias("key")).orderBy(F.desc("full"), F.desc("key")).limit(needed)
        mark = first.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("full", "key")).alias("least")).first()
        kept = stats
        if mark["n"] == needed:
            most = F.col("full") + F.col("part")
            at = F.lit(mark["least"]["full"])
            kept = stats.filter((most > at) | (most == at) & (key_bound(kind, level, precision, True) >= F.lit(mark["least"]["key"])))
        full = materialised(kept.select(F.col("kx").alias("cx"), F.col("ky").alias("cy"), "full", "part"))

        crossing = met.filter(~F.col("covers")).join(full.filter("part > 0"), (F.col("kx") == F.col("cx")) & (F.col("ky") == F.col("cy")), "left_semi")
        cut = [
            f(F.col(c), edge).alias(c) for c, f, edge in (
                ("x0", F.greatest, F.shiftleft("kx", sx)), ("x1", F.least, F.shiftleft(F.col("kx") + 1, sx) - 1),
                ("y0", F.greatest, F.shiftleft("ky", sy)), ("y1", F.least, F.shiftleft(F.col("ky") + 1, sy) - 1))]
        plain = crossing.filter(F.col("shape").isNull()) if shaped else crossing
        rows_ = plain.select(*cut, "weight").groupBy(*RANGE).agg(F.sum("weight").alias("weight"))
        if shaped:
            shapes = crossing.filter(F.col("shape").isNotNull()).select(*cut, "weight", "shape")
            rows_ = shapes.unionByName(rows_, allowMissingColumns=True)
        rows, parent = materialised(rows_), level
    raise AssertionError("there is a level")
