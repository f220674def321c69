"""Grid cells of a point and of a box, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the base-32 alphabet of geohash.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# Fixed value: the largest latitude of a square web-mercator map.
MERCATOR_LAT = 85.0511287798066

MAX_GEOHASH = 12
MAX_GEOTILE = 29


def _cell(value: Column, cells: int) -> Column:
    """Cell number of a 0..1 position, the last cell closed."""
    number = F.floor(value * F.lit(float(cells))).cast("long")
    return F.least(F.greatest(number, F.lit(0).cast("long")), F.lit(cells - 1).cast("long"))


def geohash_bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and of latitude in a geohash of this length."""
    bits = 5 * precision
    return bits - bits // 2, bits // 2


def geohash_column(lon: Column, precision: int) -> Column:
    return _cell((lon + F.lit(180.0)) / F.lit(360.0), 1 << geohash_bits(precision)[0])


def geohash_row(lat: Column, precision: int) -> Column:
    return _cell((lat + F.lit(90.0)) / F.lit(180.0), 1 << geohash_bits(precision)[1])


def geohash_name(column: Column, row: Column, precision: int) -> Column:
    """Text of a geohash cell from its column and row numbers: bits alternate, longitude first."""
    x_bits, y_bits = geohash_bits(precision)
    chars = []
    for char in range(precision):
        digit = F.lit(0).cast("long")
        for place in range(5):
            bit = 5 * char + place
            source, shift = (column, x_bits - 1 - bit // 2) if bit % 2 == 0 else (row, y_bits - 1 - bit // 2)
            digit = digit + F.shiftleft(F.shiftright(source, shift).bitwiseAND(F.lit(1)), 4 - place)
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def geohash(lon: Column, lat: Column, precision: int) -> Column:
    """Geohash of a point."""
    return geohash_name(geohash_column(lon, precision), geohash_row(lat, precision), precision)


def geotile_column(lon: Column, zoom: int) -> Column:
    return _cell((lon + F.lit(180.0)) / F.lit(360.0), 1 << zoom)


def geotile_row(lat: Column, zoom: int) -> Column:
    """Row number from the north."""
    sine = F.sin(F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_LAT)), F.lit(MERCATOR_LAT))))
    return _cell(
        F.lit(0.5) - F.ln((F.lit(1.0) + sine) / (F.lit(1.0) - sine)) / F.lit(4.0 * math.pi), 1 << zoom
    )


def geotile_name(column: Column, row: Column, zoom: int) -> Column:
    return F.concat_ws("/", F.lit(str(zoom)), column.cast("string"), row.cast("string"))


def geotile(lon: Column, lat: Column, zoom: int) -> Column:
    """`z/x/y` of a point."""
    return geotile_name(geotile_column(lon, zoom), geotile_row(lat, zoom), zoom)


def geohash_cell_box(column: Column, row: Column, precision: int) -> tuple[Column, Column, Column, Column]:
    x_bits, y_bits = geohash_bits(precision)
    width, height = F.lit(360.0 / (1 << x_bits)), F.lit(180.0 / (1 << y_bits))
    return (
        column * width - F.lit(180.0), row * height - F.lit(90.0),
        (column + 1) * width - F.lit(180.0), (row + 1) * height - F.lit(90.0),
    )


def geotile_cell_box(column: Column, row: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    side = 1 << zoom
    width = F.lit(360.0 / side)

    def latitude(edge: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * edge / F.lit(float(side))))))

    # the map's last rows reach on to the poles
    south = F.when(row + 1 >= side, F.lit(-90.0)).otherwise(latitude(row + 1))
    north = F.when(row <= 0, F.lit(90.0)).otherwise(latitude(row))
    return column * width - F.lit(180.0), south, (column + 1) * width - F.lit(180.0), north


def hilbert_key(lon: Column, lat: Column, bits: int = 16) -> Column:
    """Place of a position along a Hilbert curve over the globe of 2^bits by 2^bits cells: neighbours on it are neighbours on the map.

    Every step goes into one of four quarters and turns or mirrors the rest of the position, as the curve does there.
    """
    start = F.struct(
        _cell((lon + 180.0) / 360.0, 1 << bits).alias("x"), _cell((lat + 90.0) / 180.0, 1 << bits).alias("y"), F.lit(0).cast("long").alias("key"))

    def step(at: Column, bit: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        east, north = at["x"] >= side, at["y"] >= side
        quarter = F.when(east & north, 2).when(east, 3).when(north, 1).otherwise(0)
        # the position within its quarter
        x, y = at["x"] - F.when(east, side).otherwise(0), at["y"] - F.when(north, side).otherwise(0)
        last = side - 1
        return F.struct(
            F.when(north, x).when(east, last - y).otherwise(y).alias("x"), F.when(north, y).when(east, last - x).otherwise(x).alias("y"),
            (at["key"] * 4 + quarter).cast("long").alias("key"))

    key = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda at: at["key"])
    return F.when(lon.isNotNull() & lat.isNotNull(), key)
