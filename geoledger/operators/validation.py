"""Validation as error Columns: null means valid, otherwise the message of the first broken rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.functions.times import parse_utc, rfc3339
from geoledger.operators.fields import Fields, holds
from geoledger.session import materialised

MAX_VERTICES = 5000

# Prefixes and texts of the messages by which errors are grouped.
DATETIME_PREFIX = "Datetime Range Error: "
TOPOLOGY_PREFIX = "Topology Error: "
MSG_NEEDS_BOTH = "If 'datetime' is null, both 'start_datetime' and 'end_datetime' must be set"
MSG_PAIR = "Both 'start_datetime' and 'end_datetime' must be set together, or both must be null"
MSG_SHORT_RING = "Polygon ring must have at least 4 coordinates (closed loop)."
MSG_BOUNDS = "Coordinates out of global WGS84 bounds"
MSG_VERTICES = "Geometry has too many vertices ({}). Maximum allowed is {}."
MSG_JUMP = "Geometry crosses the antimeridian without proper truncation/splitting between longitude {} and {}."
MSG_SCHEMA = "STAC validation failed: {}"


def datetime_error(fields: Fields) -> Column:
    """The five rules on datetime, start_datetime and end_datetime, checked in order.

    Columns may be timestamps or raw text; text must also parse.
    """
    raw, value, shown, unreadable = {}, {}, {}, []
    for name in ("start_datetime", "datetime", "end_datetime"):
        found = fields.get(name)
        column = F.lit(None).cast("timestamp_ntz") if found is None else found.column
        if found is not None and isinstance(found.dtype, T.StringType):
            raw[name] = F.nullif(column, F.lit(""))
            value[name] = parse_utc(raw[name])
            shown[name] = raw[name]
            unreadable.append((raw[name].isNotNull() & value[name].isNull(), F.concat(
                F.lit(f"Invalid ISO 8601 format for '{name}': "), raw[name])))
        else:
            raw[name], value[name], shown[name] = column, column, rfc3339(column)
    start, dt, end = (value[n] for n in ("start_datetime", "datetime", "end_datetime"))
    s, d, e = (shown[n] for n in ("start_datetime", "datetime", "end_datetime"))

    rules = unreadable + [
        (dt.isNull() & (start.isNull() | end.isNull()), F.lit(MSG_NEEDS_BOTH)),
        (start.isNull() != end.isNull(), F.lit(MSG_PAIR)),
        (start > end, F.concat(F.lit("'start_datetime' ("), s, F.lit(") must be <= 'end_datetime' ("), e, F.lit(")"))),
        (start > dt, F.concat(F.lit("'datetime' ("), d, F.lit(") must be >= 'start_datetime' ("), s, F.lit(")"))),
        (dt > end, F.concat(F.lit("'datetime' ("), d, F.lit(") must be <= 'end_datetime' ("), e, F.lit(")"))),
    ]
    error = F.coalesce(*[F.when(broken, message) for broken, message in rules])
    return F.when(error.isNotNull(), F.concat(F.lit(DATETIME_PREFIX), error))


def _filled(message: str, *values: Column) -> Column:
    """The message with its gaps filled."""
    texts = message.split("{}")
    parts = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:]):
        parts += [value.cast("string"), F.lit(text)]
    return F.concat(*parts)


def outside(x: Column, y: Column) -> Column:
    """A position beyond 180 degrees of longitude or 90 of latitude."""
    return ~(x.between(-180, 180) & y.between(-90, 90))


def bounds_error(points: Column) -> Column:
    """First point outside the globe."""
    bad = F.get(F.filter(points, lambda p: outside(p["x"], p["y"])), 0)
    return F.when(bad.isNotNull(), F.concat(
        F.lit(f"{MSG_BOUNDS}: ["), bad["x"].cast("string"), F.lit(", "),
        bad["y"].cast("string"), F.lit("]")))


def ring_error(ring: Column, max_vertices: int = MAX_VERTICES) -> Column:
    """A ring is closed by four points or more, not longer than the limit, and never jumps over 180 degrees."""
    size = F.size(ring)
    steps = F.zip_with(F.slice(ring, 1, F.greatest(size - 1, F.lit(0))), F.slice(ring, 2, F.greatest(size, F.lit(1))),
                       lambda p, q: F.struct(p["x"].alias("a"), q["x"].alias("b")))
    jump = F.get(F.filter(steps, lambda s: F.abs(s["a"] - s["b"]) > 180), 0)
    return (
        F.when(size < 4, F.lit(MSG_SHORT_RING))
        .when(size > max_vertices, _filled(MSG_VERTICES, size, F.lit(max_vertices)))
        .when(jump.isNotNull(), _filled(MSG_JUMP, jump["a"], jump["b"]))
    )


def topology_error(geometry: Column, max_vertices: int = MAX_VERTICES) -> Column:
    """Bounds of every point, then every ring of polygon parts. Null geometry is valid."""
    parts = geometry["parts"]
    points = F.flatten(F.flatten(F.transform(parts, lambda p: p["rings"])))
    rings = F.flatten(F.transform(F.filter(parts, lambda p: p["dim"] == 2), lambda p: p["rings"]))
    broken = F.get(F.filter(F.transform(rings, lambda r: ring_error(r, max_vertices)), lambda m: m.isNotNull()), 0)
    error = F.coalesce(bounds_error(points), broken)
    return F.when(error.isNotNull(), F.concat(F.lit(TOPOLOGY_PREFIX), error))


@dataclass(frozen=True)
class Rule:
    """A member of the raw document: its path, the JSON kinds it may have, and whether it must be there."""

    path: str
    kinds: tuple[str, ...]
    required: bool = True


# The members of the core item.
ITEM_RULES = (
    Rule("$.type", ("string",)),
    Rule("$.stac_version", ("string",)),
    Rule("$.id", ("string",)),
    Rule("$.geometry", ("object", "null")),
    Rule("$.bbox", ("array",), required=False),
    Rule("$.properties", ("object",)),
    Rule("$.properties.datetime", ("string", "null")),
    Rule("$.links", ("array",)),
    Rule("$.assets", ("object",)),
    Rule("$.collection", ("string",), required=False),
    Rule("$.stac_extensions", ("array",), required=False),
)


def json_kind(document: Column, path: str) -> Column:
    """string, number, boolean, array, object or null of a VARIANT member; SQL null when it is absent."""
    member = F.try_variant_get(document, path, "variant")
    kind = F.schema_of_variant(member)
    return F.when(member.isNotNull(), F.when(F.is_variant_null(member), "null")
                  .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
                  .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number"))


def schema_error(document: Column, rules: Sequence[Rule] = ITEM_RULES) -> Column:
    """First rule that a raw document (VARIANT) breaks."""
    checks = []
    for rule in rules:
        name = rule.path.removeprefix("$.")
        kind = json_kind(document, rule.path)
        if rule.required:
            checks.append(F.when(kind.isNull(), F.lit(MSG_SCHEMA.format(f"{name} is required"))))
        checks.append(F.when(kind.isNotNull() & ~kind.isin(*rule.kinds), F.lit(
            MSG_SCHEMA.format(f"{name} must be {' or '.join(rule.kinds)}"))))
    feature = F.try_variant_get(document, "$.type", "string")
    checks.append(F.when(holds(feature != "Feature"), F.lit(MSG_SCHEMA.format("type must be Feature"))))
    return F.coalesce(*checks)


def item_error(
    df: DataFrame, document: str | None = None, dates: bool = True, topology: bool = True
) -> Column:
    """Schema, then time, then topology; each rule only speaks where the earlier ones were silent."""
    errors = []
    if document:
        errors.append(schema_error(F.col(document)))
    if dates:
        errors.append(datetime_error(Fields.of(df)))
    if topology and "geometry" in df.columns:
        errors.append(topology_error(F.col("geometry")))
    elif topology and "minx" in df.columns:
        low = outside(F.col("minx"), F.col("miny")) | outside(F.col("maxx"), F.col("maxy"))
        errors.append(F.when(holds(low), F.lit(TOPOLOGY_PREFIX + MSG_BOUNDS)))
    return F.coalesce(*errors, F.lit(None).cast("string"))


def split_valid(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their `error`)."""
    marked = df.withColumn("error", error)
    return marked.filter(F.col("error").isNull()).drop("error"), marked.filter(F.col("error").isNotNull())


def error_groups(invalid: DataFrame) -> DataFrame:
    """Items per message."""
    return invalid.groupBy("error").agg(F.count(F.lit(1)).alias("items"))


def errors_with_ids(invalid: DataFrame) -> DataFrame:
    """(error, items, collection, id): every invalid item beside its message and the number of items that share it.

    Rows stay rows: a message of a third of all items is no cell.
    """
    rows = materialised(invalid.select("error", "collection", "id"))
    return rows.join(error_groups(rows), "error")


class BatchRejected(ValueError):
    """Too many errors: nothing was written."""


def check_threshold(errors: int, max_errors: int = 0, strict: bool = False) -> None:
    """Refuse a batch in strict mode on any error, otherwise when errors exceed a positive limit."""
    if strict and errors:
        raise BatchRejected(f"{errors} items failed validation")
    if max_errors and errors > max_errors:
        raise BatchRejected(f"{errors} items failed validation, more than {max_errors}")
