"""Field selection of a result: dotted paths with `*`, resolved on the schema into a pruned projection."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.functions.geometry import bbox_polygon
from geoledger.functions.times import ts_lit

Paths = list[list[str]]


class _Wild(list):
    """What is left of a path that had a wildcard: it never matches inside a plain value."""


def _split(paths: Sequence[str]) -> Paths:
    return [(_Wild if "*" in p else list)(p.split(".")) for p in paths]


def parse_fields(items: Sequence[str]) -> tuple[list[str], list[str]]:
    """`+a`, `a` to include, `-b` to exclude."""
    include = [s.lstrip("+") for s in items if not s.startswith("-")]
    return include, [s[1:] for s in items if s.startswith("-")]


def _matches(pattern: str, name: str) -> bool:
    return re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), name) is not None


def _like(pattern: str, key: Column) -> Column:
    if "*" not in pattern:
        return key == F.lit(pattern)
    return key.rlike("^" + re.escape(pattern).replace(r"\*", ".*") + "$")


def _any(patterns: Sequence[str], key: Column) -> Column:
    condition = F.lit(False)
    for pattern in patterns:
        condition = condition | _like(pattern, key)
    return condition


def _tails(name: str, paths: Paths) -> Paths:
    return [type(p)(p[1:]) for p in paths if _matches(p[0], name)]


def _include(column: Column, dtype: T.DataType, paths: Paths) -> tuple[Column, T.DataType] | None:
    """The value cut to the paths below it; None when nothing of it is wanted."""
    if not paths:
        return None
    if any(not p for p in paths):
        return column, dtype
    if isinstance(dtype, T.StructType):
        return _rebuild(dtype, lambda f: _include(column.getField(f.name), f.dataType, _tails(f.name, paths)), column)
    if isinstance(dtype, T.MapType):
        kept = F.map_filter(column, lambda k, _: _any([p[0] for p in paths], k))
        whole = any(len(p) == 1 for p in paths) or not isinstance(dtype.valueType, T.StructType)
        if whole:
            return kept, dtype
        below = [type(p)(p[1:]) for p in paths]
        probe = _include(F.lit(None), dtype.valueType, below)
        if probe is None:
            return None
        cut = F.transform_values(kept, lambda _, v: _include(v, dtype.valueType, below)[0])
        return cut, T.MapType(dtype.keyType, probe[1])
    # a plain value is kept whole unless only wildcard paths wanted something inside it
    return None if all(isinstance(p, _Wild) for p in paths) else (column, dtype)


def _exclude(column: Column, dtype: T.DataType, paths: Paths) -> tuple[Column, T.DataType] | None:
    """The value without the paths; None when it goes or an object is emptied."""
    if any(not p for p in paths):
        return None
    if not paths:
        return column, dtype
    if isinstance(dtype, T.StructType):
        return _rebuild(dtype, lambda f: _exclude(column.getField(f.name), f.dataType, _tails(f.name, paths)), column)
    if isinstance(dtype, T.MapType):
        gone = [p[0] for p in paths if len(p) == 1]
        kept = F.map_filter(column, lambda k, _: ~_any(gone, k)) if gone else column
        if isinstance(dtype.valueType, T.StructType):
            for path in (p for p in paths if len(p) > 1):
                cut = _cut_values(kept, dtype, path)
                if cut is None:
                    return None
                kept, dtype = cut
        return F.when(F.size(kept) > 0, kept), dtype
    return column, dtype


def _cut_values(column: Column, dtype: T.MapType, path: list[str]) -> tuple[Column, T.MapType] | None:
    """A map of objects without one path inside its values.

    Values of one map share their type: what is excluded from some keys only becomes null there.
    """
    below = [type(path)(path[1:])]
    if path[0] == "*":
        probe = _exclude(F.lit(None), dtype.valueType, below)
        if probe is None:
            return None
        cut = F.transform_values(column, lambda _, v: _exclude(v, dtype.valueType, below)[0])
        return cut, T.MapType(dtype.keyType, probe[1])
    if len(path) == 2 and path[1] in dtype.valueType.fieldNames():
        cut = F.transform_values(
            column, lambda k, v: F.when(_like(path[0], k), v.withField(path[1], F.lit(None))).otherwise(v))
        return cut, dtype
    return column, dtype


def _rebuild(dtype: T.StructType, pick, column: Column) -> tuple[Column, T.DataType] | None:
    made, fields = [], []
    for field in dtype.fields:
        found = pick(field)
        if found is not None:
            made.append(found[0].alias(field.name))
            fields.append(T.StructField(field.name, found[1], field.nullable))
    if not made:
        return None
    if len(made) == len(dtype.fields) and T.StructType(fields) == dtype:
        return column, dtype
    return F.when(column.isNotNull(), F.struct(*made)), T.StructType(fields)


def _project(df: DataFrame, keep) -> DataFrame | None:
    columns = []
    for field in df.schema.fields:
        found = keep(F.col(f"`{field.name}`"), field)
        if found is not None:
            columns.append(found[0].alias(field.name))
    return df.select(*columns) if columns else None


def select_fields(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Keep the included paths, then remove the excluded ones.

    Paths that name nothing are ignored; when nothing is left, id and collection are. The choice is made on
    the schema, so the scan reads only what is kept.
    """
    if include:
        paths = _split(include)
        kept = _project(df, lambda c, f: _include(c, f.dataType, _tails(f.name, paths)))
        if kept is None:
            return df.select("id", "collection")
        df = kept
    if exclude:
        paths = _split(exclude)
        kept = _project(df, lambda c, f: _exclude(c, f.dataType, _tails(f.name, paths)))
        return df.select() if kept is None else kept
    return df


def drop_paths(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Remove configured paths; objects they empty stay."""
    for path in paths:
        head, _, tail = path.strip().partition(".")
        if head not in df.columns:
            continue
        if not tail:
            df = df.drop(head)
        elif isinstance(df.schema[head].dataType, T.StructType) and _has(df.schema[head].dataType, tail):
            df = df.withColumn(head, F.col(f"`{head}`").dropFields(".".join(f"`{p}`" for p in tail.split("."))))
    return df


def _has(dtype: T.DataType, path: str) -> bool:
    head, _, tail = path.partition(".")
    if not isinstance(dtype, T.StructType) or head not in dtype.fieldNames():
        return False
    return not tail or _has(dtype[head].dataType, tail)


# ---------------------------------------------------------------- documents on their way in and out


def prepare_items(df: DataFrame, now: str | datetime) -> DataFrame:
    """Stamp a write: `created` where absent, `updated` always. The clock is an argument, so reruns agree."""
    stamp = ts_lit(now)
    created = F.coalesce(F.col("created"), stamp) if "created" in df.columns else stamp
    return df.withColumns({"created": created, "updated": stamp})


# What a collection holds when a required member is missing.
_COLLECTION_DEFAULTS = {
    "type": "'Collection'", "stac_version": "''", "title": "''", "description": "''", "license": "''",
    "stac_extensions": "cast(array() AS array<string>)", "keywords": "cast(array() AS array<string>)",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill the required members of collections; other columns are left alone."""
    made = {}
    for name, default in _COLLECTION_DEFAULTS.items():
        made[name] = F.coalesce(F.col(name), F.expr(default)) if name in df.columns else F.expr(default)
    for name, empty in (("providers", F.array()), ("summaries", F.create_map()), ("assets", F.create_map())):
        if name in df.columns and isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType)):
            made[name] = F.coalesce(F.col(name), empty.cast(df.schema[name].dataType))
    return df.withColumns(made)


def with_bbox_shape(df: DataFrame, bbox: str = "extent.spatial.bbox") -> DataFrame:
    """Ring `bbox_shape` of the first spatial box (2D or 3D); kept where present, null where the box is short."""
    first = F.get(F.col(bbox), 0)
    corner = {i: F.get(first, i) for i in range(5)}
    flat = F.size(first) == 4
    shape = F.when(
        F.size(first) >= 4,
        bbox_polygon(
            corner[0], corner[1],
            F.when(flat, corner[2]).otherwise(corner[3]), F.when(flat, corner[3]).otherwise(corner[4]),
        ),
    )
    return df.withColumn("bbox_shape", F.coalesce(F.col("bbox_shape"), shape) if "bbox_shape" in df.columns else shape)


def assets_to_array(df: DataFrame, column: str = "assets") -> DataFrame:
    """Object of assets to an array whose entries carry their key as `es_key`."""
    value = df.schema[column].dataType.valueType
    entries = F.map_entries(F.col(column))
    return df.withColumn(column, F.transform(entries, lambda e: F.struct(
        e["key"].alias("es_key"),
        *([e["value"].getField(n).alias(n) for n in value.fieldNames()]
          if isinstance(value, T.StructType) else [e["value"].alias("value")]),
    )))


def assets_to_map(df: DataFrame, column: str = "assets", stem: str = "asset") -> DataFrame:
    """Back to an object; an entry without key is named by its place, and a repeated key keeps the last entry."""
    names = [n for n in df.schema[column].dataType.elementType.fieldNames() if n != "es_key"]
    keyed = F.transform(F.col(column), lambda e, i: F.struct(
        F.coalesce(e["es_key"], F.concat(F.lit(f"{stem}_"), i.cast("string"))).alias("key"),
        (e["value"] if names == ["value"] else F.struct(*[e[n].alias(n) for n in names])).alias("value"),
        i.alias("place"),
    ))
    last = F.filter(keyed, lambda e: ~F.exists(keyed, lambda o: (o["key"] == e["key"]) & (o["place"] > e["place"])))
    pairs = F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return df.withColumn(column, F.map_from_entries(pairs))
