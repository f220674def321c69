"""Queryables: which fields can be searched, per collection and over all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.functions.ids import PART, SLICE
from geoledger.operators.fields import Fields
from geoledger.session import exists

ENUM_LIMIT = 100
QUERYABLE_SCHEMA = "name string, title string, type string, format string"

# Fields every collection has, with their descriptions.
BASE_QUERYABLES = {
    "id": "ID",
    "collection": "Collection",
    "geometry": "Geometry",
    "datetime": "Acquisition Timestamp",
    "created": "Creation Timestamp",
    "updated": "Creation Timestamp",
}
ENUM_FIELDS = ("platform",)
# Columns of the stored layout that are no fields of an item.
INTERNAL = ("minx", "miny", "maxx", "maxy", "has_datetime", "item_date", PART, SLICE, "links", "assets", "extra", "document")


def json_type(dtype: T.DataType) -> tuple[str, str | None]:
    """JSON type and format shown for a Spark type; arrays show their elements."""
    if isinstance(dtype, T.ArrayType):
        return json_type(dtype.elementType)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "string", "date-time"
    if isinstance(dtype, T.IntegerType):
        return "integer", None
    if isinstance(dtype, T.NumericType):
        return "number", None
    if isinstance(dtype, T.BooleanType):
        return "boolean", None
    if isinstance(dtype, (T.StructType, T.MapType, T.VariantType)):
        return "object", None
    return "string", None


def searchable(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of the fields to search; geometries and points count as one field."""
    out: list[tuple[str, T.DataType]] = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if not prefix and field.name in INTERNAL:
            continue
        if isinstance(field.dataType, T.StructType):
            inner = set(field.dataType.fieldNames())
            if inner == {"type", "parts"} or inner == {"lat", "lon"}:
                out.append((path, field.dataType))
            else:
                out += searchable(field.dataType, path + ".")
        elif not isinstance(field.dataType, (T.MapType, T.VariantType)):
            out.append((path, field.dataType))
    return out


def located(path: str) -> tuple[str, tuple[str, ...]]:
    """The envelope a path starts in, empty when it names none, and the parts below it."""
    parts = tuple(path.strip().split("."))
    return (parts[0], parts[1:]) if parts[0] in ("properties", "assets") and len(parts) > 1 else ("", parts)


def is_excluded(path: str, names: Sequence[str]) -> bool:
    """Some name is the path or lies above it. A name or path without envelope stands for any."""
    envelope, parts = located(path)
    return any(
        parts[:len(above)] == above and (not where or not envelope or where == envelope)
        for where, above in (located(n) for n in names if n.strip())
    )


def title_of(name: str) -> str:
    return name.replace("_", " ").title()


def queryables(items: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(collection, name, title, type, format): the fields each collection has a value for.

    One pass: a flag per field and collection, combined before the shuffle. Fields come from the schema, so
    their number is bounded by it.
    """
    fields = Fields.of(items)
    found = [(p, t) for p, t in searchable(items.schema) if not is_excluded(p, exclude)]
    flags = items.groupBy("collection").agg(
        *[F.bool_or(fields.get(p).column.isNotNull()).alias(f"f{i}") for i, (p, _) in enumerate(found)]
    )
    entries = []
    for i, (path, dtype) in enumerate(found):
        name = ".".join(located(path)[1])
        kind, fmt = json_type(dtype)
        entries.append(F.struct(
            F.col(f"f{i}").alias("seen"), F.lit(name).alias("name"), F.lit(title_of(name)).alias("title"),
            F.lit(kind).alias("type"), F.lit(fmt).cast("string").alias("format"),
        ))
    rows = flags.select("collection", F.explode(F.array(*entries)).alias("q"))
    return rows.filter("q.seen").select("collection", "q.name", "q.title", "q.type", "q.format")


def described_paths(seen: DataFrame, schema: T.StructType, exclude: Sequence[str] = ()) -> DataFrame:
    """`queryables` of (collection, path) rows that tell which fields of the schema have a value."""
    entries = []
    for path, dtype in searchable(schema):
        if not is_excluded(path, exclude):
            name = ".".join(located(path)[1])
            entries.append((path, name, title_of(name), *json_type(dtype)))
    shown = seen.sparkSession.createDataFrame(entries, f"path string, {QUERYABLE_SCHEMA}")
    return seen.distinct().join(shown, "path").select("collection", "name", "title", "type", "format")


def base_entries() -> Column:
    """The base fields, shown when no collection is named, as an array of (name, description)."""
    return F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(d).alias("description")) for n, d in BASE_QUERYABLES.items()
    ])


def root_queryables(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(name, description, definition) of the fields shown when no collection is named: those of a file, or the base fields.

    The file is a JSON schema whose `properties` are the fields; `definition` is a field's part of it as JSON, null for base
    fields. A file without properties shows no fields, one that is no JSON object is an error. Without a file at the
    path the base fields are shown.
    """
    if path is None or not exists(spark, path):
        base = spark.range(1).select(F.explode(base_entries()).alias("b"))
        return base.select("b.*", F.lit(None).cast("string").alias("definition"))
    found = F.from_json("value", "properties map<string, string>")
    checked = F.when(F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull(), found["properties"]).otherwise(
        F.raise_error(F.lit(f"not a JSON object: {path}")))
    fields = spark.read.text(path, wholetext=True).select(F.explode(checked).alias("name", "definition"))
    return fields.select("name", F.get_json_object("definition", "$.description").alias("description"), "definition")


def union_queryables(per_collection: DataFrame) -> DataFrame:
    """One row per field over all collections; the definition of the first collection wins."""
    first = Window.partitionBy("name").orderBy("collection")
    return (
        per_collection.withColumn("_place", F.row_number().over(first))
        .filter(F.col("_place") == 1)
        .drop("_place", "collection")
    )


def enum_values(items: DataFrame, names: Sequence[str] = ENUM_FIELDS, limit: int = ENUM_LIMIT) -> DataFrame:
    """(collection, name, value) of the listed fields; a field with more than `limit` values in a collection is left out."""
    fields = Fields.of(items)
    pairs = [F.struct(F.lit(n).alias("name"), fields.get(n).column.cast("string").alias("value"))
             for n in names if fields.get(n) is not None]
    values = (
        items.select("collection", F.explode(F.array(*pairs)).alias("p"))
        .select("collection", "p.name", "p.value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )
    return listed_values(values, limit)


def listed_values(values: DataFrame, limit: int = ENUM_LIMIT) -> DataFrame:
    """Of distinct (collection, name, value) rows those of fields with at most `limit` values in the collection."""
    # tasks keep one value beyond the limit of each field before they are brought together, so every list is bounded
    place = F.row_number().over(Window.partitionBy("collection", "name").orderBy("value"))
    some = values.withColumn("_place", place).filter(F.col("_place") <= limit + 1)
    lists = some.groupBy("collection", "name").agg(F.collect_list("value").alias("values")).filter(F.size("values") <= limit)
    return lists.select("collection", "name", F.explode("values").alias("value"))


def with_enum(per_collection: DataFrame, values: DataFrame) -> DataFrame:
    """Queryables with their `enum` lists; each list has at most the limit's values."""
    lists = values.groupBy("collection", "name").agg(F.sort_array(F.collect_list("value")).alias("enum"))
    return per_collection.join(lists, ["collection", "name"], "left")

