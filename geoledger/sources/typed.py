"""Raw item documents to typed columns, steered by field mappings and ordered templates."""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.functions.geometry import GEOMETRY_TYPE, bounds_of, geometry_from_json
from geoledger.functions.times import parse_utc
from geoledger.operators.validation import json_kind
from geoledger.session import materialised

# Types given to new fields by name or detected type; the first match counts.
BASE_TEMPLATES: list[dict[str, dict[str, Any]]] = [
    {"descriptions": {"match_mapping_type": "string", "match": "description", "mapping": {"type": "text"}}},
    {"titles": {"match_mapping_type": "string", "match": "title", "mapping": {"type": "text"}}},
    {"proj_epsg": {"match": "proj:epsg", "mapping": {"type": "integer"}}},
    {"proj_projjson": {"match": "proj:projjson", "mapping": {"type": "object", "enabled": False}}},
    {"proj_centroid": {"match": "proj:centroid", "mapping": {"type": "geo_point"}}},
    {"proj_geometry": {"match": "proj:geometry", "mapping": {"type": "object", "enabled": False}}},
    {"no_index_href": {"match": "href", "mapping": {"type": "text", "index": False}}},
    {"strings": {"match_mapping_type": "string", "mapping": {"type": "keyword"}}},
    {"long_to_double": {"match_mapping_type": "long", "mapping": {"type": "double"}}},
    {"double_to_double": {"match_mapping_type": "double", "mapping": {"type": "double"}}},
]
# Fields typed whatever the data holds.
BASE_FIELDS: dict[str, dict[str, Any]] = {
    "id": {"type": "keyword"},
    "collection": {"type": "keyword"},
    "geometry": {"type": "geo_shape"},
    "assets": {"type": "object", "enabled": False},
    "links": {"type": "object", "enabled": False},
    "properties.datetime": {"type": "date_nanos"},
    "properties.start_datetime": {"type": "date_nanos"},
    "properties.end_datetime": {"type": "date_nanos"},
    "properties.created": {"type": "date"},
    "properties.updated": {"type": "date"},
    "properties.sat:absolute_orbit": {"type": "integer"},
    "properties.sat:relative_orbit": {"type": "integer"},
}
# Spark type per mapping type.
SPARK_TYPES = {
    "keyword": "string", "text": "string", "match_only_text": "string", "wildcard": "string",
    "double": "double", "float": "float", "half_float": "float", "scaled_float": "double",
    "long": "bigint", "unsigned_long": "decimal(20,0)", "integer": "int", "short": "smallint", "byte": "tinyint",
    "boolean": "boolean", "date": "timestamp_ntz", "date_nanos": "timestamp_ntz",
    "geo_point": "struct<lat:double,lon:double>", "geo_shape": GEOMETRY_TYPE,
    "object": "variant", "nested": "variant",
}
_NUMBERS = ("double", "float", "bigint", "decimal(20,0)", "int", "smallint", "tinyint")
# Members of a document that are not item fields.
_ENVELOPE = ("type", "stac_version", "stac_extensions", "bbox")


# ---------------------------------------------------------------- mappings and templates


def merge_fields(base: Mapping[str, Any], custom: Mapping[str, Any]) -> dict[str, Any]:
    """Nested merge; custom values win."""
    out = copy.deepcopy(dict(base))
    for key, value in custom.items():
        both = isinstance(out.get(key), dict) and isinstance(value, Mapping)
        out[key] = merge_fields(out[key], value) if both else copy.deepcopy(value)
    return out


# The conditions a template may have.
_CONDITIONS = ("match_mapping_type", "unmatch_mapping_type", "match", "unmatch", "path_match", "path_unmatch")


def check_template(template: Mapping[str, Any]) -> None:
    """One named entry with some condition and a typed mapping."""
    if len(template) != 1:
        raise ValueError(f"a template has exactly one name, got {len(template)}")
    name, body = next(iter(template.items()))
    if not isinstance(name, str) or not name:
        raise ValueError("a template's name is text")
    if not isinstance(body, Mapping) or not any(body.get(c) for c in _CONDITIONS):
        raise ValueError(f"template {name} has no condition")
    if not isinstance(body.get("mapping"), Mapping) or "type" not in body["mapping"]:
        raise ValueError(f"template {name} has no mapping type")


def merge_templates(base: Sequence[dict], custom: Sequence[dict]) -> list[dict]:
    """Custom templates replace base ones of the same name and come after them otherwise."""
    for template in custom:
        check_template(template)
    merged: dict[str, Any] = {}
    for template in [*base, *custom]:
        name, body = next(iter(template.items()))
        merged[name] = body
    return [{name: body} for name, body in merged.items()]


def dynamic_mode(text: str | None) -> str:
    """true (default), false, or strict."""
    mode = (text or "true").lower()
    if mode not in ("true", "false", "strict"):
        raise ValueError(f"unknown mode {text!r}")
    return mode


def template_type(path: str, detected: str, templates: Sequence[dict] = BASE_TEMPLATES) -> dict[str, Any]:
    """Mapping of a new field: that of the first template whose conditions all hold, else the detected type."""
    name = path.rsplit(".", 1)[-1]
    for template in templates:
        body = next(iter(template.values()))
        kinds = body.get("match_mapping_type")
        if kinds and detected not in (kinds if isinstance(kinds, list) else [kinds]) and kinds != "*":
            continue
        if body.get("unmatch_mapping_type") == detected:
            continue
        if body.get("match") and not fnmatchcase(name, body["match"]):
            continue
        if body.get("unmatch") and fnmatchcase(name, body["unmatch"]):
            continue
        if body.get("path_match") and not fnmatchcase(path, body["path_match"]):
            continue
        if body.get("path_unmatch") and fnmatchcase(path, body["path_unmatch"]):
            continue
        return dict(body["mapping"])
    return {"type": {"string": "keyword", "long": "long", "double": "double", "boolean": "boolean"}.get(detected, "object")}


# ---------------------------------------------------------------- inference


@dataclass(frozen=True)
class MappedField:
    """One typed field: its dotted path, mapping, and whether it holds several values."""

    path: str
    mapping: Mapping[str, Any]
    many: bool = False
    # some documents hold one value, others a list
    mixed: bool = False

    @property
    def spark_type(self) -> str:
        kind = SPARK_TYPES.get(self.mapping["type"])
        if kind is None:
            raise ValueError(f"unknown mapping type {self.mapping['type']!r} of {self.path}")
        return kind


def split_path(path: str) -> list[str]:
    return path.split(".")


class Observed(NamedTuple):
    """Detected type of a field, whether it holds several values, and whether only some documents hold several."""

    kind: str
    many: bool = False
    mixed: bool = False


def agreed(kinds: Sequence[str]) -> Observed:
    """One type for a field whose documents disagree, given the variant types found.

    Numbers and texts are a number, whose texts are coerced or rejected later; other scalars meet as text. One value
    and a list are a list.
    """
    lists = [k for k in kinds if k.startswith("ARRAY<")]
    single = {k.removeprefix("ARRAY<").removesuffix(">") for k in kinds} - {"VOID"}
    names = {
        "STRING" if k in ("STRING", "VARIANT") else "BOOLEAN" if k == "BOOLEAN" else "OBJECT" if k.startswith(("OBJECT", "ARRAY"))
        else "long" if k in ("BIGINT", "INT", "SMALLINT", "TINYINT") else "double" for k in single}
    many, mixed = bool(lists), 0 < len(lists) < len([k for k in kinds if k != "VOID"])
    if not names or "OBJECT" in names:
        return Observed("object", many)
    numbers = names & {"long", "double"}
    if "BOOLEAN" in names:
        kind = "boolean" if len(names) == 1 else "string"
    else:
        kind = ("double" if "double" in numbers else "long") if numbers else "string"
    return Observed(kind, many, mixed)


def observed_fields(documents: DataFrame, column: str = "document") -> dict[str, Observed]:
    """Path to what was seen of every field in the documents.

    Schemas are merged by a partial aggregate; only the merged schema comes to the driver. Fields whose documents
    disagree are looked at once more, all in one pass, for the types they have.
    """
    ddl = documents.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("s")).first()["s"]
    if ddl is None:
        return {}
    schema = T._parse_datatype_string(ddl.replace("OBJECT<", "STRUCT<"))
    found: dict[str, Observed] = {}
    unclear: list[str] = []

    def visit(path: str, dtype: T.DataType, many: bool) -> None:
        if isinstance(dtype, T.ArrayType):
            visit(path, dtype.elementType, True)
        elif isinstance(dtype, T.StructType) and not many:
            centroid = set(dtype.fieldNames()) == {"lat", "lon"}
            if path in BASE_FIELDS or centroid or path in ("properties.proj:projjson", "properties.proj:geometry"):
                found[path] = Observed("object", many)
                return
            for field in dtype.fields:
                if path or field.name not in _ENVELOPE:
                    visit(f"{path}.{field.name}" if path else field.name, field.dataType, False)
        elif isinstance(dtype, T.VariantType) and path not in BASE_FIELDS:
            unclear.append(path)
        elif not isinstance(dtype, T.NullType):
            kinds = [(T.StringType, "string"), (T.BooleanType, "boolean"), (T.LongType, "long"),
                     ((T.DoubleType, T.DecimalType, T.FloatType), "double")]
            found[path] = Observed(next((n for t, n in kinds if isinstance(dtype, t)), "object"), many)

    visit("", schema, False)
    if unclear:
        # a column for the text and one for each member, so that none is parsed or looked up twice
        parsed = documents.select(F.try_parse_json(F.col(column)).alias("_p"))
        members_ = parsed.select(*[
            F.try_variant_get("_p", "$" + "".join(f"['{p}']" for p in split_path(path)), "variant").alias(f"m{i}") for i, path in enumerate(unclear)])

        def kind(member: Column) -> Column:
            seen = F.when(member.isNotNull() & ~F.is_variant_null(member), F.schema_of_variant(member))
            # the members of objects don't matter here, and would make the set large
            return F.regexp_replace(seen, "OBJECT<.*", "OBJECT")

        row = members_.agg(*[F.collect_set(kind(F.col(f"m{i}"))).alias(f"k{i}") for i in range(len(unclear))]).first()
        found |= {p: agreed(row[f"k{i}"]) for i, p in enumerate(unclear)}
    return found


def mapping_for(
    observed: Mapping[str, Observed], fields: Mapping[str, Any] | None = None,
    templates: Sequence[dict] = BASE_TEMPLATES, mode: str = "true",
) -> list[MappedField]:
    """Mapped fields: the fixed ones, and in mode true every observed one by its template."""
    fixed = BASE_FIELDS if fields is None else fields
    out = [MappedField(p, m, *observed.get(p, Observed(""))[1:]) for p, m in fixed.items()]
    if mode == "true":
        out += [
            MappedField(p, template_type(p, seen.kind, templates), seen.many, seen.mixed)
            for p, seen in observed.items() if p not in fixed
        ]
    return out


# ---------------------------------------------------------------- projection


def _raw_schema(mapping: Sequence[MappedField]) -> T.StructType:
    """Every mapped field as text (or a list of texts): one pass of the JSON reader finds them all."""
    tree: dict[str, Any] = {}
    for field in mapping:
        *parents, leaf = split_path(field.path)
        node = tree
        for part in parents:
            node = node.setdefault(part, {})
        node[leaf] = T.ArrayType(T.StringType()) if field.many and not field.mixed else T.StringType()

    def struct(node: dict[str, Any]) -> T.StructType:
        return T.StructType([
            T.StructField(name, struct(v) if isinstance(v, dict) else v) for name, v in node.items()
        ])

    return struct(tree)


def _cast(text: Column, field: MappedField) -> Column:
    """The text of one value in the field's type; null where it does not fit."""
    kind = field.spark_type
    if field.mapping["type"] == "geo_shape":
        return geometry_from_json(text)
    if field.mapping["type"] == "geo_point":
        return F.from_json(text, kind)
    if kind == "variant":
        return F.try_parse_json(text)
    if kind == "timestamp_ntz":
        return parse_utc(text)
    return text if kind == "string" else text.try_cast(kind)


def _cast_all(texts: Column, field: MappedField) -> Column:
    if field.mixed:
        # a list comes as its text, one value as itself
        several = F.when(texts.startswith("["), F.from_json(texts, "array<string>"))
        texts = F.when(texts.isNotNull(), F.coalesce(several, F.array(texts)))
    return F.transform(texts, lambda text: _cast(text, field))


def members(document: Column, mapping: Sequence[MappedField]) -> Column:
    """The mapped fields of a JSON text as nested members of one struct."""
    parsed = F.from_json(document, _raw_schema(mapping))
    entries = []
    for field in mapping:
        text = parsed
        for part in split_path(field.path):
            text = text.getField(part)
        entries.append((split_path(field.path), _cast_all(text, field) if field.many else _cast(text, field)))
    return _nest(entries)


def typed(
    documents: DataFrame, mapping: Sequence[MappedField], mode: str = "true", coerce: bool = True,
    column: str = "document",
) -> DataFrame:
    """Typed items of documents given as JSON text, with `error` for those the mapping rejects (all else null).

    Fields of `properties` go into a struct, times and the geometry's bounds also to the top level. Columns the
    frame already has, such as a stamped collection, win over the document's members. Mode `false` keeps unknown
    properties as JSON texts in `extra`; mode `strict` rejects documents that have any.
    """
    mode = dynamic_mode(mode)
    parsed = documents.withColumn("_d", F.from_json(F.col(column), _raw_schema(mapping)))

    def raw(path: str) -> Column:
        found = F.col("_d")
        for part in split_path(path):
            found = found.getField(part)
        return found

    top, props, errors = [], [], []
    for field in mapping:
        text = raw(field.path)
        value = _cast_all(text, field) if field.many else _cast(text, field)
        parts = split_path(field.path)
        if parts[0] == "properties":
            props.append((parts[1:], value))
        elif field.path not in documents.columns:
            top.append(value.alias(field.path))
        if field.spark_type in ("string", "variant") or field.many:
            continue
        label = f"[{field.path}] of type [{field.mapping['type']}]"
        errors.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"failed to parse field {label}")))
        if field.spark_type in _NUMBERS and not coerce:
            kind = json_kind(F.try_parse_json(F.col(column)), "$" + "".join(f"['{p}']" for p in parts))
            errors.append(F.when(kind == "string", F.lit(f"field {label} takes no text")))

    extra = F.lit(None).cast("map<string,string>")
    if mode != "true":
        known = sorted({split_path(f.path)[1] for f in mapping if f.path.startswith("properties.")})
        members = F.from_json(F.get_json_object(column, "$.properties"), "map<string,string>")
        extra = F.map_filter(members, lambda k, _: ~k.isin(known) if known else F.lit(True))
    if mode == "strict":
        errors.append(F.when(F.size(F.map_keys(extra)) > 0, F.concat(
            F.lit("mapping set to strict, unknown field ["), F.get(F.map_keys(extra), 0), F.lit("]"))))

    typed_paths = {f.path for f in mapping}
    times = [
        parse_utc(raw(f"properties.{n}")).alias(n)
        for n in ("datetime", "start_datetime", "end_datetime", "created", "updated") if f"properties.{n}" in typed_paths
    ]
    out = parsed.select(
        *documents.columns, *top, *times, _nest(props).alias("properties"), extra.alias("extra"),
        F.coalesce(*errors, F.lit(None).cast("string")).alias("error"),
    )
    return out.withColumns(bounds_of(F.col("geometry"))) if "geometry" in out.columns else out


def _nest(entries: list[tuple[list[str], Column]]) -> Column:
    """Struct of (path, value) pairs."""
    groups: dict[str, list[tuple[list[str], Column]]] = {}
    for path, value in entries:
        groups.setdefault(path[0], []).append((path[1:], value))
    members = []
    for name, inner in groups.items():
        whole = [v for p, v in inner if not p]
        members.append((whole[0] if whole else _nest(inner)).alias(name))
    return F.struct(*members)


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of `typed`, which runs once: both halves read its written result."""
    done = materialised(df)
    return done.filter(F.col("error").isNull()).drop("error"), done.filter(F.col("error").isNotNull())
