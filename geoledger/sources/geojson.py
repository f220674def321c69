"""GeoJSON and collection documents as rows of raw text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.functions.times import parse_utc
from geoledger.sources.typed import MappedField, members, observed_fields, split_path, template_type


def read_features(
    spark: SparkSession, path: str, collection: str | None = None, lines: bool = False
) -> DataFrame:
    """FeatureCollection files to (collection, id, document): one row per feature, its text kept as written.

    `collection` is stamped on every feature in place of its own. A file is one FeatureCollection, or with `lines`
    one per line, which also lets large files be split over tasks. A feature's text is not parsed for a schema, so
    shapes and properties may differ from file to file.
    """
    raw = spark.read.schema("features array<string>").json(path, multiLine=not lines)
    feature = raw.select(F.explode("features").alias("document"))
    own = F.get_json_object("document", "$.collection")
    return feature.select(
        (F.lit(collection) if collection is not None else own).alias("collection"),
        F.get_json_object("document", "$.id").alias("id"),
        "document",
    )


def read_collections(
    spark: SparkSession, path: str, collection_id: str | None = None, lines: bool = False
) -> DataFrame:
    """Collection files (one document each, or with `lines` one per line) to (id, document).

    `collection_id` overrides the id.
    """
    text = spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "document")
    own = F.get_json_object("document", "$.id")
    return text.select((F.lit(collection_id) if collection_id is not None else own).alias("id"), "document")


# Members of a collection document and their types.
COLLECTION_SCHEMA = (
    "id string, type string, title string, description string, stac_version string, "
    "stac_extensions array<string>, license string, keywords array<string>, parent_ids array<string>, "
    "extent struct<spatial:struct<bbox:array<array<double>>>,temporal:struct<interval:array<array<string>>>>, "
    "aggregations array<struct<name:string,data_type:string,frequency_distribution_data_type:string>>"
)


def other_members(raw: DataFrame) -> list[MappedField]:
    """What collection documents hold beside the fixed members: summaries, providers, assets, extension fields."""
    fixed = {part.strip().split(" ")[0] for part in COLLECTION_SCHEMA.split(", ")} | {"links"}
    seen = {p: o for p, o in observed_fields(raw).items() if split_path(p)[0] not in fixed}
    return [MappedField(p, template_type(p, o.kind), o.many, o.mixed) for p, o in seen.items()]


def parse_collections(raw: DataFrame, others: Sequence[MappedField] | None = None) -> DataFrame:
    """Typed columns of (id, document) rows; the id column wins over the document's.

    Members beside the fixed ones become columns too, so that searches find them: those given in `others`, else all
    that the documents hold, which takes a pass over them.
    """
    others = other_members(raw) if others is None else others
    parsed = raw.withColumn("c", F.from_json("document", COLLECTION_SCHEMA))
    names = [part.strip().split(" ")[0] for part in COLLECTION_SCHEMA.split(", ")]
    rows = parsed.select("id", *[f"c.{n}" for n in names if n != "id"], "document")
    # the JSON reader takes no offset for zone-less times, so the dates are parsed here
    dates = F.transform("extent.temporal.interval", lambda pair: F.transform(pair, parse_utc))
    rows = rows.withColumn("extent", F.col("extent").withField("temporal", F.struct(dates.alias("interval"))))
    if not others:
        return rows
    more = rows.withColumn("_more", members(F.col("document"), others))
    names = list(dict.fromkeys(split_path(f.path)[0] for f in others))
    return more.select(*rows.columns, *[F.col("_more").getField(n).alias(n) for n in names])
