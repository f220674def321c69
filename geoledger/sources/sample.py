"""The test tables read as a catalogue: items from events, collections from supplier, catalogs from nation and region."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.functions.geometry import box_geometry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def collection_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "supplier").count()


def items(spark: SparkSession, sf_dir: str, geometry: bool = False) -> DataFrame:
    """One item per event, a third of them in one collection. With `geometry`, its box also as a geometry struct."""
    e = F.col("event_id")
    ts = F.col("ts").cast("timestamp_ntz")
    half = (e % 5) * F.lit(0.25)
    lon = (e * 37 % 3600).cast("double") / F.lit(10.0) - F.lit(180.0)
    lat = (e * 53 % 1700).cast("double") / F.lit(10.0) - F.lit(85.0)
    has_datetime = (e % 7 != 0) & (e % 29 != 0)
    has_range = (e % 29 != 0) & ((e % 7 == 0) | (e % 3 == 0))
    df = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), e.cast("string")).alias("id"),
        F.concat(F.lit("c"), F.when(e % 3 == 0, F.lit(0)).otherwise(
            F.col("user_id") % collection_count(spark, sf_dir)).cast("string")).alias("collection"),
        ts.alias("raw_ts"),
        F.when(has_datetime, ts).alias("datetime"),
        F.when(has_range, ts).alias("start_datetime"),
        F.when(has_range, ts + F.expr("INTERVAL 3 DAY")).alias("end_datetime"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.greatest(lon - half, F.lit(-180.0)).alias("minx"),
        F.greatest(lat - half, F.lit(-90.0)).alias("miny"),
        F.least(lon + half, F.lit(180.0)).alias("maxx"),
        F.least(lat + half, F.lit(90.0)).alias("maxy"),
        F.get_json_object("props", "$.k").cast("int").alias("cloud_cover"),
        F.when(e % 11 != 0, F.col("event_type")).alias("platform"),
        F.col("value").alias("sun_elevation"),
        F.concat(F.col("event_type"), F.lit(" user "), F.col("user_id").cast("string")).alias("title"),
        F.when(e % 2 != 0, e % 13 == 0).alias("hidden"),
    )
    return df.withColumn("geometry", box_geometry(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])) if geometry else df


ITEM_ALIASES = {
    "eo:cloud_cover": "cloud_cover", "view:sun_elevation": "sun_elevation",
    "properties.datetime": "datetime", "centroid.lon": "lon", "centroid.lat": "lat",
}


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection per supplier under the nations' catalogs, which lie under the regions' catalogs."""
    extent = items(spark, sf_dir).groupBy("collection").agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"), F.min("raw_ts").alias("t_min"), F.max("raw_ts").alias("t_max"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"),
        F.lit("Collection").alias("type"),
        F.col("s_name").alias("title"),
        F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("parent_ids"),
    )
    leaves = suppliers.join(extent, suppliers["id"] == extent["collection"], "left").drop("collection")
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.lit("Catalog").alias("type"),
        F.col("n_name").alias("title"),
        F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("parent_ids"),
    )
    regions = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
        F.lit("Catalog").alias("type"),
        F.col("r_name").alias("title"),
        F.lit(None).cast("array<string>").alias("parent_ids"),
    )
    return leaves.unionByName(nations, True).unionByName(regions, True)
