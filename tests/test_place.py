"""Tables that lie along a curve over the map."""

import os

import pytest
from pyspark.sql import functions as F

from geoledger.functions.grids import hilbert_key
from geoledger.operators.fields import Fields
from geoledger.operators.spatial import by_bbox
from geoledger.sources import store


def test_the_curve_visits_every_cell_and_steps_to_neighbours(spark):
    bits = 5
    cells = spark.range(1 << 2 * bits).select((F.col("id") % 32).alias("x"), F.floor(F.col("id") / 32).alias("y"))
    keys = cells.select("x", "y", hilbert_key((F.col("x") + .5) * 360 / 32 - 180, (F.col("y") + .5) * 180 / 32 - 90, bits).alias("key")).orderBy("key").collect()
    assert [r.key for r in keys] == list(range(1 << 2 * bits))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(keys, keys[1:]))


def test_edges_of_the_map_and_rows_without_a_place(spark):
    rows = spark.createDataFrame([(-180.0, -90.0), (180.0, 90.0), (180.0, -90.0), (None, 1.0), (1.0, None)], "x double, y double")
    got = [r[0] for r in rows.select(hilbert_key(F.col("x"), F.col("y"))).collect()]
    assert got == [0, got[1], (1 << 32) - 1, None, None] and 0 < got[1] < (1 << 32) - 1


def points(spark, count, seed=1):
    x, y = F.rand(seed) * 360 - 180, F.rand(seed + 1) * 180 - 90
    rows = spark.range(0, count, 1, 4).select(
        F.concat(F.lit("i"), F.col("id")).alias("id"), F.when(F.col("id") % 3 > 0, "c1").otherwise("c2").alias("collection"),
        F.timestamp_seconds(F.col("id") % 86400 + 1577836800).cast("timestamp_ntz").alias("datetime"), x.alias("minx"), y.alias("miny"))
    return rows.withColumns({"maxx": F.col("minx"), "maxy": F.col("miny"), "note": F.lit("old")})


def read_rows(df):
    """Rows that the scan of a plan hands on, after pages were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(n).metrics().apply("numOutputRows").value() for n in range(leaves.size()))


@pytest.fixture()
def small_pages(spark):
    spark.conf.set("parquet.page.row.count.limit", "500")
    yield
    spark.conf.unset("parquet.page.row.count.limit")


def in_box(df):
    return df.filter(by_bbox(Fields.of(df), [10.0, 10.0, 30.0, 25.0])).select("id", "collection", "note")


def test_a_box_reads_few_pages(spark, tmp_path, small_pages):
    rows = points(spark, 60_000)
    by_time, by_place = str(tmp_path / "time"), str(tmp_path / "place")
    store.write_items(rows, by_time)
    store.write_items(rows, by_place, by_place=True)
    assert not store.lies_by_place(spark, by_time) and store.lies_by_place(spark, by_place)
    want = {tuple(r) for r in in_box(rows).collect()}
    found = {}
    for path in (by_time, by_place):
        df = in_box(store.read_items(spark, path))
        assert {tuple(r) for r in df.collect()} == want and len(want) > 100
        found[path] = read_rows(in_box(store.read_items(spark, path)))
    assert found[by_time] > 50_000 and len(want) <= found[by_place] < 8_000


def test_later_writes_keep_the_order(spark, tmp_path, small_pages):
    path = str(tmp_path / "place")
    rows = points(spark, 30_000)
    store.write_items(rows, path, by_place=True)
    new = rows.filter(F.substring("id", 2, 9).cast("int") % 7 == 0).withColumn("note", F.lit("new"))
    store.upsert_store(new, path)
    store.rename_in_store(spark, path, "c2", "c3")
    df = in_box(store.read_items(spark, path))
    changed = rows.join(new.select("id"), "id", "left_semi").select("id")
    want = in_box(rows).drop("note").join(changed.withColumn("n", F.lit("new")), "id", "left").select(
        "id", F.regexp_replace("collection", "c2", "c3"), F.coalesce("n", F.lit("old")))
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in want.collect()}
    assert read_rows(in_box(store.read_items(spark, path))) < 5_000
    assert os.path.exists(f"{path}/{store.PLACE}") and store.read_items(spark, path).count() == 30_000
    copy = str(tmp_path / "copy")
    store.write_items(points(spark, 10).withColumns({"minx": F.lit(None).cast("double"), "maxx": F.lit(None).cast("double")}), copy, by_place=True)
    assert store.read_items(spark, copy).count() == 10
