"""Tables of many small collections: as many files as parts, and writes that leave the neighbours of a collection alone."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from geoledger.functions.ids import PART, PARTS, SLICE
from geoledger.operators.fields import Fields
from geoledger.operators.filters import by_collections
from geoledger.session import materialised
from geoledger.sources import store


def many(spark, collections=400):
    number = F.col("id")
    at = F.timestamp_seconds(number % 3 * 86400 + 1577836800).cast("timestamp_ntz")
    return spark.range(0, collections * 2, 1, 2).select(
        F.concat(F.lit("i"), number).alias("id"), F.concat(F.lit("c"), number % collections).alias("collection"),
        at.alias("datetime"), F.lit(None).cast("timestamp_ntz").alias("start_datetime"))


def pairs(df):
    found = [tuple(r) for r in df.select("collection", "id").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("by_date", [False, True])
def test_files_do_not_grow_with_the_collections(spark, tmp_path, by_date):
    path, rows = str(tmp_path / "store"), many(spark)
    store.write_items(rows, path, by_date)
    folders = {f.parent for f in Path(path).rglob("*.parquet")}
    assert len(folders) <= (PARTS[SLICE] * 3 if by_date else PARTS[PART])
    store.upsert_store(rows, path, by_date)
    assert {f.parent for f in Path(path).rglob("*.parquet")} == folders
    assert pairs(store.read_items(spark, path)) == pairs(rows)


@pytest.mark.parametrize("by_date", [False, True])
def test_collections_share_a_part(spark, tmp_path, by_date):
    path, rows = str(tmp_path / "store"), many(spark)
    store.write_items(rows, path, by_date)
    store.drop_collection_from_store(spark, path, "c7", by_date)
    store.rename_in_store(spark, path, "c8", "c9", by_date)
    store.rename_in_store(spark, path, "c10", "fresh", by_date)
    want = {(({"c8": "c9", "c10": "fresh"}).get(c, c), i) for c, i in pairs(rows) if c != "c7"}
    assert pairs(store.read_items(spark, path)) == want
    items = store.read_items(spark, path)
    for some in (["c9"], ["fresh", "c11"], ["c7"]):
        found = items.filter(by_collections(Fields.of(items), some))
        assert pairs(found) == pairs(store.read_items(spark, path, some)) == {p for p in want if p[0] in some}


def test_tables_in_folders_by_collection_are_read_only(spark, tmp_path):
    path, rows = str(tmp_path / "store"), many(spark, 3).withColumn("collection", F.regexp_replace("collection", "c", "00"))
    rows.write.partitionBy("collection").parquet(path)
    assert pairs(store.read_items(spark, path)) == pairs(rows)
    assert {c for c, _ in pairs(store.read_items(spark, path, ["001"]))} == {"001"}
    for write in (lambda: store.rename_in_store(spark, path, "001", "new"), lambda: store.upsert_store(rows, path),
                  lambda: store.delete_from_store(rows, path), lambda: store.drop_collection_from_store(spark, path, "001")):
        with pytest.raises(Exception, match=PART):
            write()
    assert pairs(store.read_items(spark, path)) == pairs(rows)


def test_files_are_packed(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_items(many(spark), path)
    files = [f.name for f in Path(path).rglob("*.parquet")] + materialised(many(spark)).inputFiles()
    assert files and all(name.endswith(".zstd.parquet") for name in files)
