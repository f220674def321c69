"""Batch writes, joins and patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from geoledger.operators import patch, projection, writes
from geoledger.operators.fields import Fields
from geoledger.operators.spatial import by_bbox
from geoledger.sources import sample, store
from suite.filters import BOX, SQL_BOX
from suite.pages import nested_items
from suite.registry import COLLECTIONS, case
from suite.scratch import fresh_dir

NOW = "2024-03-01T12:00:00Z"


def number():
    return F.regexp_extract("id", "[0-9]+", 0).cast("bigint")


# ---------------------------------------------------------------- batches with repeated keys

LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]
_LINE_LAST = ", ".join(f"{c} DESC" for c in LINE_ORDER)
LINES = (
    "lines_v AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, 'c' || (l_orderkey % ((SELECT count(*) FROM supplier) + 2)) AS collection, l_shipdate AS datetime, "
    f"l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_LAST}) AS place, l_orderkey, l_linenumber FROM lineitem), "
    "last_v AS (SELECT * FROM lines_v WHERE place = 1)"
)


def batch(spark, sf_dir):
    """Line items as a batch of items with repeated ids."""
    lines = sample.table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"),
        # two more collections than there are
        F.concat(F.lit("c"), (F.col("l_orderkey") % (sample.collection_count(spark, sf_dir) + 2)).cast("string")).alias("collection"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("datetime"),
        F.lit(None).cast("timestamp_ntz").alias("start_datetime"), F.lit(None).cast("timestamp_ntz").alias("end_datetime"),
        "l_orderkey", "l_linenumber", *[c for c in LINE_ORDER],
    )


def order():
    return [F.col(c) for c in LINE_ORDER]


def stored(spark, sf_dir):
    """What the store holds before the batch: every third order's lines, with a quantity that marks them as old."""
    old = batch(spark, sf_dir).filter(F.col("l_orderkey") % 3 == 0)
    return old.select("id", "collection", "l_orderkey").distinct().withColumn("l_quantity", F.lit(-1.0))


def collections(spark, sf_dir):
    return sample.collections(spark, sf_dir)


@case("w_dedupe_last", "SELECT id, collection, l_quantity, l_extendedprice FROM last_v", views=LINES)
def dedupe_last(spark, sf_dir):
    kept = writes.dedupe_last(batch(spark, sf_dir), order())
    return kept.select("id", "collection", "l_quantity", "l_extendedprice")


@case(
    "w_latest_item",
    "SELECT collection, arg_max(id, datetime) AS id, max(datetime) AS datetime FROM items_v WHERE datetime IS NOT NULL GROUP BY collection",
)
def latest_item(spark, sf_dir):
    rows = sample.items(spark, sf_dir).filter(F.col("datetime").isNotNull())
    return writes.latest_items(rows)


@case("j_collection_exists", "SELECT id, collection, collection IN (SELECT id FROM collections_v) AS known FROM lines_v",
      views=COLLECTIONS + ", " + LINES)
def collection_exists(spark, sf_dir):
    good, bad = writes.split_known(batch(spark, sf_dir), collections(spark, sf_dir))
    return good.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False))).select("id", "collection", "known")


@case("j_conflict", "SELECT id, l_orderkey % 3 = 0 AS conflict FROM last_v", views=LINES)
def conflict(spark, sf_dir):
    new = writes.dedupe_last(batch(spark, sf_dir), order())
    return writes.mark_conflicts(new, stored(spark, sf_dir)).select("id", "conflict")


def ingest(spark, sf_dir, mode):
    # rows of very small price count as invalid
    error = F.when(F.col("l_extendedprice") < 2000, F.lit("price too small"))
    return writes.ingest(
        batch(spark, sf_dir), stored(spark, sf_dir), collections(spark, sf_dir), order(), NOW, mode, error)


SQL_FATE = (
    "fate_v AS (SELECT *, CASE WHEN collection NOT IN (SELECT 'c' || s_suppkey FROM supplier) THEN 'unknown_collection' WHEN l_extendedprice < 2000 THEN 'invalid' "
    "WHEN l_orderkey % 3 = 0 THEN 'conflict' ELSE 'new' END AS fate FROM last_v)"
)


@case("m_bulk_create", "SELECT id, collection, fate, TIMESTAMP '2024-03-01 12:00:00' AS updated FROM fate_v", views=LINES + ", " + SQL_FATE)
def bulk_create(spark, sf_dir):
    return ingest(spark, sf_dir, "create").marked.select("id", "collection", "fate", "updated")


@case(
    "agg_bulk_summary",
    "SELECT (SELECT count(*) FROM lines_v) AS input_count, count(*) AS processed_count, "
    "count(*) FILTER (fate IN ('new', 'conflict')) AS valid_count, "
    "(SELECT count(*) FROM lines_v) - count(*) + count(*) FILTER (fate IN ('invalid', 'conflict')) AS skipped_total, "
    "count(*) FILTER (fate = 'invalid') AS validation_error_count, count(*) FILTER (fate = 'conflict') AS conflict_count, "
    "count(*) FILTER (fate = 'unknown_collection') AS database_error_count FROM fate_v",
    views=LINES + ", " + SQL_FATE,
)
def bulk_summary(spark, sf_dir):
    return ingest(spark, sf_dir, "create").summary


@case("m_bulk_upsert", "SELECT id, l_quantity FROM fate_v WHERE fate IN ('new', 'conflict') UNION ALL "
      "SELECT id, -1.0::DOUBLE FROM fate_v WHERE l_orderkey % 3 = 0 AND fate NOT IN ('new', 'conflict')", views=LINES + ", " + SQL_FATE)
def bulk_upsert(spark, sf_dir):
    before = stored(spark, sf_dir)
    return writes.upsert(before, ingest(spark, sf_dir, "upsert").accepted).select("id", "l_quantity")


@case("m_create_one", "SELECT id, l_quantity FROM (SELECT id, -1.0::DOUBLE AS l_quantity, l_orderkey FROM last_v WHERE l_orderkey % 3 = 0) "
      "UNION ALL SELECT id, l_quantity FROM last_v WHERE l_orderkey = 1", views=LINES)
def create_one(spark, sf_dir):
    new = writes.dedupe_last(batch(spark, sf_dir), order()).filter("l_orderkey = 1")
    return writes.create_strict(stored(spark, sf_dir), new).select("id", "l_quantity")


@case("m_update_one", "SELECT id, CASE WHEN l_orderkey = 3 THEN l_quantity ELSE -1.0::DOUBLE END AS l_quantity FROM last_v WHERE l_orderkey % 3 = 0", views=LINES)
def update_one(spark, sf_dir):
    new = writes.dedupe_last(batch(spark, sf_dir), order()).filter("l_orderkey = 3")
    return writes.replace_existing(stored(spark, sf_dir), new).select("id", "l_quantity")


@case("m_delete_item", "SELECT id, collection FROM items_v WHERE event_id % 6 <> 1")
def delete_item(spark, sf_dir):
    items = sample.items(spark, sf_dir)
    return writes.delete_keys(items, items.filter(number() % 6 == 1)).select("id", "collection")


@case("rename_collection", "SELECT id, CASE WHEN collection = 'c2' THEN 'renamed' ELSE collection END AS collection FROM items_v")
def rename(spark, sf_dir):
    return writes.rename_collection(sample.items(spark, sf_dir), "c2", "renamed").select("id", "collection")


# ---------------------------------------------------------------- the store


@case("sink_items", "SELECT id, collection, datetime, cloud_cover, title FROM items_v")
def sink_items(spark, sf_dir):
    path = fresh_dir(spark, "store")
    store.write_items(sample.items(spark, sf_dir), path)
    return store.read_items(spark, path).select("id", "collection", "datetime", "cloud_cover", "title")


@case(
    "sink_items_dated",
    "SELECT id, collection, datetime IS NOT NULL AS has_datetime, CAST(coalesce(datetime, start_datetime) AS DATE) AS item_date FROM items_v",
)
def sink_items_dated(spark, sf_dir):
    path = fresh_dir(spark, "store")
    store.write_items(sample.items(spark, sf_dir), path, by_date=True)
    return store.read_items(spark, path).select("id", "collection", "has_datetime", "item_date")


@case("sink_items_by_place", f"SELECT id, collection, title FROM items_v WHERE {SQL_BOX}")
def sink_items_by_place(spark, sf_dir):
    # along a curve over the map, so that the box reads few pages
    path = fresh_dir(spark, "store")
    store.write_items(sample.items(spark, sf_dir), path, by_place=True)
    items = store.read_items(spark, path)
    return items.filter(by_bbox(Fields.of(items), BOX)).select("id", "collection", "title")


@case(
    "sink_upsert",
    "SELECT id, collection, CASE WHEN event_id % 4 = 1 THEN 'changed' ELSE title END AS title FROM items_v WHERE event_id % 2 = 1 OR event_id % 3 = 0",
)
def sink_upsert(spark, sf_dir):
    # odd items are stored; then a quarter is replaced and every third inserted or replaced as it is
    path = fresh_dir(spark, "store")
    items = sample.items(spark, sf_dir)
    store.write_items(items.filter(number() % 2 == 1), path, by_date=True)
    changed = items.filter((number() % 4 == 1) | (number() % 3 == 0)).withColumn(
        "title", F.when(number() % 4 == 1, F.lit("changed")).otherwise(F.col("title")))
    store.upsert_store(changed, path, by_date=True)
    return store.read_items(spark, path).select("id", "collection", "title")


@case("sink_delete", "SELECT id, collection FROM items_v WHERE collection <> 'c4' AND event_id % 5 <> 2")
def sink_delete(spark, sf_dir):
    path = fresh_dir(spark, "store")
    items = sample.items(spark, sf_dir)
    store.write_items(items, path)
    # one collection is emptied by keys, others lose some items
    store.delete_from_store(items.filter((F.col("collection") == "c4") | (number() % 5 == 2)), path)
    return store.read_items(spark, path).select("id", "collection")


@case("sink_rename", "SELECT id, CASE WHEN collection = 'c5' THEN 'c5-new' ELSE collection END AS collection FROM items_v WHERE collection <> 'c6'")
def sink_rename(spark, sf_dir):
    path = fresh_dir(spark, "store")
    store.write_items(sample.items(spark, sf_dir), path)
    store.rename_in_store(spark, path, "c5", "c5-new")
    store.drop_collection_from_store(spark, path, "c6")
    return store.read_items(spark, path).select("id", "collection")


@case("require_primary_datetime", "SELECT id, datetime IS NOT NULL AS accepted FROM items_v")
def require_primary_datetime(spark, sf_dir):
    good, bad = writes.split_primary_datetime(sample.items(spark, sf_dir))
    return good.select("id", F.lit(True).alias("accepted")).unionAll(bad.select("id", F.lit(False).alias("accepted")))


@case(
    "rewrite_assets",
    "SELECT id, collection, k AS es_key, 's3://bucket/' || id || '/' || lower(k) AS href FROM items_v, (VALUES ('B1'), ('B2'), ('meta')) AS t(k)",
)
def rewrite_assets(spark, sf_dir):
    path, target = fresh_dir(spark, "store"), fresh_dir(spark, "rewritten")
    store.write_items(nested_items(spark, sf_dir), path)
    store.rewrite_assets(spark, path, target)
    rows = store.read_items(spark, target).select("id", "collection", F.explode("assets").alias("a"))
    return rows.select("id", "collection", "a.es_key", "a.href")


# ---------------------------------------------------------------- patches


def documents(spark, sf_dir):
    """Item documents with a list and a nested object."""
    items = sample.items(spark, sf_dir)
    text = F.to_json(F.struct(
        "id", "collection",
        F.struct(
            F.date_format("raw_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), "platform", "cloud_cover",
            F.array(F.lit("a"), F.lit("b"), "title").alias("keywords"),
            F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")).alias("nested"),
        ).alias("properties"),
    ), {"ignoreNullFields": "true"})
    return items.select("collection", "id", text.alias("document"))


def patches(spark, sf_dir, kind, text, where):
    items = sample.items(spark, sf_dir)
    return items.filter(where).select("collection", "id", F.lit(kind).alias("kind"), text.alias("patch"))


def read(path, kind="string"):
    return F.get_json_object("document", f"$.properties.{path}").cast(kind)


@case(
    "m_merge_patch",
    "SELECT id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE platform END AS platform, CASE WHEN event_id % 3 = 0 THEN event_id ELSE cloud_cover END::BIGINT AS cloud_cover, "
    "CASE WHEN event_id % 3 = 0 THEN 7 ELSE 1 END AS x, 2 AS y, CASE WHEN event_id % 3 = 0 THEN 'made' END AS deep FROM items_v",
)
def merge_patch(spark, sf_dir):
    text = F.concat(
        F.lit('{"properties":{"platform":null,"nested":{"x":7},"new":{"deep":"made"},"cloud_cover":'),
        number().cast("string"), F.lit("}}"))
    done = patch.patch_items(documents(spark, sf_dir), patches(spark, sf_dir, "merge", text, number() % 3 == 0))
    return done.select("id", read("platform").alias("platform"), read("cloud_cover", "bigint").alias("cloud_cover"),
                       read("nested.x", "int").alias("x"), read("nested.y", "int").alias("y"), read("new.deep").alias("deep"))


@case(
    "m_json_patch",
    "SELECT id, p AND platform IS NOT NULL AS moved, CASE WHEN p AND platform IS NOT NULL THEN 'b' ELSE 'a' END AS first, "
    "CASE WHEN p AND platform IS NOT NULL THEN 'end' ELSE title END AS last, CASE WHEN p AND platform IS NULL THEN 'properties/platform does not exist' END AS error "
    "FROM (SELECT *, event_id % 2 = 0 AS p FROM items_v)",
)
def json_patch(spark, sf_dir):
    text = F.lit(
        '[{"op":"test","path":"properties/nested/y","value":2},{"op":"remove","path":"properties/keywords/0"},'
        '{"op":"add","path":"properties/keywords/-","value":"end"},'
        '{"op":"move","from":"properties/platform","path":"properties/source"}]')
    done = patch.patch_items(documents(spark, sf_dir), patches(spark, sf_dir, "json", text, number() % 2 == 0))
    words = F.from_json(F.get_json_object("document", "$.properties.keywords"), "array<string>")
    return done.select("id", read("source").isNotNull().alias("moved"), F.get(words, 0).alias("first"),
                       F.element_at(words, -1).alias("last"), "error")


@case(
    "m_patch_move",
    "SELECT CASE WHEN event_id % 5 = 0 THEN id || '-moved' ELSE id END AS id, CASE WHEN event_id % 5 = 0 THEN 'c1' ELSE collection END AS collection, "
    "CASE WHEN event_id % 5 = 1 THEN 'collection nowhere does not exist' END AS error FROM items_v",
)
def patch_move(spark, sf_dir):
    target = F.when(number() % 5 == 0, F.lit("c1")).otherwise(F.lit("nowhere"))
    text = F.concat(F.lit('{"id":"'), "id", F.lit('-moved","collection":"'), target, F.lit('"}'))
    done = patch.patch_items(
        documents(spark, sf_dir), patches(spark, sf_dir, "merge", text, number() % 5 < 2), collections(spark, sf_dir))
    return done.select("id", "collection", "error")


@case(
    "m_patch_twice",
    "SELECT id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE cloud_cover END AS cloud_cover, CASE WHEN event_id % 3 = 0 THEN 'second' ELSE platform END AS platform FROM items_v",
)
def patch_twice(spark, sf_dir):
    # two patches of the same items, in turn
    one = patches(spark, sf_dir, "merge", F.lit('{"properties":{"cloud_cover":1,"platform":"first"}}'), number() % 3 == 0)
    two = patches(spark, sf_dir, "json", F.lit(
        '[{"op":"test","path":"properties/cloud_cover","value":1},{"op":"replace","path":"properties/cloud_cover","value":2},'
        '{"op":"replace","path":"properties/platform","value":"second"}]'), number() % 3 == 0)
    both = one.withColumn("seq", F.lit(1)).unionByName(two.withColumn("seq", F.lit(2)))
    done = patch.patch_items(documents(spark, sf_dir), both, order="seq")
    return done.select("id", read("cloud_cover", "int").alias("cloud_cover"), read("platform").alias("platform"))


def several_patches(spark, sf_dir):
    """Four patches of every third item in turn: a merge, an operation that fails where there is no platform, a malformed one, a merge."""
    where, seq = number() % 3 == 0, iter(range(4))
    texts = [
        ("merge", F.lit('{"properties":{"cloud_cover":null,"new":{"a":1}}}')), ("json", F.lit('[{"op":"replace","path":"properties/platform","value":"x"}]')),
        ("merge", F.lit('{"properties":')), ("merge", F.lit('{"properties":{"cloud_cover":{"low":1},"new":{"b":2}}}'))]
    frames = [patches(spark, sf_dir, kind, text, where).withColumn("seq", F.lit(next(seq))) for kind, text in texts]
    return reduce(lambda a, b: a.unionByName(b), frames)


@case(
    "m_patch_some_fail",
    "SELECT id, CASE WHEN p AND platform IS NOT NULL THEN 'x' ELSE platform END AS platform, CASE WHEN NOT p THEN 0 WHEN platform IS NULL THEN 2 ELSE 1 END AS failed, "
    "CASE WHEN p THEN 1 END AS low, CASE WHEN p THEN 3 END AS ab FROM (SELECT *, event_id % 3 = 0 AS p FROM items_v)",
)
def patch_some_fail(spark, sf_dir):
    done = patch.patch_items(documents(spark, sf_dir), several_patches(spark, sf_dir), order="seq")
    return done.select("id", read("platform").alias("platform"), F.col("failed").cast("int").alias("failed"), read("cloud_cover.low", "int").alias("low"),
                       (read("new.a", "int") + read("new.b", "int")).alias("ab"))


@case(
    "m_patch_failures",
    "SELECT id, 'merge' AS kind FROM items_v WHERE event_id % 3 = 0 UNION ALL SELECT id, 'json' FROM items_v WHERE event_id % 3 = 0 AND platform IS NULL",
)
def patch_failures(spark, sf_dir):
    return patch.patch_failures(documents(spark, sf_dir), several_patches(spark, sf_dir), "seq").select("id", "kind")


_TAKEN = "event_id % 4 = 1 AND 'e' || (event_id + 1) {0} (SELECT id FROM items_v)"


@case(
    "m_patch_move_taken",
    f"SELECT id, CASE WHEN {_TAKEN.format('IN')} THEN concat('Item ', chr(39), 'e', event_id + 1, chr(39), ' already exists in collection ', chr(39), 'one', chr(39)) "
    f"END AS error, CASE WHEN {_TAKEN.format('NOT IN')} THEN 'e' || (event_id + 1) ELSE id END AS new_id FROM items_v",
)
def patch_move_taken(spark, sf_dir):
    # every fourth item wants the id of its neighbour
    rows = documents(spark, sf_dir).withColumns({"collection": F.lit("one"), "was": F.col("id"), "document": F.to_json(F.struct("id"))})
    wanted = rows.filter(number() % 4 == 1).select("collection", "id", F.lit("merge").alias("kind"), F.concat(
        F.lit('{"id":"e'), (number() + 1).cast("string"), F.lit('"}')).alias("patch"))
    return patch.patch_items(rows, wanted).select(F.col("was").alias("id"), "error", F.col("id").alias("new_id"))


@case(
    "m_patch_store",
    "SELECT CASE WHEN event_id % 5 = 0 THEN id || '-moved' ELSE id END AS id, CASE WHEN event_id % 5 = 0 THEN 'c1' ELSE collection END AS collection, "
    "CASE WHEN event_id % 5 = 1 THEN 99 ELSE cloud_cover END AS cloud_cover FROM items_v",
)
def patch_in_store(spark, sf_dir):
    path = fresh_dir(spark, "store")
    store.write_items(documents(spark, sf_dir), path)
    text = F.when(number() % 5 == 1, F.lit('{"properties":{"cloud_cover":99}}')).otherwise(
        F.concat(F.lit('{"id":"'), "id", F.lit('-moved","collection":"c1"}')))
    store.patch_store(spark, path, patches(spark, sf_dir, "merge", text, number() % 5 < 2), collections(spark, sf_dir))
    return store.read_items(spark, path).select("id", "collection", read("cloud_cover", "int").alias("cloud_cover"))


@case(
    "m_patch_guard",
    "SELECT id, CASE WHEN event_id % 4 = 0 THEN 'properties.datetime decides where the item is stored and cannot be patched' END AS error, "
    "CASE WHEN event_id % 4 = 1 THEN 1 ELSE cloud_cover END AS cloud_cover FROM items_v",
)
def patch_guard(spark, sf_dir):
    change = F.when(number() % 4 == 0, F.lit('"datetime":"2030-01-01T00:00:00Z",')).otherwise(F.lit(""))
    text = F.concat(F.lit('{"properties":{'), change, F.lit('"cloud_cover":1}}'))
    done = patch.patch_items(
        documents(spark, sf_dir), patches(spark, sf_dir, "merge", text, number() % 4 < 2), dated=True)
    return done.select("id", "error", read("cloud_cover", "int").alias("cloud_cover"))


@case("j_patch", "SELECT 'e' || (event_id * 2) AS id FROM events WHERE event_id * 2 NOT IN (SELECT event_id FROM events)", views=None)
def unmatched(spark, sf_dir):
    # patches for twice every item number: the upper half names items that are not there
    items = sample.items(spark, sf_dir).select("collection", "id")
    doubled = items.select(F.lit("any").alias("collection"), F.concat(F.lit("e"), (number() * 2).cast("string")).alias("id"))
    return patch.unmatched_patches(items.withColumn("collection", F.lit("any")), doubled).select("id")


# ---------------------------------------------------------------- collections


def suppliers(spark, sf_dir):
    rows = sample.table(spark, sf_dir, "supplier")
    return rows.select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"),
                       F.lit("Collection").alias("type"), F.col("s_name").alias("title"))


@case("m_collection_create", "SELECT 'c' || s_suppkey AS id, s_name AS title, '' AS license FROM supplier", views=None)
def collection_create(spark, sf_dir):
    rows = suppliers(spark, sf_dir)
    old = projection.with_defaults(rows.filter(F.col("id") < "c5"))
    fresh, _ = writes.split_conflicts(projection.with_defaults(rows), old, key=("id",))
    return writes.create_strict(old, fresh, key=("id",)).select("id", "title", "license")


@case("m_collection_update", "SELECT 'c' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'new title' ELSE s_name END AS title FROM supplier", views=None)
def collection_update(spark, sf_dir):
    rows = suppliers(spark, sf_dir)
    new = rows.filter(number() % 2 == 0).withColumn("title", F.lit("new title"))
    return writes.replace_existing(rows, new, key=("id",)).select("id", "title")


@case("m_collection_delete", "SELECT 'item' AS kind, id FROM items_v WHERE collection <> 'c3' UNION ALL "
      "SELECT 'collection', id FROM collections_v WHERE id <> 'c3'", views=COLLECTIONS)
def collection_delete(spark, sf_dir):
    left, items = writes.drop_collection(collections(spark, sf_dir), sample.items(spark, sf_dir), "c3")
    return items.select(F.lit("item").alias("kind"), "id").unionAll(left.select(F.lit("collection").alias("kind"), "id"))


@case("m_collection_patch", "SELECT 'c' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'open' END AS license FROM supplier", views=None)
def collection_patch(spark, sf_dir):
    rows = suppliers(spark, sf_dir)
    documents_ = rows.select(F.lit("").alias("collection"), "id", F.to_json(F.struct("id", "title")).alias("document"))
    changes = documents_.filter(number() % 2 == 0).select(
        "collection", "id", F.lit("merge").alias("kind"), F.lit('{"license":"open"}').alias("patch"))
    done = patch.patch_items(documents_, changes)
    return done.select("id", F.get_json_object("document", "$.license").alias("license"))


