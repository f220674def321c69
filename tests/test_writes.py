"""Batches, the store, the stream and patches."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from geoledger.functions.patching import PatchError, json_patch, merge_patch
from geoledger.operators import patch, writes
from geoledger.operators.validation import BatchRejected, check_threshold
from geoledger.session import materialised
from geoledger.sources import store
from geoledger.streaming import ingest

SCHEMA = (
    "id string, collection string, datetime timestamp_ntz, start_datetime timestamp_ntz, end_datetime timestamp_ntz, "
    "minx double, miny double, maxx double, maxy double, seq int, note string"
)
NOW = "2024-01-01T00:00:00Z"


def item(n, seq=0, collection="c1", note="", day=None, x=0.0):
    when = datetime(2020, 1, 1) + timedelta(days=n if day is None else day)
    return (f"i{n}", collection, when, None, None, x, 0.0, x, 0.0, seq, note)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return {(r["collection"], r["id"]): r["note"] for r in df.collect()}


@pytest.fixture()
def collections(spark):
    return spark.createDataFrame([("c1",), ("c2",), ("007",)], "id string")


def test_the_last_row_of_a_key_wins(spark):
    rows = frame(spark, [item(1, 0, note="old"), item(1, 2, note="new"), item(1, 1), item(2, 0), (None, *item(3)[1:])])
    kept = writes.dedupe_last(rows, [F.col("seq")])
    assert content(kept) == {("c1", "i1"): "new", ("c1", "i2"): ""}


def test_dedupe_limits_hot_keys_before_the_shuffle(spark):
    rows = frame(spark, [item(1, n) for n in range(50)])
    plan = writes.dedupe_last(rows, [F.col("seq")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_ingest_create(spark, collections):
    stored = frame(spark, [item(1, note="stored")])
    batch = frame(spark, [
        item(1, 5, note="again"), item(2, 1, note="a"), item(2, 2, note="b"), item(3, 0, "nowhere"), item(4, 0, x=200.0),
        (None, *item(9)[1:]),
    ])
    result = writes.ingest(batch, stored, collections, [F.col("seq")], NOW)
    assert content(result.accepted) == {("c1", "i2"): "b"}
    assert [r["message"] for r in result.conflicts.collect()] == ["Item 'i1' already exists in collection 'c1'"]
    assert [r["id"] for r in result.unknown.collect()] == ["i3"]
    invalid = result.invalid.collect()
    assert [r["id"] for r in invalid] == ["i4"] and invalid[0]["error"].startswith("Topology Error: ")
    assert result.summary.first().asDict() == {
        "input_count": 6, "processed_count": 4, "valid_count": 2, "skipped_total": 4, "validation_error_count": 1,
        "conflict_count": 1, "database_error_count": 1}


def test_ingest_upsert_twice_is_once(spark, collections):
    stored = frame(spark, [item(1, note="stored"), item(7, note="kept")]).withColumns(
        {"created": F.lit(None).cast("timestamp_ntz"), "updated": F.lit(None).cast("timestamp_ntz")})
    batch = frame(spark, [item(1, note="x"), item(2, note="y")])
    once = writes.upsert(stored, writes.ingest(batch, stored, collections, [F.col("seq")], NOW, "upsert").accepted)
    twice = writes.upsert(once, writes.ingest(batch, once, collections, [F.col("seq")], NOW, "upsert").accepted)
    assert content(once) == content(twice) == {("c1", "i1"): "x", ("c1", "i2"): "y", ("c1", "i7"): "kept"}
    assert twice.count() == 3


def test_thresholds(spark, collections):
    check_threshold(3, max_errors=3)
    for bad in ({"max_errors": 2}, {"strict": True}):
        with pytest.raises(BatchRejected):
            check_threshold(3, **bad)
    with pytest.raises(BatchRejected):
        writes.ingest(frame(spark, [item(1, x=999.0)]), frame(spark, []), collections, [F.col("seq")], NOW, strict=True)


def test_single_writes(spark):
    stored = frame(spark, [item(1)])
    with pytest.raises(ValueError):
        writes.create_strict(stored, frame(spark, [item(1)]))
    with pytest.raises(LookupError):
        writes.replace_existing(stored, frame(spark, [item(2)]))
    assert writes.create_strict(stored, frame(spark, [item(2)])).count() == 2


# ---------------------------------------------------------------- store


@pytest.mark.parametrize("by_date", [False, True])
def test_store_round_trip(spark, tmp_path, by_date):
    path = str(tmp_path / "items")
    rows = frame(spark, [item(n, collection="007" if n % 2 else "a/b=c", note="v1", day=n % 4) for n in range(40)])
    store.write_items(rows, path, by_date)
    assert content(store.read_items(spark, path)) == content(rows)
    # replace some, move one to another day, add one
    changed = frame(spark, [item(1, collection="007", note="v2", day=1), item(3, collection="007", note="moved", day=30), item(99, collection="new", note="n")])
    for _ in range(2):
        store.upsert_store(changed, path, by_date)
        got = store.read_items(spark, path)
        assert content(got) == {**content(rows), **content(changed)} and got.count() == 41
    # empty a collection
    store.delete_from_store(got.filter("collection = '007'"), path, by_date)
    left = store.read_items(spark, path)
    assert {r["collection"] for r in left.select("collection").distinct().collect()} == {"a/b=c", "new"}
    store.rename_in_store(spark, path, "a/b=c", "plain", by_date)
    assert {c for c, _ in content(store.read_items(spark, path))} == {"plain", "new"}
    store.drop_collection_from_store(spark, path, "new", by_date)
    assert store.read_items(spark, path).count() == 20


def test_a_search_reads_only_its_partitions(spark, tmp_path):
    from geoledger.plans.search import SearchRequest, search

    path = str(tmp_path / "items")
    rows = [item(n, collection=f"c{n % 3}", day=n % 10) for n in range(60)]
    rows += [(f"r{n}", "c1", None, datetime(2020, 1, 1 + n), datetime(2020, 2, 1), 0.0, 0.0, 0.0, 0.0, 0, "") for n in range(5)]
    store.write_items(frame(spark, rows), path, by_date=True)
    page = search(store.read_items(spark, path), SearchRequest(
        collections=["c1"], datetime="2020-01-04T00:00:00Z/2020-01-05T00:00:00Z", limit=100))
    assert page.rows.count() == len([r for r in rows if r[1] == "c1" and (r[2] is None and r[3] <= datetime(2020, 1, 5) or r[2] and datetime(2020, 1, 4) <= r[2] <= datetime(2020, 1, 5))])
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = page.rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    partition, pushed = (plan[plan.index(n):].split("]")[0] for n in ("PartitionFilters", "PushedFilters"))
    assert all(name in partition for name in ("collection", "item_date", "has_datetime"))
    assert "datetime" in pushed


# ---------------------------------------------------------------- stream


def job(path, **options):
    return ingest.IngestJob(
        f"{path}/store", f"{path}/dead", lambda df: [F.col("seq")], lambda: NOW, by_date=True, **options)


def test_stream_with_restart(spark, tmp_path):
    path, queue = str(tmp_path), str(tmp_path / "queue")
    frame(spark, [item(1, 0, note="a"), item(1, 1, note="b"), item(2, 0, x=500.0), item(3), (None, *item(9)[1:])]).write.json(queue)
    pending = ingest.pending_files(spark, queue, SCHEMA, files_per_batch=1)
    job(path).start(pending, f"{path}/state", available_now=True).awaitTermination()
    got = store.read_items(spark, f"{path}/store")
    assert set(content(got)) == {("c1", "i1"), ("c1", "i3")}
    # later files: a newer version, an older day, and a repaired item
    frame(spark, [item(1, 9, note="later"), item(40, day=-4000), item(2, 1, note="repaired")]).write.mode("append").json(queue)
    job(path).start(pending, f"{path}/state", available_now=True).awaitTermination()
    got = store.read_items(spark, f"{path}/store")
    assert content(got) == {("c1", "i1"): "later", ("c1", "i2"): "repaired", ("c1", "i3"): "", ("c1", "i40"): ""}
    assert got.count() == 4
    # the repaired item was stored, which clears its letter
    assert ingest.read_dead_letters(spark, f"{path}/dead").count() == 0


def test_a_batch_that_died_half_way_is_repeated(spark, tmp_path):
    path = str(tmp_path)
    rows = frame(spark, [item(1, note="a"), item(2, x=500.0), item(3)])
    queue = f"{path}/queue"
    rows.coalesce(1).write.json(queue)
    pending = ingest.pending_files(spark, queue, SCHEMA)

    broken = job(path)
    first_run = broken.run_batch

    def die_after_writing(batch, batch_id):
        first_run(batch, batch_id)
        raise RuntimeError("lost before the commit")

    broken.run_batch = die_after_writing
    with pytest.raises(Exception, match="lost before the commit"):
        broken.start(pending, f"{path}/state", available_now=True).awaitTermination()
    job(path).start(pending, f"{path}/state", available_now=True).awaitTermination()
    got = store.read_items(spark, f"{path}/store")
    assert content(got) == {("c1", "i1"): "a", ("c1", "i3"): ""} and got.count() == 2
    assert ingest.read_dead_letters(spark, f"{path}/dead").count() == 1


def test_key_sorts_begin_with_the_id_and_share_a_shuffle(spark):
    rows = frame(spark, [item(1, 1), item(1, 2), item(2, 1)])
    marks = rows.select("collection", "id", F.lit("2024-01-01").cast("timestamp").alias("withdrawn_at")).filter("id = 'i2'")
    last = writes.dedupe_last(ingest.standing(rows, marks.hint("merge"), "withdrawn_at"), [F.col("seq")])
    for found, shuffles in ((last, 2), (writes.mark_conflicts(writes.dedupe_last(rows, [F.col("seq")]), rows.hint("merge")), 2),
                            (writes.upsert(rows, rows), 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id#") == plan.count("Exchange hashpartitioning(") == shuffles
        assert "Sort [id#" in plan and "Sort [collection#" not in plan
    assert content(last) == {("c1", "i1"): ""}


def test_withdrawn_items_can_be_queued_again(spark, tmp_path):
    """Withdraw, queue again, drain: the item is stored. Times are those of the files."""
    import time

    path, queue = str(tmp_path), str(tmp_path / "queue")
    frame(spark, [item(1, note="old"), item(2), item(3, x=500.0)]).write.json(queue)
    time.sleep(1.1)
    ingest.withdraw(spark.createDataFrame([("c1", "i1"), ("c1", "i3")], "collection string, id string"), f"{path}/gone")
    ingest_job = job(path, withdrawn=f"{path}/gone")
    ingest_job.start(ingest.pending_files(spark, queue, SCHEMA), f"{path}/state", available_now=True).awaitTermination()
    assert content(store.read_items(spark, f"{path}/store")) == {("c1", "i2"): ""}
    assert ingest.read_dead_letters(spark, f"{path}/dead").count() == 0
    time.sleep(1.1)
    frame(spark, [item(1, note="again"), item(2, 1, x=500.0)]).write.mode("append").json(queue)
    ingest_job.start(ingest.pending_files(spark, queue, SCHEMA), f"{path}/state", available_now=True).awaitTermination()
    stored = store.read_items(spark, f"{path}/store")
    assert content(stored) == {("c1", "i1"): "again", ("c1", "i2"): ""} and ingest.FILE_TIME not in stored.columns
    assert [r["id"] for r in ingest.read_dead_letters(spark, f"{path}/dead").collect()] == ["i2"]


def test_marks_stand_against_earlier_versions_only(spark):
    rows = spark.createDataFrame([("c", "a", "2024-01-01"), ("c", "a", "2024-01-03"), ("c", "b", None), ("c", "d", "2024-01-01"), ("c", "e", "2024-01-02")],
                                 "collection string, id string, at string").withColumn("queued_at", F.col("at").cast("timestamp"))
    marks = spark.createDataFrame([("c", "a", "2024-01-02"), ("c", "a", "2023-01-01"), ("c", "b", "2024-01-02"), ("c", "e", "2024-01-02")],
                                  "collection string, id string, m string").withColumn("withdrawn_at", F.col("m").cast("timestamp")).drop("m")
    left = {(r["id"], r["at"]) for r in ingest.standing(rows, marks, "withdrawn_at").collect()}
    assert left == {("a", "2024-01-03"), ("d", "2024-01-01")}
    # marks without a time, and rows without one, are compared by key
    assert {r["id"] for r in ingest.standing(rows, marks.drop("withdrawn_at"), "withdrawn_at").collect()} == {"d"}
    assert {r["id"] for r in ingest.standing(rows.drop("queued_at"), marks, "withdrawn_at").collect()} == {"d"}
    view = ingest.pending_view(rows.filter("queued_at IS NOT NULL"), spark.createDataFrame([], "collection string, id string, updated timestamp"),
                               marks.withColumnRenamed("withdrawn_at", "queued_at"), [F.col("queued_at")])
    assert {(r["id"], r["at"]) for r in view.collect()} == {("a", "2024-01-03"), ("d", "2024-01-01")}


def test_flushes_leave_no_intermediate_tables(spark, tmp_path):
    from pathlib import Path

    from geoledger.session import job_dir

    folder = Path(job_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    path, queue = str(tmp_path), str(tmp_path / "queue")
    for note in ("a", "b"):
        frame(spark, [item(1, note=note), item(2, x=500.0)]).write.mode("append").json(queue)
        job(path).start(ingest.pending_files(spark, queue, SCHEMA), f"{path}/state", available_now=True).awaitTermination()
    assert set(folder.iterdir()) == before and store.read_items(spark, f"{path}/store").count() == 1


def test_no_dead_letters_yet(spark, tmp_path):
    assert ingest.read_dead_letters(spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- patches

DOC = {"id": "i", "p": {"a": 1, "list": [1, 2, 3], "deep": {"x": True}}}


@pytest.mark.parametrize("change, want", [
    ({"p": {"a": None, "b": 2}}, {"id": "i", "p": {"list": [1, 2, 3], "deep": {"x": True}, "b": 2}}),
    ({"p": {"deep": {"y": 1}}}, {"id": "i", "p": {"a": 1, "list": [1, 2, 3], "deep": {"x": True, "y": 1}}}),
    ({"q": {"r": {"s": 1, "t": None}}}, {**DOC, "q": {"r": {"s": 1}}}),
    ({"p": {"list": [9]}}, {"id": "i", "p": {"a": 1, "list": [9], "deep": {"x": True}}}),
    ({"p": {"a": {"b": 1}}}, {"id": "i", "p": {"a": {"b": 1}, "list": [1, 2, 3], "deep": {"x": True}}}),
    ({}, DOC),
])
def test_merge(change, want):
    assert merge_patch(DOC, change) == want


@pytest.mark.parametrize("ops, path, want", [
    ([{"op": "add", "path": "p/b", "value": 5}], ("p", "b"), 5),
    ([{"op": "add", "path": "/p/list/1", "value": 9}], ("p", "list"), [1, 9, 2, 3]),
    ([{"op": "add", "path": "/p/list/-", "value": 9}], ("p", "list"), [1, 2, 3, 9]),
    ([{"op": "add", "path": "/p/list/3", "value": 9}], ("p", "list"), [1, 2, 3, 9]),
    ([{"op": "replace", "path": "/p/list/0", "value": 9}], ("p", "list"), [9, 2, 3]),
    ([{"op": "remove", "path": "/p/list/-1"}], ("p", "list"), [1, 2]),
    ([{"op": "move", "from": "p/a", "path": "p/z"}], ("p",), {"list": [1, 2, 3], "deep": {"x": True}, "z": 1}),
    ([{"op": "move", "from": "p/list/0", "path": "p/list/2"}], ("p", "list"), [2, 3, 1]),
    ([{"op": "copy", "from": "p/a", "path": "p/z"}], ("p", "z"), 1),
    ([{"op": "copy", "from": "p/list/2", "path": "p/list/0"}], ("p", "list"), [3, 2, 3]),
    ([{"op": "test", "path": "p/deep/x", "value": True}, {"op": "remove", "path": "p/deep/x"}], ("p", "deep"), {}),
])
def test_operations(ops, path, want):
    found = json_patch(DOC, ops)
    for part in path:
        found = found[part]
    assert found == want and DOC["p"]["list"] == [1, 2, 3]


@pytest.mark.parametrize("op", [
    {"op": "remove", "path": "p/none"}, {"op": "replace", "path": "p/none", "value": 1}, {"op": "test", "path": "p/a", "value": 2},
    {"op": "add", "path": "none/a", "value": 1}, {"op": "remove", "path": "p/list/7"}, {"op": "move", "from": "x", "path": "y"},
    {"op": "copy", "from": "x", "path": "y"}, {"op": "add", "path": "p/list/x", "value": 1}, {"op": "what", "path": "p"},
])
def test_bad_operations(op):
    with pytest.raises(PatchError):
        json_patch(DOC, [op])


def test_patches_of_a_table(spark, collections):
    items = spark.createDataFrame(
        [(c, i, json.dumps({"id": i, "collection": c, "properties": {"datetime": "2020", "n": 1}})) for c, i in
         [("c1", "a"), ("c1", "b"), ("c2", "c"), ("c2", "d"), ("c2", "e")]], "collection string, id string, document string")
    patches = spark.createDataFrame([
        ("c1", "a", "merge", '{"properties": {"n": 2}}'),
        ("c1", "b", "json", '[{"op": "add", "path": "properties/n", "value": 3}, {"op": "remove", "path": "nope"}]'),
        ("c2", "c", "json", '[{"op": "replace", "path": "collection", "value": "c1"}]'),
        ("c2", "d", "merge", '{"properties": {"datetime": "2021"}}'),
        ("c9", "z", "merge", "{}"),
    ], "collection string, id string, kind string, patch string")
    got = {r["id"]: r for r in patch.patch_items(items, patches, collections, dated=True).collect()}
    assert json.loads(got["a"]["document"])["properties"]["n"] == 2
    assert json.loads(got["b"]["document"])["properties"]["n"] == 1 and got["b"]["error"]
    assert (got["c"]["collection"], got["c"]["error"]) == ("c1", None)
    assert got["d"]["error"] and json.loads(got["d"]["document"])["properties"]["datetime"] == "2020"
    assert got["e"]["error"] is None
    assert [r["id"] for r in patch.unmatched_patches(items, patches).collect()] == ["z"]


@pytest.mark.parametrize("by_date", [False, True])
def test_only_touched_partitions_are_read(spark, tmp_path, by_date):
    path, number = str(tmp_path / "store"), F.col("id")
    day = F.timestamp_seconds(number % 7 * 86400 + 1577836800).cast("timestamp_ntz")
    rows = spark.range(300).select(
        F.concat(F.lit("i"), number).alias("id"), F.when(number % 6 > 0, F.concat(F.lit("c"), number % 6)).alias("collection"),
        F.when(number % 5 > 0, day).alias("datetime"), F.lit(None).cast("timestamp_ntz").alias("start_datetime"))
    store.write_items(rows, path, by_date)
    stored, keys = store.read_items(spark, path), store.layout(by_date)
    some = (F.col("collection").isNull() | (F.col("collection") == "c2")) & (F.col("datetime").isNull() | (F.dayofmonth("datetime") == 2))
    touched = materialised(stored.filter(some).select(*keys).distinct())
    got = store.within(stored, touched, keys)
    want = stored.join(touched, [stored[k].eqNullSafe(touched[k]) for k in keys], "left_semi")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert "dynamicpruning#" in got._jdf.queryExecution().executedPlan().toString()
