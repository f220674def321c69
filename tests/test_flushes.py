"""Flushes by number of items or by time, per collection."""

import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from geoledger.sources import store
from geoledger.streaming import flushes, ingest
from tests.test_writes import SCHEMA, content, frame, item, job

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def drain(spark, path, after, **options):
    """look at the queue once, `after` seconds after the start."""
    flushing = flushes.FlushingJob(job(path), f"{path}/flush", clock=lambda: START + timedelta(seconds=after), **options)
    pending = ingest.pending_files(spark, f"{path}/queue", SCHEMA)
    flushing.start(pending, f"{path}/state", available_now=True).awaitTermination()


def stored(spark, path):
    return set(content(store.read_items(spark, f"{path}/store"))) if os.path.exists(f"{path}/store") else set()


def queue(spark, path, rows):
    frame(spark, rows).coalesce(1).write.mode("append").json(f"{path}/queue")


def test_items_or_time(spark, tmp_path):
    path = str(tmp_path)
    few = [item(n, collection="few") for n in range(2)]
    many = [item(n, collection="many") for n in range(3)]
    # versions of one item are one
    twice = [item(0, seq, collection="twice", note=str(seq)) for seq in range(5)]
    queue(spark, path, few + many + twice)
    drain(spark, path, 0, items=3, seconds=30)
    assert stored(spark, path) == {("many", f"i{n}") for n in range(3)}
    # the third item of a collection comes later, a fresh one comes too
    queue(spark, path, [item(7, collection="few"), item(1, collection="many"), item(1, collection="new")])
    drain(spark, path, 10, items=3, seconds=30)
    after_number = {("many", f"i{n}") for n in range(3)} | {("few", "i0"), ("few", "i1"), ("few", "i7")}
    assert stored(spark, path) == after_number
    # nothing is queued, but the time of what waits since the first look has come; "new" was first seen at 10, "few" is empty
    drain(spark, path, 31, items=3, seconds=30)
    assert stored(spark, path) == after_number | {("twice", "i0")}
    assert content(store.read_items(spark, f"{path}/store"))["twice", "i0"] == "4"
    drain(spark, path, 41, items=3, seconds=30)
    assert stored(spark, path) == after_number | {("twice", "i0"), ("new", "i1")}
    # batches that all collections are done with are gone
    drain(spark, path, 42, items=3, seconds=30)
    assert os.listdir(f"{path}/flush/waiting") == ["_batch=4"] and len(os.listdir(f"{path}/flush/state")) == 2


def test_dead_letters_and_rows_without_a_collection(spark, tmp_path):
    path = str(tmp_path)
    bad = item(5, collection="c1", x=500.0)
    queue(spark, path, [item(1), bad, (*item(9)[:1], None, *item(9)[2:])])
    drain(spark, path, 0, items=2, seconds=30)
    assert stored(spark, path) == {("c1", "i1")}
    assert [r["id"] for r in ingest.read_dead_letters(spark, f"{path}/dead").collect()] == ["i5"]
    drain(spark, path, 30, items=2, seconds=30)
    assert stored(spark, path) == {("c1", "i1"), (None, "i9")}


@pytest.mark.parametrize("where", ["decided", "flushed"])
def test_a_flush_that_died_is_finished(spark, tmp_path, where):
    path = str(tmp_path)
    queue(spark, path, [item(1), item(2), item(3, x=500.0), item(1, collection="c2")])
    flushing = flushes.FlushingJob(job(path), f"{path}/flush", items=3, clock=lambda: START)
    write = flushing.job.run_batch

    def die(batch, batch_id):
        if where == "flushed":
            write(batch, batch_id)
        raise RuntimeError("lost")

    flushing.job.run_batch = die
    pending = ingest.pending_files(spark, f"{path}/queue", SCHEMA)
    with pytest.raises(Exception, match="lost"):
        flushing.start(pending, f"{path}/state", available_now=True).awaitTermination()
    # the time of the second run does not change what the batch flushes
    again = flushes.FlushingJob(job(path), f"{path}/flush", items=3, clock=lambda: START + timedelta(seconds=99))
    again.run_batch(spark.read.schema(SCHEMA).json(f"{path}/queue").withColumn(flushes.TICK, F.lit(False)), 0)
    assert stored(spark, path) == {("c1", "i1"), ("c1", "i2")}
    assert [r["id"] for r in ingest.read_dead_letters(spark, f"{path}/dead").collect()] == ["i3"]


def test_time_comes_while_nothing_is_queued(spark, tmp_path):
    path = str(tmp_path)
    queue(spark, path, [item(1), item(2, collection="c2"), item(3, collection="c2")])
    flushing = flushes.FlushingJob(job(path), f"{path}/flush", items=2, seconds=6)
    stream = flushing.start(ingest.pending_files(spark, f"{path}/queue", SCHEMA), f"{path}/state", poll=1)
    seen, end = [], time.monotonic() + 90
    while time.monotonic() < end and len(seen) < 2:
        now = stored(spark, path) if os.path.exists(f"{path}/store/_SUCCESS") else set()
        if now and now not in seen:
            seen.append(now)
        time.sleep(0.3)
    stream.stop()
    c2 = {("c2", "i2"), ("c2", "i3")}
    assert seen == [c2, c2 | {("c1", "i1")}]
