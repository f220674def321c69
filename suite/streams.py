"""Streaming ingest over the line items and events, drained once."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.functions.times import rfc3339
from geoledger.operators import validation
from geoledger.operators.writes import dedupe_last
from geoledger.session import materialised
from geoledger.sources import sample, store
from geoledger.streaming import flushes, ingest
from suite.registry import case
from suite.scratch import fresh_dir
from suite.writes import LINE_ORDER, LINES, batch, order

NOW = "2024-03-01T12:00:00Z"


def price_error(df: DataFrame):
    return F.when(F.col("l_extendedprice") < 2000, F.lit("price too small"))


def drain(spark: SparkSession, queued: DataFrame, error=price_error, by_date: bool = False) -> tuple[str, str]:
    """Queue rows as files, run the stream over all of them, return the store's and the dead letters' folders."""
    folder, target, dead, state = (fresh_dir(spark, n) for n in ("queue", "store", "dead", "state"))
    queued.write.parquet(folder)
    pending = ingest.pending_files(spark, folder, queued.schema, fmt="parquet")
    job = ingest.IngestJob(
        target, dead, lambda df: [F.col(c) for c in LINE_ORDER if c in df.columns], lambda: NOW, by_date, error=error)
    query = job.start(pending, state, available_now=True)
    query.awaitTermination()
    return target, dead


@case("st_upsert_sink", "SELECT id, collection, l_quantity FROM last_v WHERE l_extendedprice >= 2000", views=LINES)
def upsert_sink(spark, sf_dir):
    target, _ = drain(spark, batch(spark, sf_dir))
    return store.read_items(spark, target).select("id", "collection", "l_quantity")


@case("st_dlq", "SELECT id, collection, 'price too small' AS error FROM last_v WHERE l_extendedprice < 2000", views=LINES)
def dead_letters(spark, sf_dir):
    _, dead = drain(spark, batch(spark, sf_dir))
    return ingest.read_dead_letters(spark, dead).select("id", "collection", "error")


def located(rows: DataFrame) -> DataFrame:
    """The rows with a position, as a box without extent."""
    lon = (F.col("l_partkey") * 37 % 3600).cast("double") / 10 - 180
    lat = (F.col("l_suppkey") * 53 % 1700).cast("double") / 10 - 85
    return rows.withColumns({"minx": lon, "miny": lat, "maxx": lon, "maxy": lat})


def posted(df: DataFrame) -> Column:
    """The document (VARIANT) that a row with a position was posted as."""
    times = [rfc3339(F.col(c)).alias(c) for c in ("datetime", "start_datetime", "end_datetime")]
    point = F.struct(F.lit("Point").alias("type"), F.array("minx", "miny").alias("coordinates"))
    return F.parse_json(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), "id", "collection", point.alias("geometry"),
        F.array("minx", "miny", "maxx", "maxy").alias("bbox"), F.struct(*times).alias("properties"),
        F.array().cast("array<string>").alias("links"), F.create_map().cast("map<string,string>").alias("assets"),
    ), {"ignoreNullFields": "false"}))


def every_rule(df: DataFrame) -> Column:
    """Schema of the document, which is built once per row, then time, then topology."""
    schema = F.get(F.transform(F.array(posted(df)), lambda document: validation.schema_error(document)), F.lit(0))
    return F.coalesce(schema, validation.item_error(df))


@case("st_validate", "SELECT id, l_quantity FROM last_v", views=LINES)
def validated(spark, sf_dir):
    # rows that were not checked before they were queued are checked by the stream, which stores the valid ones
    target, _ = drain(spark, located(batch(spark, sf_dir)), error=every_rule)
    return store.read_items(spark, target).select("id", "l_quantity")


@case(
    "st_late",
    "SELECT id, collection, CAST(datetime AS DATE) AS item_date FROM items_v WHERE datetime IS NOT NULL",
)
def late(spark, sf_dir):
    # the newest items are stored first; older ones arrive later and are all kept
    items = sample.items(spark, sf_dir).filter(F.col("datetime").isNotNull())
    new = F.col("datetime") >= F.lit("2024-01-20").cast("timestamp_ntz")
    target, dead, state = (fresh_dir(spark, n) for n in ("store", "dead", "state"))
    store.write_items(items.filter(new), target, by_date=True)
    folder = fresh_dir(spark, "queue")
    items.filter(~new).write.parquet(folder)
    pending = ingest.pending_files(spark, folder, items.schema, fmt="parquet")
    job = ingest.IngestJob(target, dead, lambda df: [F.col("raw_ts")], lambda: NOW, by_date=True)
    job.start(pending, state, available_now=True).awaitTermination()
    return store.read_items(spark, target).select("id", "collection", "item_date")


@case(
    "st_pending_view",
    "SELECT id, collection FROM last_v WHERE l_orderkey % 3 <> 0 AND l_extendedprice >= 2000", views=LINES,
)
def pending_view(spark, sf_dir):
    # the stream takes every third order and the cheap lines, which become dead letters; then all are queued, and the others wait
    queued = batch(spark, sf_dir).withColumn("queued_at", F.lit("2024-03-01 12:00:00").cast("timestamp_ntz"))
    last = dedupe_last(queued, order())
    target, dead = drain(spark, last.filter((F.col("l_orderkey") % 3 == 0) | (F.col("l_extendedprice") < 2000)))
    view = ingest.pending_view(queued, store.read_items(spark, target), ingest.read_dead_letters(spark, dead), order())
    return view.select("id", "collection")


@case("st_withdrawn", "SELECT id, l_quantity, 'stored' AS state FROM last_v WHERE l_orderkey % 4 <> 0 UNION ALL "
      "SELECT id, l_quantity, 'waiting' FROM last_v WHERE l_orderkey % 4 = 1", views=LINES)
def withdrawn(spark, sf_dir):
    # every fourth order is taken out of the queue before the stream runs, the next ones are still listed as waiting
    folder, target, dead, state, gone = (fresh_dir(spark, n) for n in ("queue", "store", "dead", "state", "gone"))
    rows = batch(spark, sf_dir)
    rows.write.parquet(folder)
    ingest.withdraw(rows.filter(F.col("l_orderkey") % 4 == 0), gone)
    job = ingest.IngestJob(target, dead, lambda df: [F.col(c) for c in LINE_ORDER], lambda: NOW, withdrawn=gone,
                           error=lambda df: F.lit(None).cast("string"))
    job.start(ingest.pending_files(spark, folder, rows.schema, fmt="parquet"), state, available_now=True).awaitTermination()
    stored = store.read_items(spark, target).select("id", "l_quantity", F.lit("stored").alias("state"))
    last = dedupe_last(rows, order()).filter(F.col("l_orderkey") % 4 < 2)
    waiting = ingest.pending_ids(last, spark.read.parquet(gone)).join(last.select("collection", "id", "l_quantity"), ["collection", "id"])
    return stored.unionByName(waiting.select("id", "l_quantity", F.lit("waiting").alias("state")))


@case(
    "st_requeued",
    "SELECT id, CASE WHEN l_orderkey % 4 = 0 AND l_orderkey % 8 <> 0 THEN NULL WHEN l_orderkey % 8 = 0 THEN l_quantity + 1000 ELSE l_quantity END AS l_quantity, "
    "CASE WHEN l_orderkey % 4 = 0 AND l_orderkey % 8 <> 0 THEN 'withdrawn' WHEN l_extendedprice < 2000 AND l_orderkey % 8 <> 0 THEN 'dead' ELSE 'stored' END AS state "
    "FROM last_v",
    views=LINES,
)
def requeued(spark, sf_dir):
    # every fourth order is withdrawn; every second of these is queued again later, at a price that passes; the cheap lines of the others fail
    folder, target, dead, state, gone = (fresh_dir(spark, n) for n in ("queue", "store", "dead", "state", "gone"))
    rows = batch(spark, sf_dir).withColumn("queued_at", F.lit("2024-03-01 10:00:00").cast("timestamp"))
    job = ingest.IngestJob(target, dead, lambda df: [F.col("queued_at"), *[F.col(c) for c in LINE_ORDER]], lambda: NOW, withdrawn=gone, error=price_error)

    def queue(some):
        some.write.mode("append").parquet(folder)
        job.start(ingest.pending_files(spark, folder, rows.schema, fmt="parquet"), state, available_now=True).awaitTermination()

    ingest.withdraw(rows.filter(F.col("l_orderkey") % 4 == 0), gone, "2024-03-01 11:00:00")
    queue(rows)
    again = rows.filter(F.col("l_orderkey") % 8 == 0).withColumns({
        "queued_at": F.lit("2024-03-01 12:00:00").cast("timestamp"), "l_quantity": F.col("l_quantity") + 1000, "l_extendedprice": F.lit(5000.0)})
    queue(again.withColumn("l_extendedprice", F.col("l_extendedprice").cast(rows.schema["l_extendedprice"].dataType)))
    last = dedupe_last(rows, order())
    stored = store.read_items(spark, target).select("id", "collection", F.col("l_quantity").alias("now"), F.lit("stored").alias("s"))
    failed = ingest.read_dead_letters(spark, dead).select("id", "collection", F.lit("dead").alias("d"))
    found = last.join(stored, ["collection", "id"], "left").join(failed, ["collection", "id"], "left")
    state_ = F.coalesce("s", "d", F.lit("withdrawn"))
    return found.select("id", F.when(F.col("s").isNotNull(), F.col("now")).when(F.col("d").isNotNull(), F.col("l_quantity")).alias("l_quantity"), state_.alias("state"))


@case("st_order", "SELECT id, l_quantity, epoch_us(datetime) / 1000000.0::DOUBLE AS score FROM last_v", views=LINES)
def oldest_first(spark, sf_dir):
    # of the versions of a key that wait in one flush, that of the highest score and order stays
    from geoledger.functions.times import queue_score, rfc3339

    target, _ = drain(spark, batch(spark, sf_dir), error=lambda df: F.lit(None).cast("string"))
    return store.read_items(spark, target).select("id", "l_quantity", queue_score(rfc3339(F.col("datetime"))).alias("score"))


def deliver(spark: SparkSession, deliveries: list[DataFrame], job_options: dict | None = None, files: int | None = None,
            fail_first: bool = False) -> DataFrame:
    """Queue several deliveries one after the other, draining the stream after each; the store's content."""
    folder, target, dead, state = (fresh_dir(spark, n) for n in ("queue", "store", "dead", "state"))
    options = {"error": price_error, **(job_options or {})}
    for number, rows in enumerate(deliveries):
        rows.write.mode("append").parquet(folder)
        pending = ingest.pending_files(spark, folder, rows.schema, files, fmt="parquet")
        job = ingest.IngestJob(
            target, dead, lambda df: [F.col(c) for c in LINE_ORDER if c in df.columns], lambda: NOW, **options)
        if fail_first and number == 0:
            lost = ingest.IngestJob(
                target, dead, job.order, job.now, error=job.error)
            write = lost.run_batch

            def write_and_die(batch, batch_id):
                write(batch, batch_id)
                raise RuntimeError("lost before the commit")

            lost.run_batch = write_and_die
            try:
                lost.start(pending, state, available_now=True).awaitTermination()
            except Exception as err:  # noqa: BLE001
                if "lost before the commit" not in str(err):
                    raise
        job.start(pending, state, available_now=True).awaitTermination()
    return store.read_items(spark, target)


_SOURCE = LINES.replace("FROM lineitem)", "FROM lineitem WHERE l_suppkey % 4 <> 0)")


@case("st_source", "SELECT id, l_quantity FROM last_v WHERE l_extendedprice >= 2000", views=_SOURCE)
def source(spark, sf_dir):
    # rows that arrive without an id are skipped
    rows = batch(spark, sf_dir)
    return deliver(spark, [rows.withColumn("id", F.when(F.col("l_suppkey") % 4 != 0, F.col("id")))]).select("id", "l_quantity")


@case(
    "st_latest_wins",
    "SELECT id, CASE WHEN l_orderkey % 5 = 0 THEN l_quantity + 1000 ELSE l_quantity END AS l_quantity FROM last_v WHERE l_extendedprice >= 2000",
    views=LINES,
)
def latest_wins(spark, sf_dir):
    # every fifth order is queued again later with another quantity
    rows = batch(spark, sf_dir)
    again = rows.filter(F.col("l_orderkey") % 5 == 0).withColumn("l_quantity", F.col("l_quantity") + 1000)
    return deliver(spark, [rows, again]).select("id", "l_quantity")


@case("st_trigger", "SELECT id, collection, l_orderkey FROM last_v", views=LINES)
def trigger(spark, sf_dir):
    # several files, one per flush; which version of a key stays depends on their order, the keys do not
    rows = batch(spark, sf_dir).repartition(3)
    stored = deliver(spark, [rows], {"error": lambda df: F.lit(None).cast("string")}, files=1)
    return stored.select("id", "collection", "l_orderkey")


_SOME = LINES + (
    ", some_v AS (SELECT * FROM last_v WHERE l_linenumber <= 1 + CAST(substr(collection, 2) AS INTEGER) % 4), "
    "full_v AS (SELECT collection FROM some_v GROUP BY collection HAVING count(*) >= 150)"
)


@case(
    "st_flush",
    "SELECT id, collection, l_quantity, CASE WHEN collection IN (SELECT collection FROM full_v) THEN 'items' ELSE 'time' END AS reason FROM some_v",
    views=_SOME,
)
def flush(spark, sf_dir):
    # collections of which 150 items wait are flushed at the first look, the others at the next, when nothing is queued but their time has come
    folder, target, dead, state, waiting = (fresh_dir(spark, n) for n in ("queue", "store", "dead", "state", "waiting"))
    rows = batch(spark, sf_dir)
    rows.filter(F.col("l_linenumber") <= 1 + F.substring("collection", 2, 20).cast("int") % 4).write.parquet(folder)
    for seconds, reason in ((0, "items"), (30, "time")):
        look = datetime(2024, 3, 1, 12, tzinfo=timezone.utc) + timedelta(seconds=seconds)
        job = ingest.IngestJob(target, dead, lambda df: [F.col(c) for c in LINE_ORDER], lambda: NOW,
                               error=lambda df: F.lit(None).cast("string"))
        flushing = flushes.FlushingJob(job, waiting, items=150, seconds=30, clock=lambda look=look: look)
        flushing.start(ingest.pending_files(spark, folder, rows.schema, fmt="parquet"), state, available_now=True).awaitTermination()
        if reason == "items":
            at_once = materialised(store.read_items(spark, target).select("collection").distinct())
    full = at_once.withColumn("reason", F.lit("items"))
    return store.read_items(spark, target).join(full, "collection", "left").select(
        "id", "collection", "l_quantity", F.coalesce("reason", F.lit("time")).alias("reason"))


@case("st_retry", "SELECT id, l_quantity FROM last_v WHERE l_extendedprice >= 2000", views=LINES)
def retry(spark, sf_dir):
    # the first run dies after it wrote and before it was committed
    return deliver(spark, [batch(spark, sf_dir)], fail_first=True).select("id", "l_quantity")
