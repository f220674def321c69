"""Queued ingest as one Structured Streaming query.

Pending items are files in a folder (or any other stream with the same columns). Each micro-batch keeps the last
row per key, validates, upserts the valid rows and files the invalid ones as dead letters. The stream's
checkpoint is what "removed from the queue" was. A batch that fails half-way is run again in full: the upsert
goes by key and the dead letters by batch number, so a second run leaves the same result.

Every queued row has a time, its `queued_at`, or else that of its file. A withdrawal is a tombstone with a time: it takes
out the versions queued up to then, and an item queued again later is stored. A dead letter speaks of one version
likewise, and a later version that is stored clears it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoledger.operators.projection import prepare_items
from geoledger.operators.validation import item_error
from geoledger.operators.writes import KEY, dedupe_last
from geoledger.session import materialised, step
from geoledger.sources.store import exists, upsert_store

# Fixed value: flush interval of the queue. A flush takes what waits by then, at most `files_per_batch` files of it.
FLUSH_SECONDS = 30
# The column that holds the time of a queued row's file.
FILE_TIME = "_file_time"
DEAD_LETTERS = "collection string, id string, error string, queued_at timestamp, batch_id long"


@dataclass
class IngestJob:
    """Where a stream writes and how it judges rows.

    `order` decides which of several rows of a key is the last. `validate` is off when the rows were checked
    before they were queued. Versions that the table `withdrawn` takes out, where there is one, are left out.
    """

    store: str
    dead_letters: str
    order: Callable[[DataFrame], Sequence[Column]]
    now: Callable[[], str]
    by_date: bool = False
    use_datetime: bool = True
    validate: bool = True
    error: Callable[[DataFrame], Column] = item_error
    withdrawn: str | None = None

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; safe to repeat. Its intermediate tables go with it."""
        spark = batch.sparkSession
        with step(spark):
            if self.withdrawn and exists(spark, self.withdrawn):
                # before the last version is chosen: an older one may have been queued after the withdrawal
                batch = standing(batch, spark.read.parquet(self.withdrawn), "withdrawn_at")
            unique = prepare_items(dedupe_last(batch, self.order(batch)), self.now())
            error = self.error(unique) if self.validate else F.lit(None).cast("string")
            marked = materialised(unique.withColumn("_error", error))
            letters = marked.select(*KEY, F.col("_error").alias("error"), _queued_at(marked).alias("queued_at"))
            invalid = letters.filter(F.col("error").isNotNull())
            if exists(spark, self.dead_letters):
                # letters of earlier batches that this one clears are written as rows without a reason
                earlier = spark.read.schema(DEAD_LETTERS).parquet(self.dead_letters).filter(F.col("batch_id") < batch_id).select(*KEY).distinct()
                cleared = letters.filter(F.col("error").isNull()).join(earlier, list(KEY), "left_semi")
                invalid = materialised(invalid.unionByName(cleared))
            invalid.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.dead_letters)
            valid = marked.filter(F.col("_error").isNull()).drop("_error", FILE_TIME)
            if not valid.isEmpty():
                upsert_store(valid, self.store, self.by_date, self.use_datetime, written=True)

    def start(
        self, pending: DataFrame, checkpoint: str, available_now: bool = False, seconds: int = FLUSH_SECONDS
    ) -> StreamingQuery:
        """Run over the stream: everything there now, or a flush every few seconds."""
        writer = (
            pending.filter(F.col("id").isNotNull())
            .writeStream.foreachBatch(self.run_batch)
            .option("checkpointLocation", checkpoint)
        )
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
        return writer.trigger(**trigger).start()


def pending_files(
    spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None, fmt: str = "json"
) -> DataFrame:
    """Stream of queued rows from a folder of files. `files_per_batch` bounds a flush, as the batch size did.

    Rows are not dropped for being late: there is no watermark, and an old item simply lands in its partition.
    Rows without a `queued_at` of their own get the time of their file, which the store does not keep.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(folder)
    return rows if "queued_at" in rows.columns else rows.withColumn(FILE_TIME, F.col("_metadata.file_modification_time"))


def _queued_at(rows: DataFrame) -> Column:
    """When a row was queued; null where nothing says so."""
    names = [c for c in ("queued_at", FILE_TIME) if c in rows.columns]
    return (F.col(names[0]) if names else F.lit(None)).cast("timestamp")


def standing(rows: DataFrame, marks: DataFrame, at: str) -> DataFrame:
    """Rows that no mark of their key, set at the time `at`, stands against: an anti-join as of the time they were queued.

    Rows or marks without a time are compared by key alone.
    """
    when = F.col(at).cast("timestamp") if at in marks.columns else F.lit(None).cast("timestamp")
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    # keys in the order of the dedupe that follows
    last = marks.groupBy(*reversed(KEY)).agg(F.max(F.coalesce(when, never)).alias("_marked_at"))
    queued = F.coalesce(_queued_at(rows), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    joined = rows.withColumn("_at", queued).join(last, list(reversed(KEY)), "left")
    return joined.filter(F.col("_marked_at").isNull() | (F.col("_marked_at") < F.col("_at"))).select(*rows.columns)


def pending_view(queued: DataFrame, stored: DataFrame, dead: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Queued rows that are neither stored nor dead letters in this version, one per key, oldest first.

    A row counts as stored when the store's row of its key was written at or after it was queued
    (`queued_at` against `updated`).
    """
    latest = dedupe_last(queued, order)
    done = stored.select(*KEY, F.col("updated").alias("_updated"))
    left = latest.join(done, list(KEY), "left").filter(
        F.col("_updated").isNull() | (F.col("_updated") < F.col("queued_at"))).drop("_updated")
    return standing(left, dead, "queued_at")


def withdraw(keys: DataFrame, path: str, at: str | None = None) -> None:
    """Take items out of the queue: streams that know the table leave out the versions queued up to now, or up to `at` (UTC).

    Times of files come from the store of the queue; where its clock and the driver's differ, queue rows with a
    `queued_at` and give `at`.
    """
    time = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    keys.select(*KEY).withColumn("withdrawn_at", time).write.mode("append").parquet(path)


def pending_ids(pending: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """(collection, id) of every waiting item, without those withdrawn since they were queued."""
    left = pending if withdrawn is None else standing(pending, withdrawn, "withdrawn_at")
    return left.select(*KEY)


def pending_counts(pending: DataFrame) -> DataFrame:
    """Queue length per collection."""
    return pending.groupBy("collection").agg(F.count(F.lit(1)).alias("pending"))


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """(collection, id, error, queued_at) once per item whose latest outcome was a failure: its reason and when that version was queued."""
    if not exists(spark, path):
        return spark.createDataFrame([], DEAD_LETTERS).drop("batch_id")
    last = spark.read.schema(DEAD_LETTERS).parquet(path).groupBy(*reversed(KEY)).agg(
        F.max_by(F.struct("error", "queued_at"), "batch_id").alias("last"))
    return last.select(*KEY, "last.error", "last.queued_at").filter(F.col("error").isNotNull())
