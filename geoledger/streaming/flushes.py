"""Flushes by number or by time: a collection is flushed once N of its items wait, or T seconds after its last flush.

Every micro-batch files its rows as waiting and counts them by collection. Each task counts its own rows first, so the
rows of a hot collection stay spread. The state has one row per collection: how many rows wait, since which batch, and
when the collection was last flushed. It is a table with one version per batch, made from the version before it, and
what is due is part of it: a batch that is run again after a crash finds its version and finishes the same flush.

No row waits for longer than T and one trigger, so the waiting table holds no more than was queued in that time. A source
of ticks keeps batches coming while nothing is queued.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from geoledger.session import broadcast_if_small, materialised, step
from geoledger.sources.store import exists
from geoledger.streaming.ingest import FLUSH_SECONDS, IngestJob

# Fixed value: items of a collection that wait before they are flushed.
FLUSH_ITEMS = 10
# Seconds between two looks at the queue.
POLL_SECONDS = 5
TICK = "_tick"
BATCH = "_batch"
STATE = "collection string, waiting long, since long, last_flush timestamp, reason string, at timestamp"


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass
class FlushingJob:
    """A job whose collections are flushed one by one, when `items` of them wait or after `seconds`.

    `folder` holds the waiting rows and the state; it belongs to one stream, as its checkpoint does. Items are counted
    by id: versions of one item that wait together are one. Rows without a collection are a queue of their own.
    The clock of a collection starts when it is first seen. `clock` gives the time of a batch.
    """

    job: IngestJob
    folder: str
    items: int = FLUSH_ITEMS
    seconds: float = FLUSH_SECONDS
    clock: Callable[[], datetime] = utc_now

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; safe to repeat."""
        spark = batch.sparkSession
        with step(spark):
            rows = batch.filter(~F.col(TICK)).drop(TICK)
            if not exists(spark, f"{self._state(batch_id)}/_SUCCESS"):
                rows.write.mode("overwrite").parquet(self._waiting(batch_id))
                self._decide(rows, batch_id)
            due = self.state(spark, batch_id).filter(F.col("reason").isNotNull())
            if not due.isEmpty():
                self.job.run_batch(self._rows_of(due, rows.schema, batch_id), batch_id)
            self._forget(spark, batch_id)

    def start(self, pending: DataFrame, checkpoint: str, available_now: bool = False, poll: float = POLL_SECONDS) -> StreamingQuery:
        """Run over the stream. With `available_now` it takes what is there and flushes what is due; the rest waits for the next start."""
        spark = pending.sparkSession
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load().select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in pending.schema], F.lit(True).alias(TICK))
        stream = pending.filter(F.col("id").isNotNull()).withColumn(TICK, F.lit(False)).union(ticks)
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{poll} seconds"}
        return stream.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """(collection, waiting, since, last_flush, reason, at) as a batch decided it; `reason` is null where nothing is due."""
        if not exists(spark, self._state(batch_id)):
            return spark.createDataFrame([], STATE)
        return spark.read.schema(STATE).parquet(self._state(batch_id))

    def _waiting(self, batch_id: int) -> str:
        return f"{self.folder}/waiting/{BATCH}={batch_id}"

    def _state(self, batch_id: int) -> str:
        return f"{self.folder}/state/{BATCH}={batch_id}"

    def _rows_of(self, state: DataFrame, schema: T.StructType, batch_id: int) -> DataFrame:
        """Waiting rows of the given collections, up to this batch."""
        typed = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        rows = state.sparkSession.read.schema(typed).parquet(f"{self.folder}/waiting").filter(F.col(BATCH) <= batch_id)
        chosen = broadcast_if_small(state.select(F.col("collection").alias("_collection"), F.col("since").alias("_since")))
        same = rows["collection"].eqNullSafe(chosen["_collection"]) & (rows[BATCH] >= chosen["_since"])
        return rows.join(chosen, same, "left_semi").drop(BATCH)

    def _decide(self, rows: DataFrame, batch_id: int) -> None:
        """Write this batch's version of the state."""
        spark = rows.sparkSession
        at = F.lit(self.clock().astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")
        flushed = F.col("reason").isNotNull()
        before = self.state(spark, batch_id - 1).select(
            F.col("collection").alias("_collection"), F.when(flushed, 0).otherwise(F.col("waiting")).alias("_waiting"),
            F.when(~flushed, F.col("since")).alias("_since"), F.when(flushed, F.col("at")).otherwise(F.col("last_flush")).alias("_flush"),
            F.lit(True).alias("_known"))
        came = spark.read.schema(rows.schema).parquet(self._waiting(batch_id)).groupBy("collection").agg(F.count(F.lit(1)).alias("_came"))
        both = before.join(came, F.col("_collection").eqNullSafe(F.col("collection")), "full_outer")
        waiting = F.coalesce("_waiting", F.lit(0)) + F.coalesce("_came", F.lit(0))
        current = materialised(both.select(
            F.when(F.col("_known"), F.col("_collection")).otherwise(F.col("collection")).alias("collection"), waiting.alias("waiting"),
            F.coalesce("_since", F.when(F.col("_came") > 0, F.lit(batch_id))).cast("long").alias("since"),
            F.coalesce("_flush", at).alias("last_flush")))
        # rows bound items from above: only where enough rows wait are ids told apart
        full = current.filter(F.col("waiting") >= self.items)
        reached = self._rows_of(full, rows.schema, batch_id).select("collection", "id").distinct().groupBy("collection").agg(
            F.count(F.lit(1)).alias("_items")).filter(F.col("_items") >= self.items).select(F.col("collection").alias("_collection"), F.lit(True).alias("_full"))
        elapsed = at.cast("double") - F.col("last_flush").cast("double")
        marked = current.join(reached, F.col("collection").eqNullSafe(F.col("_collection")), "left")
        marked.select(
            "collection", "waiting", "since", "last_flush", _reason(F.col("_full"), (F.col("waiting") > 0) & (elapsed >= self.seconds)).alias("reason"),
            at.alias("at"),
        ).write.mode("overwrite").parquet(self._state(batch_id))

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Drop what batches before this one are done with; this one may be run again and keeps all that it read."""
        first = self.state(spark, batch_id).agg(F.min("since")).first()[0]
        needed = batch_id if first is None else min(first, batch_id)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/waiting")
        for entry in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) < needed:
                _delete(spark, entry.getPath().toString())
        _delete(spark, self._state(batch_id - 2))


def _reason(full: Column, late: Column) -> Column:
    return F.when(full, "items").when(late, "time")
