"""Batch writes as set operations on (collection, id): dedupe, existence, conflicts, insert, upsert, delete.

Joins are by key and left to the adaptive planner, which measures both sides at run time; only where a store is
filtered by the keys of a batch are they measured and broadcast beforehand, so that the store is not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoledger.functions.ids import PARTS, SLICE, part_of
from geoledger.operators.projection import prepare_items
from geoledger.operators.validation import check_threshold, item_error
from geoledger.session import broadcast_if_small, materialised

KEY = ("collection", "id")


def dedupe_last(df: DataFrame, order: Sequence[Column], key: Sequence[str] = KEY) -> DataFrame:
    """The last row per key in `order`; rows whose last key column (the id) is null are dropped.

    The planner limits every task to one row per key before the shuffle, so a key that fills a third of the
    input does not meet in one task. The id leads the sort: fewer rows agree in it than in the collection.
    """
    latest = Window.partitionBy(*reversed(key)).orderBy(*[c.desc() for c in order])
    return (
        df.filter(F.col(key[-1]).isNotNull())
        .withColumn("_place", F.row_number().over(latest))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def latest_items(df: DataFrame, by: Sequence[str] = ("collection",)) -> DataFrame:
    """Id and time of the newest item per store."""
    return df.groupBy(*by).agg(
        F.max(F.struct("datetime", "id")).alias("_last")
    ).select(*by, F.col("_last.id").alias("id"), F.col("_last.datetime").alias("datetime"))


def split_known(items: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items of stored collections, items of unknown ones)."""
    known = broadcast_if_small(collections.select(F.col("id").alias("collection")).distinct())
    return items.join(known, "collection", "left_semi"), items.join(known, "collection", "left_anti")


def mark_conflicts(new: DataFrame, stored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The rows with a flag `conflict` where their key is taken.

    One join: a deduped batch is partitioned by its key already, so only the stored keys are moved, each once.
    """
    taken = stored.select(*reversed(key)).distinct().withColumn("conflict", F.lit(True))
    return new.join(taken, list(key), "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def split_conflicts(new: DataFrame, stored: DataFrame, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows whose key is taken)."""
    marked = mark_conflicts(new, stored, key)
    return marked.filter(~F.col("conflict")).drop("conflict"), marked.filter("conflict").drop("conflict")


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Stored rows with the new ones in place of equal keys; `new` has one row per key."""
    kept = stored.join(new.select(*key), list(reversed(key)), "left_anti").select(*stored.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def replace_existing(stored: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Like upsert, but an absent key is an error."""
    missing = mark_conflicts(new, stored, key).filter(~F.col("conflict")).select(*key).first()
    if missing:
        raise LookupError(f"not stored: {missing.asDict()}")
    return upsert(stored, new, key)


def create_strict(stored: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Stored rows and new ones; a taken key is an error."""
    taken = mark_conflicts(new, stored, key).filter("conflict").select(*key).first()
    if taken:
        raise ValueError(f"already stored: {taken.asDict()}")
    return stored.unionByName(new, allowMissingColumns=True)


def delete_keys(stored: DataFrame, keys: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Stored rows without the given keys."""
    return stored.join(keys.select(*key), list(key), "left_anti")


def rename_collection(items: DataFrame, old: str, new: str) -> DataFrame:
    """Items of one collection under a new id, the rest untouched."""
    moved = F.when(F.col("collection") == old, F.lit(new)).otherwise(F.col("collection"))
    return items.withColumns({"collection": moved, **{name: part_of(name, moved) for name in PARTS if name in items.columns}})


def drop_collection(collections: DataFrame, items: DataFrame, collection_id: str) -> tuple[DataFrame, DataFrame]:
    """Collections and items without one collection."""
    return collections.filter(F.col("id") != collection_id), items.filter(F.col("collection") != collection_id)


# ---------------------------------------------------------------- a whole batch


@dataclass
class IngestResult:
    """What became of a batch. All frames are lazy views of one marked frame.

    `marked` has one row per distinct key with `fate`: new, conflict, invalid or unknown_collection.
    """

    raw: DataFrame
    marked: DataFrame
    mode: str

    def _of(self, *fates: str) -> DataFrame:
        return self.marked.filter(F.col("fate").isin(*fates))

    @property
    def accepted(self) -> DataFrame:
        """Rows to write: in create mode those without conflict, in upsert mode every valid one."""
        fates = ("new",) if self.mode == "create" else ("new", "conflict")
        return self._of(*fates).drop("fate", "error")

    @property
    def conflicts(self) -> DataFrame:
        rows = self._of("conflict") if self.mode == "create" else self.marked.filter(F.lit(False))
        text = F.concat(F.lit("Item '"), F.col("id"), F.lit("' already exists in collection '"),
                        F.col("collection"), F.lit("'"))
        return rows.select("collection", "id", text.alias("message"))

    @property
    def invalid(self) -> DataFrame:
        return self._of("invalid").select("collection", "id", "error")

    @property
    def unknown(self) -> DataFrame:
        return self._of("unknown_collection").select("collection", "id")

    @property
    def summary(self) -> DataFrame:
        """Counts of the batch in one row."""
        create = F.lit(1 if self.mode == "create" else 0).cast("bigint")
        counted = self.marked.agg(
            F.count(F.lit(1)).alias("processed_count"),
            F.count_if(F.col("fate") == "invalid").alias("validation_error_count"),
            (F.count_if(F.col("fate") == "conflict") * create).alias("conflict_count"),
            F.count_if(F.col("fate") == "unknown_collection").alias("database_error_count"),
        )
        total = self.raw.agg(F.count(F.lit(1)).alias("input_count"))
        # two one-row frames side by side
        both = counted.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
        return both.select(
            "input_count", "processed_count",
            (F.col("processed_count") - F.col("validation_error_count") - F.col("database_error_count")).alias("valid_count"),
            (F.col("input_count") - F.col("processed_count") + F.col("validation_error_count")
             + F.col("conflict_count")).alias("skipped_total"),
            "validation_error_count", "conflict_count", "database_error_count",
        )

    @cached_property
    def error_count(self) -> int:
        return self._of("invalid").count()


def ingest(
    batch: DataFrame, stored: DataFrame, collections: DataFrame, order: Sequence[Column], now: str,
    mode: str = "create", error: Column | None = None, max_errors: int = 0, strict: bool = False,
) -> IngestResult:
    """Dedupe, check collections, stamp, validate and compare with the store. The store is not written here.

    `mode` is create (a taken key is a conflict) or upsert. `error` replaces the standard validation. The marked
    batch is written to the job's folder once, because the accepted rows, the conflicts, the errors and the summary
    all read it; the dedupe's partitioning by key serves the comparison with the store too.
    """
    if mode not in ("create", "upsert"):
        raise ValueError(f"unknown mode {mode!r}")
    unique = prepare_items(dedupe_last(batch, order), now)
    known = collections.select(F.col("id").alias("collection"), F.lit(True).alias("_known")).distinct()
    marked = (
        mark_conflicts(unique.withColumn("error", item_error(unique) if error is None else error), stored)
        .join(known, "collection", "left")
        .withColumn("fate", F.when(F.col("_known").isNull(), "unknown_collection")
                    .when(F.col("error").isNotNull(), "invalid")
                    .when(F.col("conflict"), "conflict").otherwise("new"))
        .drop("_known", "conflict")
    )
    marked = materialised(marked)
    result = IngestResult(batch, marked, mode)
    if max_errors or strict:
        check_threshold(result.error_count, max_errors, strict)
    return result


def split_primary_datetime(df: DataFrame, use_datetime: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows a dated store accepts, rows without their primary time)."""
    good = F.col("datetime").isNotNull() if use_datetime else (
        F.col("start_datetime").isNotNull() & F.col("end_datetime").isNotNull())
    return df.filter(good), df.filter(~good)


def with_partitions(df: DataFrame, use_datetime: bool = True) -> DataFrame:
    """Add the partition columns of a dated store, derived from the primary datetime.

    Under `use_datetime`, rows without a datetime are filed by their start. The days of all collections lie together, in
    a few slices, so that the number of partitions grows with the days alone.
    """
    has = F.col("datetime").isNotNull() if use_datetime else F.lit(False)
    primary = F.when(has, F.col("datetime")).otherwise(F.col("start_datetime"))
    return df.withColumns({SLICE: part_of(SLICE, F.col("collection")), "has_datetime": has, "item_date": primary.cast("date")})
