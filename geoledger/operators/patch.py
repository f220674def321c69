"""Patches joined to their items and applied to the raw documents, one Arrow batch at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.functions.patching import PatchError, as_change, changed, composed, json_patch
from geoledger.operators.writes import KEY
from geoledger.session import broadcast_if_small, materialised

# The times a dated store files its items by.
PRIMARY_TIMES = {True: ("datetime",), False: ("start_datetime", "end_datetime")}


_FAILED = (PatchError, KeyError, TypeError, ValueError, RecursionError)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of merge patches of an item as one change each; the rest as it is, with `seq` to keep the order.

    Rows come sorted by item and order. An item whose patches lie in several tasks has a run in each.
    """
    number, run = 0, None  # run: [collection, id, seq, change]
    columns = ("collection", "id", "seq", "kind", "patch", "error")

    def written(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(columns))

    def ended() -> list[tuple]:
        return [] if run is None else [(*run[:3], "change", json.dumps(run[3], separators=(",", ":")), None)]

    for batch in batches:
        rows: list[tuple] = []
        for part, collection, item, kind, text in zip(*[batch.column(c).to_pylist() for c in ("part", *KEY, "kind", "patch")], strict=True):
            number += 1
            seq = part << 40 | number
            if run is not None and (kind != "merge" or run[:2] != [collection, item]):
                rows += ended()
                run = None
            if kind != "merge":
                rows.append((collection, item, seq, kind, text, None))
                continue
            try:
                change = as_change(json.loads(text))
            except _FAILED as err:
                # it changes nothing, so the run goes on
                rows.append((collection, item, seq, kind, text, str(err)))
                continue
            if run is None:
                run = [collection, item, seq, change]
            else:
                run[3] = composed(run[3], change)
        if rows:
            yield written(rows)
    if run is not None:
        yield written(ended())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document after its patches, and a row for each patch that failed, or for a document that can't be patched.

    Rows come sorted by item and `seq`, the document first; one document is held at a time.
    """
    key, text, document, broken, first, failed, done = None, None, None, None, None, 0, 0
    names = (*KEY, "kind", "patch", "document", "error", "broken", "failed")
    types = (*[pa.string()] * 6, pa.bool_(), pa.int64())
    out: list[tuple] = []

    def finish() -> None:
        if key is not None:
            after = json.dumps(document, separators=(",", ":"), ensure_ascii=False) if done else text
            out.append((*key, None, None, after, first, broken is not None, failed))

    def written() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))

    for batch in batches:
        for collection, item, kind, patch, error in zip(*[batch.column(c).to_pylist() for c in (*KEY, "kind", "patch", "error")], strict=True):
            if kind is None:
                finish()
                key, text, document, broken, first, failed, done = (collection, item), patch, None, None, None, 0, 0
                try:
                    document = json.loads(patch)
                except _FAILED as err:
                    first = broken = f"the stored document is malformed: {err}"
                    out.append((collection, item, "document", None, None, broken, True, None))
                continue
            if key != (collection, item) or broken is not None:
                continue  # nothing to patch
            if error is None:
                try:
                    document = changed(document, json.loads(patch)) if kind == "change" else json_patch(document, json.loads(patch))
                    done += 1
                except _FAILED as err:
                    error = str(err)
            if error is not None:
                first, failed = first or error, failed + 1
                out.append((collection, item, kind, patch, None, error, False, None))
        if out:
            yield written()
            out = []
    finish()
    if out:
        yield written()


def _applied(items: DataFrame, patches: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The items that have patches, and (collection, id, kind, patch, document, error, broken, failed), both written.

    Of the latter, rows without a kind are items after their patches: their document, the first failure, whether the stored document
    is malformed, and the number of failures. Rows with a kind are patches that failed, with their reason.
    """
    place = [F.col(order).alias("place")] if order else []
    # ranges of (item, order) split an item with many patches; written first, because finding ranges reads it once more
    rows = materialised(patches.select(*KEY, *place, F.coalesce("kind", F.lit("json")).alias("kind"), "patch"))
    turn = [*KEY, *(["place"] if order else []), "kind", "patch"]
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *turn).sortWithinPartitions(*turn).select(F.spark_partition_id().cast("long").alias("part"), *KEY, "kind", "patch")
    folded = materialised(ranged.mapInArrow(_folded, "collection string, id string, seq long, kind string, patch string, error string"))
    wanted = broadcast_if_small(folded.select(*KEY).distinct())
    # written, so that the items are searched once
    mine = materialised(items.filter(F.col("document").isNotNull()).join(wanted, list(KEY), "left_semi").select(*[F.col(f"`{c}`") for c in items.columns]))
    documents = mine.select(
        *KEY, F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("kind"), F.col("document").alias("patch"), F.lit(None).cast("string").alias("error"))
    stream = documents.unionByName(folded).repartition(*KEY).sortWithinPartitions(*KEY, "seq")
    return mine, materialised(stream.mapInArrow(
        _streamed, "collection string, id string, kind string, patch string, document string, error string, broken boolean, failed long"))


def patch_failures(items: DataFrame, patches: DataFrame, order: str | None = None) -> DataFrame:
    """(collection, id, kind, patch, error) of every patch of a stored item that fails, and so changes nothing.

    A malformed document is one row of kind `document`, without a patch: none of its patches is tried.
    """
    return _applied(items, patches, order)[1].filter(F.col("kind").isNotNull()).select(*KEY, "kind", "patch", "error")


def patched_items(
    items: DataFrame, patches: DataFrame, collections: DataFrame | None = None, dated: bool | None = None, order: str | None = None,
) -> DataFrame:
    """The items that have patches, with these applied: their columns, `error`, `failed`, `_refused`, and their key before as `_was`.

    Only documents and patches reach Python. The result is written once, because the checks of moves read it too.
    """
    mine, applied = _applied(items, patches, order)
    after = applied.filter(F.col("kind").isNull()).select(
        *KEY, F.col("document").alias("after"), "error", "broken", "failed")
    done = mine.join(broadcast_if_small(after), list(KEY))
    done = materialised(done.select(
        F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("old"), "after", F.col("error").alias("_patch_error"), "failed",
        F.when(F.col("broken"), F.col("error")).alias("error"),
        *[F.coalesce(F.when(~F.col("broken"), F.get_json_object("after", f"$.{k}")), F.col(k)).alias(f"_{k}") for k in KEY]))
    error = F.col("error")
    if dated is not None:
        for name in PRIMARY_TIMES[dated]:
            path = f"$.properties.{name}"
            same = F.get_json_object("old.document", path).eqNullSafe(F.get_json_object("after", path))
            error = F.coalesce(error, F.when(~same, F.lit(
                f"properties.{name} decides where the item is stored and cannot be patched")))
    moves = F.lit(False)
    for k in KEY:
        moves = moves | (F.col(f"_{k}") != F.col(f"old.{k}"))
    if collections is not None:
        known = collections.select(F.col("id").alias("_target"), F.lit(True).alias("_known")).distinct()
        done = done.join(known, F.col("_collection") == F.col("_target"), "left")
        error = F.coalesce(error, F.when((F.col("_collection") != F.col("old.collection")) & F.col("_known").isNull(), F.concat(
            F.lit("collection "), F.col("_collection"), F.lit(" does not exist"))))
    # a move must not meet a stored item, nor another move
    targets = done.filter(moves).select(*[F.col(f"_{k}").alias(k) for k in KEY])
    stored = items.select(*KEY).join(broadcast_if_small(targets.distinct()), list(KEY), "left_semi").withColumn("_n", F.lit(2).cast("bigint"))
    met = targets.withColumn("_n", F.lit(1).cast("bigint")).unionByName(stored).groupBy(*KEY).agg(F.sum("_n").alias("_n")).filter("_n > 1")
    met = met.select(*[F.col(k).alias(f"_t_{k}") for k in KEY], F.lit(True).alias("_met"))
    done = done.join(met, moves & (F.col("_collection") == F.col("_t_collection")) & (F.col("_id") == F.col("_t_id")), "left")
    error = F.coalesce(error, F.when(F.col("_met"), F.concat(
        F.lit("Item '"), F.col("_id"), F.lit("' already exists in collection '"), F.col("_collection"), F.lit("'"))))

    done = done.withColumn("_failed", error)
    good = F.col("_failed").isNull()
    new = {"document": F.col("after"), **{k: F.col(f"_{k}") for k in KEY}}
    columns = [F.when(good, new[c]).otherwise(F.col(f"old.`{c}`")).alias(c) if c in new else F.col(f"old.`{c}`").alias(c) for c in items.columns]
    return done.select(
        *columns, F.coalesce("_failed", "_patch_error").alias("error"), "failed", F.col("_failed").isNotNull().alias("_refused"), F.struct(*[F.col(f"old.{k}").alias(k) for k in KEY]).alias("_was"))


def patch_items(
    items: DataFrame, patches: DataFrame, collections: DataFrame | None = None, dated: bool | None = None, order: str | None = None,
) -> DataFrame:
    """Items (collection, id, document) with their patches applied; adds `error` and `failed`.

    `patches` has (collection, id, kind, patch): kind `merge` with a partial document, or `json` with a list of
    operations. Several patches of an item are applied in turn, by the column `order` where it is given. Each stands
    for itself: one that fails changes nothing, the others hold. `failed` counts those that failed, `error` is the first
    reason, and `patch_failures` has them all. Patching `id` or `collection` moves the item: its key columns follow the
    document. A move onto the key of another item is refused, and with `collections` one to an unknown collection; with
    `dated`, so is a change of the primary time (True: datetime, False: start and end). A refused item stays as it was
    before all its patches, and so does one whose stored document is malformed.

    Runs of merge patches are folded into one change before they meet the document, in as many tasks as they take; JSON
    patches of an item run one after another past its document, of which a task holds one.
    """
    done = patched_items(items, patches, collections, dated, order).drop("_was", "_refused")
    keys = patches.select(*KEY).distinct().withColumn("_patched", F.lit(True))
    untouched = items.join(keys, list(KEY), "left").filter(F.col("_patched").isNull() | F.col("document").isNull())
    return untouched.withColumns({"error": F.lit(None).cast("string"), "failed": F.lit(0).cast("long")}).select(*done.columns).unionByName(done)


def unmatched_patches(items: DataFrame, patches: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Patches of items that are not stored."""
    wanted = broadcast_if_small(patches.select(*key).distinct())
    found = items.select(*key).join(wanted, list(key), "left_semi").distinct()
    return patches.join(broadcast_if_small(found), list(key), "left_anti")
