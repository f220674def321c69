"""Summaries of a store's partitions, kept beside it: what a reader would otherwise read all items for.

Of every collection in every partition: its number of rows, and of rows that are not hidden; the fields that have a value;
the values of listed fields, up to one beyond the limit; the words of listed texts. They merge over partitions: fields,
values and words by union, numbers by sums. A partition itself has a state, which says whether they hold.

A write first files the touched partitions as open, under a new version, and files their summaries under another one when
the rows are in place. The latest version of a partition holds. One that is still open, because a write is
under way or was cut off, is read itself. A write summarises the partitions that it replaces and no others. After
`MOST_VERSIONS` writes the versions are folded into one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.operators.discovery import ENUM_FIELDS, ENUM_LIMIT, searchable
from geoledger.operators.fields import Fields
from geoledger.operators.filters import visible
from geoledger.operators.text import words
from geoledger.session import materialised

# Readers of the table skip names that begin like this.
FOLDER = "_summaries"
STATE, COUNT, FIELD, VALUE, WORD = "state", "count", "field", "value", "word"
MOST_VERSIONS = 50


@dataclass(frozen=True)
class Summarised:
    """What is summarised: fields whose values are listed, up to a limit, texts whose words are, and the flag of hidden rows.

    Elements of lists count as values. Fields that the table lacks are left out.
    """

    values: tuple[str, ...] = ENUM_FIELDS
    words: tuple[str, ...] = ()
    limit: int = ENUM_LIMIT
    hide_path: str = "hidden"


def _file(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def remember(spark: SparkSession, path: str, what: Summarised) -> None:
    """Mark the table as summarised; done last, so a table that was cut off before has no summaries."""
    file, store = _file(spark, f"{path}/{FOLDER}/what.json")
    out = store.create(file, True)
    out.write(bytearray(json.dumps(asdict(what)).encode()))
    out.close()


def what_of(spark: SparkSession, path: str) -> Summarised | None:
    """What a table's summaries hold; None where it has none."""
    file, store = _file(spark, f"{path}/{FOLDER}/what.json")
    if not store.exists(file):
        return None
    stream = store.open(file)
    found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return Summarised(tuple(found["values"]), tuple(found["words"]), found["limit"], found["hide_path"])


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder, store = _file(spark, f"{path}/{FOLDER}/all")
    found = store.listStatus(folder) if store.exists(folder) else []
    names = [s.getPath().getName() for s in found]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def _next(spark: SparkSession, path: str) -> int:
    return max(_versions(spark, path), default=0) + 1


def _file_rows(df: DataFrame, path: str, version: int) -> None:
    df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "kind").parquet(f"{path}/{FOLDER}/all")


def _states(parts: DataFrame, rows: Column, shown: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return parts.withColumns({
        "collection": none, "kind": F.lit(STATE), "name": none, "value": none, "rows": rows.cast("bigint"), "shown": shown.cast("bigint")})


def open_partitions(spark: SparkSession, path: str, touched: DataFrame) -> None:
    """File the touched partitions as being written."""
    _file_rows(_states(touched, F.lit(None), F.lit(None)), path, _next(spark, path))


def close_partitions(spark: SparkSession, path: str, rows: DataFrame, touched: DataFrame, keys: Sequence[str], what: Summarised) -> None:
    """File the summaries of the touched partitions, of which `rows` are all rows.

    Their states come last and make the rest valid; a partition without rows gets a state alone.
    """
    version = _next(spark, path)
    state, details = summarised(rows, keys, what)
    _file_rows(details, path, version)
    same = [touched[k].eqNullSafe(state[k]) for k in keys]
    gone = touched.join(state, same, "left_anti")
    _file_rows(state.unionByName(_states(gone, F.lit(0), F.lit(0))), path, version)
    if len(_versions(spark, path)) > MOST_VERSIONS:
        _fold(spark, path, keys)


def _fold(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Put the valid rows of all versions into a new one and drop the others, the oldest first, so that none comes back."""
    old = _versions(spark, path)
    state, details = latest(spark, path, keys)
    left = state.filter(~F.col("rows").eqNullSafe(F.lit(0)))
    _file_rows(details, path, old[-1] + 1)
    _file_rows(left, path, old[-1] + 1)
    for version in old:
        folder, store = _file(spark, f"{path}/{FOLDER}/all/version={version}")
        store.delete(folder, True)


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The latest state of every partition, open where `rows` is null, and the rows of those that are not."""
    filed = spark.read.parquet(f"{path}/{FOLDER}/all")
    newest = F.max_by(F.struct("version", "rows", "shown"), "version").alias("s")
    state = materialised(filed.filter(F.col("kind") == STATE).groupBy(*keys).agg(newest).select(*keys, "s.*"))
    valid = state.filter("rows > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("version").alias("_version"))
    same = [filed["version"] == valid["_version"], *[filed[k].eqNullSafe(valid[f"_{k}"]) for k in keys]]
    details = filed.filter(F.col("kind") != STATE).join(valid, same, "left_semi")
    return _states(state, F.col("rows"), F.col("shown")).drop("version"), details.drop("version")


def summarised(rows: DataFrame, keys: Sequence[str], what: Summarised) -> tuple[DataFrame, DataFrame]:
    """(states, details) of the partitions of `rows`; details are by collection.

    Two scans of the columns concerned. Flags and numbers are partial counts of each task; values and words are made
    distinct in each task before they are shuffled.
    """
    fields = Fields.of(rows)
    paths = [p for p, _ in searchable(rows.schema)]
    units = ("collection", *keys)
    seen = [F.bool_or(fields.get(p).column.isNotNull()).alias(f"f{i}") for i, p in enumerate(paths)]
    flags = materialised(rows.groupBy(*units).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(visible(fields, what.hide_path)).alias("shown"), *seen))
    state = _states(flags.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("shown").alias("shown")), F.col("rows"), F.col("shown"))

    none = F.lit(None).cast("string")
    named = F.array(*[F.when(F.col(f"f{i}"), F.lit(p)) for i, p in enumerate(paths)])
    number = F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("bigint").alias("shown")
    parts = [
        flags.select(*units, F.lit(COUNT).alias("kind"), none.alias("name"), none.alias("value"), "rows", "shown"),
        flags.select(*units, F.lit(FIELD).alias("kind"), F.explode(F.array_compact(named)).alias("name"), none.alias("value"), *number)]
    entries = []
    for kind, names in ((VALUE, what.values), (WORD, what.words)):
        for name in names:
            field = fields.get(name)
            if field is not None:
                each = field.column if field.is_array else F.array(field.column)
                texts = F.transform(each, lambda v: v.cast("string"))
                found = texts if kind == VALUE else F.flatten(F.transform(F.array_compact(texts), words))
                entries.append(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), found.alias("values")))
    if entries:
        spelled = rows.select(*units, F.explode(F.array(*entries)).alias("e")).select(*units, "e.kind", "e.name", F.explode("e.values").alias("value"))
        spelled = materialised(spelled.filter(F.col("value").isNotNull()).distinct())
        place = F.expr(f"row_number() OVER (PARTITION BY {', '.join(units)}, name ORDER BY value)")
        some = spelled.filter(F.col("kind") == VALUE).withColumn("_place", place).filter(F.col("_place") <= what.limit + 1).drop("_place")
        parts += [found.select("*", *number) for found in (some, spelled.filter(F.col("kind") == WORD))]
    return state, reduce(DataFrame.unionByName, parts)
