"""Line dedup over levelled sorted runs of line hashes.

The index is a table of runs. A run holds, sorted by hash, one row per line key of its batches: the number of
documents that hold the key and its owner, the largest doc_id among them. Batches come in descending order of
doc_id. A new batch is merge-anti-joined with the runs: keys that no run has are owned by this batch, the others only
raise a count. Then the batch adds its own run at level 0. When a level holds `fanout` runs, they are compacted into
one run of the next level. A line key is dropped everywhere but in its owner once its count reaches `min_docs`, which
is known when all batches are in; the documents then meet the compacted run in one merge join.

Defined cases. Null and empty texts are one empty line and stay so. A row is a document: repeated rows count
again, and all rows of the owner's doc_id keep their lines. A null doc_id counts below every other. An empty table
gives an empty result. Extra columns pass; helper columns take names that the table doesn't have.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.llm.common import SPACES, free_name, width
from geoledger.session import job_dir, materialised

# Batches a table is dealt into, and runs of a level that are merged into one of the next.
BATCHES = 4
FANOUT = 3


def _keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Position and 128-bit hash of every line whose key is long enough."""
    for i, line in enumerate((text or "").split("\n")):
        key = line.strip(SPACES)
        if len(key) >= min_chars:
            yield i, xxhash.xxh3_128_digest(key.encode().lower())


def _entries(min_chars: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = {h for _, h in _keys(text, min_chars)}
                ids.extend([i] * len(found))
                hashes.extend(found)
            pairs = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(np.array(ids, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("batch").take(rows), batch.column("doc_id").take(rows), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                names=["batch", "doc_id", "h1", "h2"])

    return kernel


class LineRuns:
    """Levels of sorted runs, each a table in the shared folder."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _written(rows: DataFrame) -> DataFrame:
        n = width(rows.sparkSession)
        return materialised(rows.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2"))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"), F.max("owned").alias("owned"))

    def add(self, entries: DataFrame) -> None:
        """Take in a batch of entries (h1, h2, doc_id), one per line key and document."""
        own = entries.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner"))
        if self.runs:
            own = materialised(own)
            known = self.runs[0].select("h1", "h2")
            for run in self.runs[1:]:
                known = known.union(run.select("h1", "h2"))
            new = own.join(known, ["h1", "h2"], "left_anti").withColumn("owned", F.lit(True))
            again = own.join(known, ["h1", "h2"], "left_semi").select(
                "h1", "h2", "n", F.lit(None).cast("long").alias("owner"), F.lit(False).alias("owned"))
            own = new.unionByName(again)
        else:
            own = own.withColumn("owned", F.lit(True))
        self._place(self._written(own), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._place(self._written(self._merged(full)), level + 1)

    def compacted(self) -> DataFrame:
        """One run of all: (h1, h2, n, owner)."""
        runs = self.runs
        return runs[0] if len(runs) == 1 and len(self.levels) == 1 else self._merged(runs)


def _rewrite(min_chars: int, text_name: str, gone_name: str):
    """Texts without the lines whose hashes are listed; the other columns pass, the list is replaced by two counts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            for text, gone in zip(batch.column(text_name).to_pylist(), batch.column(gone_name).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                totals.append(len(lines))
                out: set[int] = set()
                if gone:
                    gone = set(gone)
                    out = {i for i, h in _keys(text, min_chars) if h in gone}
                    text = "\n".join(line for i, line in enumerate(lines) if i not in out)
                texts.append(text)
                dropped.append(len(out))
            kept = {name: batch.column(name) for name in batch.schema.names if name != gone_name} | {text_name: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(
                [*kept.values(), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*kept, f"{gone_name}_lines", f"{gone_name}_dropped"])

    return kernel


def _frequent(rows: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """Entries of all documents, and the line keys in at least `min_docs` of them with their owners."""
    spark = rows.sparkSession
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = [i / batches for i in range(1, batches)]
    bounds = (rows.agg(F.percentile_approx("doc_id", cuts, 1000).alias("b")).first()["b"] or []) if cuts else []
    # 0 is the batch of the largest ids
    batch = sum(((order < F.lit(b)).cast("int") for b in bounds), F.lit(0))
    schema = "batch int, doc_id long, h1 long, h2 long"
    path = f"{job_dir(spark)}/line-entries-{uuid.uuid4().hex}"
    rows.select(batch.alias("batch"), order.alias("doc_id"), "text").mapInArrow(_entries(min_chars), schema).write.partitionBy("batch").parquet(path)
    entries = spark.read.schema(schema).parquet(path)
    index = LineRuns(fanout)
    for b in range(len(bounds) + 1):
        index.add(entries.filter(F.col("batch") == b).select("h1", "h2", "doc_id"))
    return entries, materialised(index.compacted().filter(F.col("n") >= min_docs).select("h1", "h2", "owner"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
                batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, str, str]:
    """The documents with their columns and the repeated lines taken out of the text, plus two counts.

    Returns the frame and the names of the counts, lines before and lines dropped, which no other column has. Columns
    that the caller derived from the text stay as they are. A null text without lines to drop stays null.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    entries, frequent = _frequent(rows, min_chars, min_docs, batches, fanout)
    hits = entries.join(frequent, ["h1", "h2"]).filter(F.col("doc_id") < F.col("owner"))
    digest = F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in ("h1", "h2")])
    gone_name = free_name(docs.columns, "gone")
    at_name = free_name([*docs.columns, gone_name], "at")
    # a document's own lines at most
    gone = hits.groupBy(F.col("doc_id").alias(at_name)).agg(F.collect_set(digest).alias(gone_name))
    joined = docs.join(gone, F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))) == gone[at_name], "left").drop(at_name)
    lines, dropped = f"{gone_name}_lines", f"{gone_name}_dropped"
    schema = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())])
    return joined.mapInArrow(_rewrite(min_chars, text, gone_name), schema), lines, dropped
