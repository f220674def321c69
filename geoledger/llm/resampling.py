"""Importance resampling towards a target corpus, on hashed runs of words.

1. A feature is a run of 1 to `longest` consecutive words, joined by one space; its bucket is the CRC-32 of its bytes
   modulo `buckets`. The checksums of all features of a block of texts come from a position table: a byte contributes
   a constant that depends on its value and its distance from the end of the feature only, so a feature's checksum is
   the XOR of its bytes' contributions (one `bitwise_xor.reduceat` over the spans) and of a constant of its length.
   Features longer than the table are cut into pieces of its length, and the pieces are folded one after another.
2. Every task adds up its buckets, Spark adds up the tasks, for the documents and for the target texts.
3. A bucket's gain is the logarithm of its share in the target over its share in the documents, add-one smoothed, in
   thousandths. A document's weight is the sum of its features' gains, and its score the weight plus Gumbel noise
   that depends on its id and the seed only: the highest scores are a draw without replacement.
4. Documents with enough words are ranked by score over ranges of scores; the first ones are drawn.

The model is one number per bucket, so what tasks are told is bounded by `buckets`.

Defined cases. Null and empty texts and texts without words have no features and weight 0. A null id takes the noise of
an empty one and comes last among ties. Rows that share an id are ranked one by one; ties go to the smaller id, then to
the smaller weight, then to any of the equal rows. Without documents the result is empty; without target texts every
gain follows from the smoothing alone. Texts of any length are read in blocks; the block of one word is that word.
Only key and text are read, so names of extra columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import numbered
from geoledger.session import materialised

# Bytes of a piece, and so distances in the position table.
PIECE = 32
# Bytes of texts that are cut into features at once.
BLOCK = 1 << 20


def _position_table() -> np.ndarray:
    """[distance from the end, byte] -> what the byte adds to the checksum."""
    table = np.zeros((PIECE, 256), np.uint32)
    for byte in range(256):
        value = byte
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table[0, byte] = value
    for d in range(1, PIECE):
        table[d] = table[d - 1] >> 8 ^ table[0, table[d - 1] & 255]
    return table


POSITIONS = _position_table()
# Checksums of so many zero bytes: what the length alone adds.
LENGTHS = np.array([zlib.crc32(bytes(k)) for k in range(PIECE + 1)], np.uint32)


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of `data`, which may overlap; no span is empty."""
    if not len(starts):
        return np.empty(0, np.uint32)
    pieces = -(-lengths // PIECE)
    first = np.cumsum(pieces) - pieces
    head = lengths - (pieces - 1) * PIECE
    if pieces.max() == 1:
        at, size = starts, lengths
    else:
        owner = np.repeat(np.arange(len(starts)), pieces)
        rank = np.arange(len(owner)) - first[owner]
        size = np.where(rank == 0, head[owner], PIECE)
        at = starts[owner] + np.where(rank == 0, 0, head[owner] + (rank - 1) * PIECE)
    begins = np.cumsum(size) - size
    within = np.arange(size.sum()) - np.repeat(begins, size)
    from_end = np.repeat(size - 1, size) - within
    raw = np.bitwise_xor.reduceat(POSITIONS[from_end, data[np.repeat(at, size) + within]], begins)
    out = raw[first] ^ LENGTHS[head]
    long = np.flatnonzero(pieces > 1)
    k = 1
    while len(long):
        state = out[long] ^ np.uint32(0xFFFFFFFF)
        for j in range(4):
            raw_of_state = POSITIONS[PIECE - 1 - j, state >> np.uint32(8 * j) & np.uint32(255)]
            carried = raw_of_state if j == 0 else carried ^ raw_of_state
        out[long] = carried ^ raw[first[long] + k] ^ np.uint32(0xFFFFFFFF)
        k += 1
        long = long[pieces[long] > k]
    return out


_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
_IN_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))


def _blocks(data: np.ndarray, offsets: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lower-cased bytes, word starts, word lengths, row of each word, whether it is new), block by block.

    Blocks end between words. One that ends inside a text hands its last `reach` words to the next, where they are old,
    so that every run of words is whole in the block that has its last word as a new one.
    """
    ends = offsets[1:]
    pos, done, stop = int(offsets[0]), int(offsets[0]), int(offsets[-1])
    while done < stop:
        size = BLOCK
        while True:
            end = min(done + size, stop)
            part = _LOWER[data[pos:end]]
            inside = _IN_WORD[part]
            gaps = np.flatnonzero(~inside[done - pos:])
            border = int(ends[np.searchsorted(ends, end, "right") - 1]) if ends[0] <= end else done
            cut = end if end == stop else max(border, done + int(gaps[-1]) + 1 if len(gaps) else done)
            if cut > done:
                break
            size *= 2
        part, inside = part[:cut - pos], inside[:cut - pos]
        opens = np.zeros(len(part) + 1, bool)
        opens[offsets[(offsets >= pos) & (offsets <= cut)] - pos] = True
        starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | opens[:-1]))
        stops = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | opens[1:])) + 1
        rows = np.searchsorted(ends, starts + pos, "right")
        yield part, starts, stops - starts, rows, stops + pos > done
        going_on = np.flatnonzero(rows == np.searchsorted(ends, cut, "right"))[-reach:] if reach else []
        pos, done = (pos + int(starts[going_on[0]]) if len(going_on) else cut), cut


def _features(column: pa.Array, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of the run, row, checksum) of all features of the texts of a batch, block by block."""
    column = column.cast(pa.large_string())
    if not len(column) or column.buffers()[2] is None:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    for part, starts, lengths, rows, new in _blocks(data, offsets, longest - 1):
        yield 1, rows[new], checksums(part, starts[new], lengths[new])
        if longest > 1 and len(rows):
            # the words alone, one space after each
            begins = np.cumsum(lengths + 1) - lengths - 1
            within = np.arange((lengths + 1).sum()) - np.repeat(begins, lengths + 1)
            spaced = np.concatenate([part, np.array([0x20], np.uint8)])
            joined = spaced[np.where(within < np.repeat(lengths, lengths + 1), np.repeat(starts, lengths + 1) + within, len(part))]
            for n in range(2, min(longest, len(rows)) + 1):
                run = np.flatnonzero((rows[:len(rows) - n + 1] == rows[n - 1:]) & new[n - 1:])
                yield n, rows[run], checksums(joined, begins[run], begins[run + n - 1] + lengths[run + n - 1] - begins[run])


def _counted(longest: int, buckets: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in _features(batch.column("text"), longest):
                total += np.bincount(found % np.uint32(buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["bucket", "count"])

    return kernel


def _weighed(longest: int, gains: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            words, features, weight = (np.zeros(size, np.int64) for _ in range(3))
            for n, rows, found in _features(batch.column("text"), longest):
                here = np.bincount(rows, minlength=size)
                words += here if n == 1 else 0
                features += here
                # whole numbers below 2 ** 53 are added exactly
                weight += np.bincount(rows, gains[found % np.uint32(len(gains))], size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return kernel


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, count) of the features of all texts, for buckets that have some."""
    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_counted(longest, buckets), "bucket long, count long")
    return found.groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Gain of every bucket, in thousandths, rounded down: log of its smoothed share in the target over that in the documents."""
    spark = docs.sparkSession
    both = bucket_counts(docs, text, longest, buckets).withColumnRenamed("count", "s").join(
        bucket_counts(target, text, longest, buckets).withColumnRenamed("count", "t"), "bucket", "full")
    seen = spark.range(buckets).withColumnRenamed("id", "bucket").join(both, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    seen = materialised(seen)
    all_s, all_t = seen.agg(F.sum("s"), F.sum("t")).first()
    share = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    rows = seen.select("bucket", F.floor(1000 * F.log(share)).alias("gain")).toArrow()
    gains = np.zeros(buckets, np.int64)
    gains[rows.column("bucket").to_numpy()] = rows.column("gain").to_numpy()
    return gains


def _noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from 32 bits of a digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    gains = bucket_gains(docs, target, text, longest, buckets)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    weighed = rows.mapInArrow(_weighed(longest, gains), "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 10, min_words: int = 20, **options: int) -> DataFrame:
    """The scores of every document with its rank in the draw, from 1; null if it is not drawn.

    Of the documents with at least `min_words` words, `percent` in a hundred are drawn, rounded down.
    """
    rows = materialised(scored(docs, target, key, text, **options))
    enough = F.col("n_words") >= min_words
    able = rows.filter(enough)
    drawn = able.count() * percent // 100
    placed = numbered(able, [], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight")], "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    return placed.withColumn("rank", rank).unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
