"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoledger.session import materialised

# The characters that part words.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def free_name(columns: Iterable[str], base: str) -> str:
    """A column name like `base` that none of `columns` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Bits of a row of a bitmap, bits per id, and most bits in all: beyond, more rows are taken for near ones.
BITMAP_ROW = 1 << 15
BITS_PER_ID = 16
MOST_BITS = 1 << 29


def parted(df: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` whose key is surely not in the one column of `ids`, and all others; nothing of `df` is moved.

    The ids are brought together as a bitmap of their hashes, two bytes per id, which is broadcast. Up to a 16th of the
    rows without a match are among the others, so joins with `ids` still decide, but over few rows.
    """
    bits = min(MOST_BITS, 1 << max(BITMAP_ROW.bit_length() - 1, (BITS_PER_ID * ids.count()).bit_length()))
    bucket, bitmap, here, hit = (free_name(df.columns, x) for x in ("bucket", "bitmap", "here", "hit"))

    def place(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(bits))

    at = place(F.col(ids.columns[0]).cast("long"))
    maps = ids.groupBy(F.floor(at / BITMAP_ROW).alias(bucket)).agg(F.bitmap_construct_agg(at % BITMAP_ROW).alias(bitmap))
    marked = df.withColumn(here, place(key)).withColumn(bucket, F.floor(F.col(here) / BITMAP_ROW)).join(
        F.broadcast(materialised(maps)), bucket, "left")
    within = (F.col(here) % BITMAP_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn(hit, F.coalesce(F.getbit(byte, within % 8) == 1, F.lit(False)))
    return tuple(marked.filter(c).select(*df.columns) for c in (~F.col(hit), F.col(hit)))


def numbered(df: DataFrame, group: list[str], order: list[Column], place: str, total: str | None = None) -> DataFrame:
    """The rows with their place within the group, from 0, and the group's count as `total`.

    The rows are written to the shared folder on the way.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks; a place is the count of the
    group's rows in earlier ranges plus the place within the range. Only those counts, one row per range and group,
    meet in a task. Rows that tie in everything are told apart by where they were read.
    """
    taken = [*df.columns, place, total or place]
    tie, part, before = (free_name(taken, x) for x in ("tie", "part", "before"))
    ordered = [F.asc_nulls_first(g) for g in group] + order + [F.asc(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(width(df.sparkSession), *ordered)
    dealt = materialised(dealt.withColumn(part, F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(part, *group).agg(F.count(F.lit(1)).alias(before))
    whole = [F.sum(before).over(Window.partitionBy(*group)).alias(total)] if total else []
    starts = counts.select(part, *group, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before), *whole).alias("s")
    same = F.col(f"d.{part}") == F.col(f"s.{part}")
    for g in group:
        same &= F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}"))
    within = F.row_number().over(Window.partitionBy(part, *group).orderBy(*order, F.asc(tie))) - 1
    placed = dealt.withColumn(place, within.cast("long")).alias("d")
    return placed.join(starts, same).select(*[F.col(f"d.{c}") for c in df.columns], (F.col(f"d.{place}") + F.col(before)).alias(place), *([total] if total else []))
