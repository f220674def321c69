"""Similarity join on word n-grams, as a blocked product of the document by n-gram incidence with its transpose.

1. Documents with equal n-gram sets are one row of the incidence: exact copies cost nothing further.
2. Columns are ordered by hash, n-grams that a sample finds frequent last. Two sets whose Jaccard similarity reaches
   the threshold share columns among the first few of both (the size-derived prefix), so only those columns are
   multiplied in full: every column lists its rows, pairs of rows add up their common columns, and pairs of unequal
   size or with too few common columns are discarded. Rows that begin with the same columns are one row here, a family
   with its least and largest size per column, so that near copies list few pairs.
3. Columns with more than `LIGHT` rows list no pairs. A family with fewer of them than the common columns that any
   link needs does without: its links share light columns, and as many common columns less are asked of its pairs.
   The other families of such columns list pairs where `LIGHT` of them are left at most; else they are chained to a
   leader by size, which keeps every pair that could be similar in one cluster.
4. Clusters are the components of what is left. Each is dealt into tiles of bounded size; every pair of tiles is one
   block, whose exact overlap counts come from a product of small matrices, column block by column block. Pairs
   below the size-derived bound are discarded inside the block. What leaves it is a spanning forest of the links and
   the number of links per row, never the pairs.
5. Components of the forests over all blocks are the classes.

No link is lost: the prefix holds for any order of columns, so the sample of frequent n-grams only affects speed, and
families and chains only make clusters larger. Texts are read three times and moved only where a cluster needs them.

Defined cases. Texts without words, and null texts, have an empty set and no link. Rows that share a doc_id are one
node, which has the links of all of them. A null doc_id gives a null component and no link. Ties go to the smaller
doc_id. An empty table gives an empty result. Only key and text are read, so names of extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoledger.llm.common import free_name, parted, width
from geoledger.llm.components import components
from geoledger.session import broadcast_if_small, materialised, swept

# One document in so many is looked at for frequent n-grams; seen in so many of those, an n-gram is frequent.
SAMPLE_ONE_IN = 8
SAMPLE_SEEN = 3
# Most frequent n-grams that are told to all tasks, 8 bytes each. Those beyond only keep their place by hash.
MOST_FREQUENT = 1 << 20
# Rows of a column up to which its pairs are listed.
LIGHT = 32
# First columns that the rows of a family share.
FAMILY = 3
# Cells of the incidence, and light columns, that a task handles at a time.
CELLS_AT_ONCE = 1 << 20
COLUMNS_AT_ONCE = 1 << 11
# Rows and n-grams of a tile, and cells of a matrix block.
TILE_ROWS = 256
TILE_GRAMS = 1 << 20
CELLS = 1 << 22


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; with fewer words, the whole sequence is one."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width_ = min(n, len(h))
    grams = np.full(len(h) - width_ + 1, width_, np.uint64)
    for k in range(width_):
        grams = (grams ^ h[k:len(h) - width_ + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    return np.unique(grams)


def needed(size: int, percent: int) -> int:
    """Least overlap of a set of this size with one that is similar enough."""
    return -(-percent * size // 100)


def slack(size):
    """Common columns that the prefix guarantees beyond the first; weeds out chance meetings. For a size or an array."""
    return size // 20


def _ordered(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The columns of a set in their order: frequent ones last."""
    if not (frequent.size and grams.size):
        return grams
    common = frequent[np.minimum(np.searchsorted(frequent, grams), frequent.size - 1)] == grams
    return np.concatenate([grams[~common], grams[common]])


def _family(ordered: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(ordered[:FAMILY].tobytes(), 2)


SIGNED = "doc_id long, n int, s1 long, s2 long, family long"


def _signed(n: int, frequent: np.ndarray):
    """Size and signature of every set, and its family."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = [], []
            for text in batch.column("text").to_pylist():
                grams = gram_set(text, n)
                data = grams.tobytes()
                marks.append((xxhash.xxh3_64_intdigest(data), xxhash.xxh3_64_intdigest(data, 1), _family(_ordered(grams, frequent))))
                sizes.append(len(grams))
            signs = np.array(marks, np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int32()), *(pa.array(signs[:, i]) for i in range(3))],
                names=["doc_id", "n", "s1", "s2", "family"])

    return kernel


def _whole(n: int):
    """Whole sets with their signatures."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(text, n) for text in batch.column("text").to_pylist()]
            marks = [(xxhash.xxh3_64_intdigest(s.tobytes()), xxhash.xxh3_64_intdigest(s.tobytes(), 1)) for s in sets]
            signs = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["s1", "s2", "grams"])

    return kernel


def _cells(n: int, percent: int, frequent: np.ndarray):
    """The prefix of every set, cell by cell: column, family and size of the set."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
            lengths = [len(p) for p, _, _ in found]
            family = np.repeat(np.array([f for _, f, _ in found], np.uint64), lengths).view(np.int64)
            sizes = np.repeat(np.array([s for _, _, s in found], np.int32), lengths)
            grams = np.concatenate([p for p, _, _ in found]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (grams, family, sizes)], names=["gram", "node", "n"])

        found, cells = [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                grams = gram_set(text, n)
                if not grams.size:
                    continue
                ordered = _ordered(grams, frequent)
                prefix = ordered[:len(grams) - needed(len(grams), percent) + 1 + slack(len(grams))]
                found.append((prefix, _family(ordered), len(grams)))
                cells += len(prefix)
                if cells >= CELLS_AT_ONCE:
                    yield batch_of(found)
                    found, cells = [], 0
        if found:
            yield batch_of(found)

    return kernel


def _frequent(rows: DataFrame, n: int, one_in: int = SAMPLE_ONE_IN, seen: int = SAMPLE_SEEN) -> np.ndarray:
    """Sorted hashes of n-grams that a sample of the documents finds in several different sets."""
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).mapInArrow(_whole(n), "s1 long, s2 long, grams array<long>")
    sets = sample.groupBy("s1", "s2").agg(F.first("grams").alias("grams"))
    counts = sets.select(F.explode("grams").alias("gram")).groupBy("gram").count().filter(F.col("count") >= seen)
    top = counts.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).select("gram").toArrow()
    return np.sort(top.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _columns(light: int):
    """Families per column with their sizes. Input is sorted by gram and node.

    A column of up to `light` families is one row; of a heavier one, each family is a row (and may be several).
    Families that meet no other are left out.
    """

    def batch_of(gram: np.ndarray, heavy: np.ndarray, lengths: np.ndarray, cells: list[np.ndarray]) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in cells]
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(heavy), *lists], names=["gram", "heavy", "node", "low", "high"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, node, low, high = (np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
        over = None  # the heavy column that ended the rows seen so far

        def finished(last: bool) -> pa.RecordBatch:
            """All columns that are known whole; keeps the rows of the last one unless it is heavy."""
            nonlocal gram, node, low, high, over
            at = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])]))
            gram, node, low, high = gram[at], node[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            bounds = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
            starts, lengths = bounds[:-1], np.diff(bounds)
            heavy = lengths > light
            heavy[0] |= over is not None and gram[0] == over
            over = gram[-1] if heavy[-1] else None
            end = len(gram) if last or heavy[-1] else starts[-1]
            listed = ~heavy & (lengths > 1) & (starts < end)
            cells = np.repeat(listed, lengths), np.repeat(heavy, lengths)
            found = batch_of(
                np.concatenate([gram[starts[listed]], gram[cells[1]]]),
                np.repeat([False, True], [listed.sum(), cells[1].sum()]),
                np.concatenate([lengths[listed], np.ones(cells[1].sum(), lengths.dtype)]),
                [np.concatenate([x[cells[0]], x[cells[1]]]) for x in (node, low, high)])
            gram, node, low, high = gram[end:], node[end:], low[end:], high[end:]
            return found

        for batch in batches:
            if not batch.num_rows:
                continue
            g, r, size = (batch.column(x).to_numpy() for x in ("gram", "node", "n"))
            gram, node, low, high = (np.concatenate(x) for x in ((gram, g), (node, r), (low, size), (high, size)))
            yield finished(False)
        if gram.size:
            yield finished(True)

    return kernel


def _listed(starts: np.ndarray, lengths: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> list[tuple]:
    """Pairs (a, b, c, k) of the rows of light columns; `k` is the number of common columns that a pair must reach."""
    found = []
    for length in np.unique(lengths[lengths > 1]):
        at = starts[lengths == length][:, None] + np.arange(length)
        x, y = np.triu_indices(length, 1)
        i, j = at[:, x].ravel(), at[:, y].ravel()
        # whether sets of these sizes can reach the threshold at all
        ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i]) & (node[i] != node[j])
        i, j = i[ok], j[ok]
        found.append((node[i], node[j], np.ones(len(i), np.int64), 1 + slack(np.minimum(low[i], low[j]))))
    return found


PAIRS = "a long, b long, c long, k long"


def _batch_of_pairs(found: list[tuple]) -> pa.RecordBatch:
    a, b, c, k = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), c, k)], names=["a", "b", "c", "k"])


def _column_pairs(percent: int):
    """Pairs of the rows of light columns, one common column each."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COLUMNS_AT_ONCE):
                batch = whole.slice(at, COLUMNS_AT_ONCE)
                lengths = batch.column("node").value_lengths().to_numpy()
                starts = np.cumsum(lengths) - lengths
                cells = (batch.column(x).flatten().to_numpy().astype(np.int64) for x in ("node", "low", "high"))
                if found := _listed(starts, lengths, *cells, percent):
                    yield _batch_of_pairs(found)

    return kernel


def _chain(node: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int, leader: int | None, before: int) -> tuple[np.ndarray, int]:
    """Leader of every row of a heavy column, sorted by least size, and the largest size so far.

    A gap too wide for any link starts a new leader. `before` is the largest size of the rows that came earlier.
    """
    largest = np.maximum.accumulate(np.concatenate([[before], high]))
    starts = 100 * largest[:-1] < percent * low
    if leader is None:
        starts[0] = True
    at = np.maximum.accumulate(np.where(starts, np.arange(len(node)), -1))
    return np.where(at >= 0, node[at], -1 if leader is None else leader), largest[-1]


def _heavy_pairs(percent: int, light: int):
    """Pairs of rows per column with their common columns so far. Input is sorted by gram and least size.

    Columns that are light by now list their pairs with one common column each; the others tie their rows to leaders,
    with more common columns than any pair needs.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        gram, node, low, high = empty, empty, empty, empty
        chain = None  # (gram, leader, largest size) of the heavy column that ended the rows seen so far

        def tie(a: int, b: int, found: list[tuple], goes_on: bool) -> tuple:
            leaders, largest = _chain(node[a:b], low[a:b], high[a:b], percent, chain[1] if goes_on else None, chain[2] if goes_on else 0)
            tied = leaders != node[a:b]
            ones = np.ones(tied.sum(), np.int64)
            found.append((leaders[tied], node[a:b][tied], ones << 20, ones))
            return gram[a], leaders[-1], largest

        def finished(last: bool) -> list[tuple]:
            """Pairs of all columns that are known whole; keeps the rows of the last one unless it is heavy."""
            nonlocal gram, node, low, high, chain
            found: list[tuple] = []
            if not gram.size:
                return found
            bounds = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
            starts, lengths = bounds[:-1], np.diff(bounds)
            heavy, end, following = lengths > light, len(gram), None
            goes_on = chain is not None and chain[0] == gram[0]
            heavy[0] |= goes_on
            for i in np.flatnonzero(heavy):
                following = tie(bounds[i], bounds[i + 1], found, goes_on and i == 0)
            if not heavy[-1] and not last:
                end = starts[-1]
            chain = following if heavy[-1] else None
            listed = ~heavy & (starts < end)
            found += _listed(starts[listed], lengths[listed], node, low, high, percent)
            gram, node, low, high = gram[end:], node[end:], low[end:], high[end:]
            return found

        for batch in batches:
            new = [batch.column(x).to_numpy().astype(np.int64) for x in ("gram", "node", "low", "high")]
            gram, node, low, high = (np.concatenate(x) for x in zip((gram, node, low, high), new, strict=True))
            if found := finished(False):
                yield _batch_of_pairs(found)
        if found := finished(True):
            yield _batch_of_pairs(found)

    return kernel


def _candidates(rows: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(a, b) of families that may hold similar sets, directly or by way of others."""
    spark = rows.sparkSession
    real = rows.filter(F.col("doc_id").isNotNull()).mapInArrow(_cells(n, percent, frequent), "gram long, node long, n int")
    columns = materialised(real.repartition(width(spark), "gram").sortWithinPartitions("gram", "node").mapInArrow(
        _columns(LIGHT), "gram long, heavy boolean, node array<long>, low array<int>, high array<int>"))
    swept(spark)
    heavy = columns.filter("heavy").select("gram", *[F.element_at(x, 1).alias(x) for x in ("node", "low", "high")])
    # what a link of the family's smallest set needs, less by what lies in heavy columns, is found in light ones
    least = F.floor((F.col("low") * percent + 99) / 100)
    scarce = materialised(heavy.groupBy("node").agg(F.count(F.lit(1)).alias("h"), F.min("low").alias("low")).select(
        "node", "h", (F.col("h") >= 1 + F.floor(least / 20)).alias("bound")))
    scarce = broadcast_if_small(scarce)
    bound = heavy.join(scarce.filter("bound").select("node"), "node", "left_semi").select("gram", "node", "low", "high")
    ties = bound.repartition(width(spark), "gram").sortWithinPartitions("gram", "low", "node").mapInArrow(_heavy_pairs(percent, LIGHT), PAIRS)
    pairs = columns.filter("NOT heavy").mapInArrow(_column_pairs(percent), PAIRS).unionByName(ties)
    met = materialised(pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("k").alias("k")))
    swept(spark)
    # in columns that a family did without, nothing was counted; where neither did, pairs are counted or tied
    spared = F.when(~F.col("bound"), F.col("h"))
    few = met.filter("c < k")
    for end in ("a", "b"):
        few = few.join(scarce.select(F.col("node").alias(end), spared.alias(f"spared_{end}")), end)
    few = few.filter(F.col("c") >= F.col("k") - F.least("spared_a", "spared_b"))
    return met.filter("c >= k").select("a", "b").unionByName(few.select("a", "b"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: the incidence matrix times its transpose, in blocks of columns."""
    rows = len(sets)
    counts = np.zeros((rows, rows), np.float32)
    grams = np.concatenate(sets)
    who = np.repeat(np.arange(rows), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, who = grams[order], who[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, bool)
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(grams) else first
    column, who = column[shared], who[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        step = max(1, CELLS // rows)
        cuts = np.searchsorted(column, np.arange(0, column[-1] + step + 1, step))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                part = column[lo:hi] - column[lo]
                incidence = np.zeros((rows, part[-1] + 1), np.float32)
                incidence[who[lo:hi], part] = 1
                counts += incidence @ incidence.T
    return counts


def _forest(rows: list[tuple], percent: int) -> Iterator[tuple[int, int, int]]:
    """(node, head, links) of a block; rows are (node, tile, copies, grams) of one tile or two."""
    tiles = np.array([r[1] for r in rows])
    sizes = np.array([len(r[3]) for r in rows])
    both = overlaps([r[3] for r in rows]).astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    if tiles.min() != tiles.max():
        linked &= tiles[:, None] != tiles[None, :]
    copies = np.array([r[2] for r in rows])
    degree = linked @ copies
    nodes = np.array([r[0] for r in rows])
    label = nodes.copy()
    while True:
        near = np.where(linked, label[None, :], label[:, None]).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            break
        label = new
    return zip(nodes.tolist(), label.tolist(), degree.tolist(), strict=True)


def _blocks(percent: int):
    """Blocks arrive whole and sorted: rows with equal (cluster, p, q) are one block of two tiles at most.

    Rows that share id and set follow one another and count once.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blocks: list[tuple[tuple, list[tuple]]]) -> pa.RecordBatch:
            # where one of two tiles is empty there is no pair; those within the other have a block of their own
            found = [x for (_, p, q), r in blocks if len(r) > 1 and len({row[1] for row in r}) == (1 if p == q else 2) for x in _forest(r, percent)]
            node, head, links = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, head, links)], names=["node", "head", "links"])

        key, rows, previous = None, [], None
        for batch in batches:
            ready = []
            grams = batch.column("grams")
            values, offsets = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
            columns = [batch.column(x).to_pylist() for x in ("cluster", "p", "q", "node", "tile", "copies", "s1")]
            for i, (cluster, p, q, node, tile, copies, s1) in enumerate(zip(*columns, strict=True)):
                if (cluster, p, q) != key:
                    if rows:
                        ready.append((key, rows))
                    key, rows, previous = (cluster, p, q), [], None
                if (node, s1) == previous:
                    continue
                previous = (node, s1)
                rows.append((node, tile, copies, values[offsets[i]:offsets[i + 1]].copy()))
            if ready:
                yield done(ready)
        if rows:
            yield done([(key, rows)])

    return kernel


def _sets(n: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(t, n) for t in batch.column("text").to_pylist()]
            same = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64) == batch.column("s1").to_numpy()
            keep = np.flatnonzero(same)
            sets = [sets[i].view(np.int64) for i in keep]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
            rest = [batch.column(x).take(pa.array(keep)) for x in ("node", "s1", "cluster", "tiles", "copies")]
            yield pa.RecordBatch.from_arrays([*rest, grams], names=["node", "s1", "cluster", "tiles", "copies", "grams"])

    return kernel


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets; a component is named by its
    smallest doc_id, and `n_links` counts the rows a document links with.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    frequent = _frequent(rows, n)
    swept(spark)
    signed = materialised(rows.mapInArrow(_signed(n, frequent), SIGNED))

    real = signed.filter("n > 0 AND doc_id IS NOT NULL")
    groups = materialised(real.groupBy("s1", "s2", "n").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("family").alias("family")))
    clusters = materialised(components(_candidates(rows, n, percent, frequent)))
    swept(spark)

    # a family is one cluster at least, linked to others or not
    members = groups.select("node", "s1", "n", "copies", "family").join(clusters.withColumnRenamed("node", "family"), "family", "left")
    members = materialised(members.select("node", "s1", "n", "copies", F.coalesce("component", "family").alias("cluster")))
    tiles = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.greatest(
        F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") / TILE_GRAMS)).cast("int").alias("tiles")).filter("sets > 1").drop("sets")
    wanted = materialised(members.join(tiles, "cluster").select("node", "s1", "cluster", "tiles", "copies"))
    # of the texts, only those that may be wanted are moved
    _, near = parted(rows, F.col("doc_id"), wanted.select("node"))
    sets = near.join(broadcast_if_small(wanted), F.col("doc_id") == F.col("node")).select("node", "s1", "cluster", "tiles", "copies", "text").mapInArrow(
        _sets(n), "node long, s1 long, cluster long, tiles int, copies long, grams array<long>")
    tile = F.pmod(F.xxhash64("node", "s1"), F.col("tiles")).cast("int")
    blocks = sets.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    blocks = blocks.select("cluster", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "node", "s1", "tile", "copies", "grams")
    forest = blocks.repartition(width(spark), "cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "node", "s1").mapInArrow(
        _blocks(percent), "node long, head long, links long")
    forest = materialised(forest)
    swept(spark)

    # rows that share an id but not their text tie their classes together
    several = real.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).filter("low <> high").select("doc_id")
    shared = real.select("doc_id", "s1", "s2", "n").join(several, "doc_id", "left_semi").join(groups.select("s1", "s2", "n", "node"), ["s1", "s2", "n"])
    ties = forest.select(F.col("node").alias("a"), F.col("head").alias("b")).union(shared.select("doc_id", "node"))
    found = components(ties)
    degree = forest.groupBy("node").agg(F.sum("links").alias("links"))
    named = groups.select("s1", "s2", "n", "node", "copies").join(found, "node", "left").join(degree, "node", "left").select(
        "s1", "s2", "n", F.coalesce("component", "node").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents with their own columns, of each component only that with the smallest id.

    Where several rows have that id, the one with the smallest text stays. Rows without an id stay.
    """
    named = classes(docs, key, text, **options).filter("doc_id IS NOT NULL")
    flags = named.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    flags = flags.select(F.col("doc_id").alias("_id"), (F.col("least") != F.col("doc_id")).alias("_go")).where("least <> doc_id OR rows > 1")
    flags = materialised(flags)
    swept(docs.sparkSession)
    key_ = docs[key].cast("long")
    # rows whose id surely has no flag stay where they are
    apart, near = parted(docs, key_, flags.select("_id"))
    alone = apart.unionByName(near.join(broadcast_if_small(flags.select("_id")), key_ == F.col("_id"), "left_anti"))
    repeated = broadcast_if_small(materialised(flags.filter(~F.col("_go")).select("_id")))
    number = free_name(docs.columns, "number")
    several = near.join(repeated, key_ == F.col("_id"), "left_semi")
    several = several.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(text))))
    return alone.unionByName(several.filter(F.col(number) == 1).drop(number))
