"""Near-duplicates by MinHash signatures: a multi-index Hamming join, then exact links on the full shingle sets.

1. Documents with equal sets of word shingles are one node. A node's signature has `4 * chunks` lanes of 16 bits, each
   the mixed minimum of one hash function over the set; two signatures are as far apart as they have unequal lanes.
2. The multi-index. A signature is split into chunks of four lanes. Two signatures at a distance of up to
   `2 * chunks - 1` differ in one lane at most of some chunk, so each chunk is entered under every choice of the lane
   that may be wrong, without that lane: four keys a chunk. All pairs under the distance meet under some key.
3. Rows that meet are compared by signature and by size, in blocks of bounded size. What leaves a block is a spanning
   forest of the close pairs, never the pairs. Its components are the clusters.
4. Within a cluster the full sets are compared, again in blocks that only emit a spanning forest of the links. The
   components of those are the classes.

Blocks (3 and 4). A group of up to `TILE` rows is one block. A larger one is dealt into tiles, each joined by a few
pivots of the whole group. Where this leaves a group in several components, the rows outside the largest component
are compared with one another and with all others, tile by tile; rows of one component need no comparison. So a family
of M copies costs M comparisons with pivots and tiles, and M more for each row that no pivot reaches.

Two sets with a similarity of exactly 0.85 are further apart than the distance of ten chunks, and so are lost, with a
probability of 2e-7; above that similarity it falls quickly. Nothing else is lost, and no false link remains.

Defined cases. Texts without words, and null texts, have an empty set and no link. Rows that share a doc_id are one
node of the classes, which has the links of all of them. A null doc_id gives a null component, no link, and is kept.
Ties go to the smaller doc_id. An empty table gives an empty result. Only key and text are read, so names of extra
columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import width
from geoledger.llm.components import components
from geoledger.llm.jaccard import gram_set, overlaps
from geoledger.session import broadcast_if_small, materialised

# Lanes of a chunk; a chunk is one 64-bit number.
LANES = 4
# Rows and n-grams of a tile, and rows of a larger group that join each of its tiles (on average).
TILE = 256
TILE_GRAMS = 1 << 20
PIVOTS = 32
# Shingles hashed at once, and lane comparisons of one step.
GRAMS = 1 << 14
COMPARED = 1 << 24


def _functions(lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Constants of the hash functions, the same in every run."""
    rng = np.random.default_rng(20_24)
    return rng.integers(0, 1 << 63, lanes, np.uint64), rng.integers(0, 1 << 63, lanes, np.uint64) | np.uint64(1)


def signature(grams: np.ndarray, chunks: int) -> np.ndarray:
    """The set's signature as `chunks` 64-bit numbers of four lanes."""
    flip, times = _functions(LANES * chunks)
    least = np.full(LANES * chunks, np.iinfo(np.uint64).max)
    for k in range(0, len(grams), GRAMS):
        h = (grams[k:k + GRAMS, None] ^ flip) * times
        least = np.minimum(least, (h ^ h >> np.uint64(31)).min(axis=0))
    mixed = least * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ mixed >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int64)


def _signed(n: int, chunks: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                grams = gram_set(text, n)
                data = grams.tobytes()
                marks.append((xxhash.xxh3_64_intdigest(data), xxhash.xxh3_64_intdigest(data, 1)))
                sizes.append(len(grams))
                signatures.append(signature(grams, chunks))
            signs = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
            flat = np.concatenate([*signatures, np.empty(0, np.int64)])
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * chunks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1]),
                 pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["doc_id", "mark", "n", "s1", "s2", "signature"])

    return kernel


def index_keys(chunks: int):
    """All keys of a signature: each chunk without each of its lanes."""
    masks = [~(0xFFFF << 16 * lane) & (1 << 64) - 1 for lane in range(LANES)]
    signed = [m if m < 1 << 63 else m - (1 << 64) for m in masks]
    return F.array(*[
        F.xxhash64(F.lit(c * LANES + lane), F.col("signature")[c].bitwiseAND(F.lit(m).cast("long")))
        for c in range(chunks) for lane, m in enumerate(signed)])


def _labels(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Smallest node that each row reaches; `linked` has a square per block, `nodes` a row per block."""
    label = nodes
    while True:
        near = np.where(linked, label[:, None, :], label[:, :, None]).min(axis=2)
        if (near == label).all():
            return label
        label = near


def _by_block(keys: list[str], forest: Callable[[list[tuple[int, int]], dict[str, np.ndarray | pa.Array]], list[tuple]]):
    """A kernel over rows sorted by block: `forest` gets the bounds of whole blocks and gives (nodes, labels) arrays."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def found(table: pa.Table, last: bool) -> tuple[pa.Table | None, pa.RecordBatch | None]:
            columns = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(table.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
            kept = None if last else table.slice(bounds[-2])
            ends = bounds if last else bounds[:-1]
            pairs = forest(ends, table.slice(0, ends[-1])) if len(ends) > 1 else []
            if not pairs:
                return kept, None
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            return kept, pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest, out = found(table if rest is None else pa.concat_tables([rest, table]), False) if batch.num_rows else (rest, None)
            if out is not None:
                yield out
        if rest is not None:
            _, out = found(rest, True)
            if out is not None:
                yield out

    return kernel


def _close(percent: int, chunks: int):
    """Forests of the pairs whose signatures are close and whose sizes could reach the similarity."""
    def forest(bounds: np.ndarray, table: pa.Table) -> list[tuple]:
        nodes, sizes = (table.column(c).to_numpy() for c in ("rep", "n"))
        flat = table.column("signature").combine_chunks()
        lanes = flat.flatten().to_numpy().view(np.uint16).reshape(-1, LANES * chunks)
        starts, lengths = bounds[:-1], np.diff(bounds)
        out = []
        for length in np.unique(lengths[lengths > 1]):
            blocks = starts[lengths == length]
            step = max(1, COMPARED // int(length * length * lanes.shape[1]))
            for k in range(0, len(blocks), step):
                at = blocks[k:k + step, None] + np.arange(length)
                mine = lanes[at]
                linked = (mine[:, :, None, :] != mine[:, None, :, :]).sum(axis=3, dtype=np.int16) < 2 * chunks
                size = sizes[at]
                linked &= 100 * np.minimum(size[:, :, None], size[:, None, :]) >= percent * np.maximum(size[:, :, None], size[:, None, :])
                out.append((nodes[at].ravel(), _labels(linked, nodes[at]).ravel()))
        return out

    return forest


def _similar(percent: int):
    """Forests of the pairs whose full sets are similar."""
    def forest(bounds: np.ndarray, table: pa.Table) -> list[tuple]:
        nodes = table.column("rep").to_numpy()
        grams = table.column("grams").combine_chunks()
        values, offsets = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            # rows equal in id and text come one after another
            rows = [i for i in range(a, b) if i == a or nodes[i] != nodes[i - 1]]
            if len(rows) > 1:
                sizes = offsets[np.array(rows) + 1] - offsets[rows]
                both = overlaps([values[offsets[i]:offsets[i + 1]] for i in rows]).astype(np.int64)
                linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
                out.append((nodes[rows], _labels(linked[None], nodes[rows][None])[0]))
        return out

    return forest


def _spanning(rows: DataFrame, payload: Callable[[DataFrame], DataFrame], forest) -> DataFrame:
    """Columns (node, component) by all pairs that meet in a group and pass the test of `forest`; only nodes with a pair.

    `rows` has (grp, rep, members, leader, tiles): a node, its group, the group's rows, its smallest node and the tiles
    it needs. `payload` adds what the test reads. The leader is a pivot of every tile, and a node is in the same tile of
    all its groups as far as they are equally large, so that the forests of groups that overlap share their edges.
    """
    n, keys = width(rows.sparkSession), ["grp", "kind", "p", "q"]
    test = _by_block(keys, forest)

    def compared(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(n, *keys).sortWithinPartitions(*keys, "rep").mapInArrow(test, "a long, b long")

    def block(kind: int, p, q):
        return F.struct(F.lit(kind).alias("kind"), p.cast("int").alias("p"), q.cast("int").alias("q"))

    def dealt(frame: DataFrame, blocks) -> DataFrame:
        return frame.withColumn("block", F.explode(blocks)).withColumns({k: F.col(f"block.{k}") for k in keys[1:]}).drop("block")

    def tile(tiles: str, seed: int):
        return F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(tiles)).cast("int")

    def up_to(tiles: str):
        return F.sequence(F.lit(0), F.col(tiles).cast("int") - 1)

    pivot = (F.col("tiles") > 1) & ((F.col("rep") == F.col("leader")) | (F.pmod(F.xxhash64("rep", F.lit(1)), F.col("members")) < PIVOTS))
    first = F.when(pivot, up_to("tiles")).otherwise(F.array(tile("tiles", 2)))
    label = components(compared(dealt(payload(rows), F.transform(first, lambda p: block(0, p, p)))))

    large = rows.filter("tiles > 1")
    if not large.limit(1).count():
        return label
    named = large.join(label, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialised(named.select("grp", "rep", "members", "tiles", "component"))
    parts = named.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("tiles") / F.col("members")).alias("share"))
    parts = parts.groupBy("grp").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.max("share").alias("share"))
    # tiles in proportion to those of the group, which also mind long texts
    tiles = parts.filter("parts > 1").select(
        "grp", F.col("main.component").alias("main"), F.ceil(F.col("main.size") * F.col("share")).alias("main_tiles"),
        F.ceil((F.col("all") - F.col("main.size")) * F.col("share")).alias("rest_tiles"))
    open_rows = materialised(named.join(tiles, "grp").select("grp", "rep", "main_tiles", "rest_tiles", (F.col("component") == F.col("main")).alias("in_main")))
    if not open_rows.limit(1).count():
        return label
    p = tile("rest_tiles", 3)
    rest = F.concat(
        F.transform(up_to("rest_tiles"), lambda x: block(1, F.least(p, x), F.greatest(p, x))), F.transform(up_to("main_tiles"), lambda x: block(2, p, x)))
    main = F.transform(up_to("rest_tiles"), lambda x: block(2, x, tile("main_tiles", 4)))
    more = materialised(compared(dealt(payload(open_rows), F.when(F.col("in_main"), main).otherwise(rest))))
    # the pairs that join two components; most only say what is known
    ends = [label.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
    joins = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joins = materialised(joins.filter("a <> b").distinct())
    if not joins.limit(1).count():
        return label
    above = components(joins).select(F.col("node").alias("component"), F.col("component").alias("top"))
    named = label.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = above.join(label.select(F.col("node").alias("component")), "component", "left_anti")
    return materialised(named.union(alone.select("component", "top")))


def _sets(n: int, passed: list[str]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(t, n).view(np.int64) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], grams], names=[*passed, "grams"])

    return kernel


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 85, chunks: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Two documents link when 100 * intersection >= percent * union of their sets of `n`-word shingles; a component is
    named by its smallest doc_id, which is the one that is kept.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = materialised(rows.mapInArrow(_signed(n, chunks), "doc_id long, mark long, n long, s1 long, s2 long, signature array<long>"))
    real = signed.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = real.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("signature").alias("signature"))
    nodes = materialised(nodes.select("s1", "s2", "n", "least.doc_id", "least.mark", "signature", F.monotonically_increasing_id().alias("rep")))

    cells = nodes.select("rep", F.explode(index_keys(chunks)).alias("grp"))
    counts = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("leader")).filter("members > 1")
    met = materialised(cells.join(counts, "grp").select("grp", "rep", "members", "leader", F.ceil(F.col("members") / TILE).alias("tiles")))
    signatures = nodes.select("rep", "n", "signature")
    close = _spanning(met, lambda r: r.join(signatures, "rep"), _close(percent, chunks))

    clusters = close.select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    wanted = materialised(nodes.select("rep", "n", "doc_id", "mark").join(clusters, "rep"))
    sizes = wanted.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("leader"), F.sum("n").alias("grams"))
    tiles = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("grams") / TILE_GRAMS))
    wanted = materialised(wanted.join(sizes, "grp").select("grp", "rep", "members", "leader", tiles.alias("tiles"), "doc_id", "mark"))
    places = wanted.select("rep", "doc_id", "mark")

    def with_sets(some: DataFrame) -> DataFrame:
        passed = [f for f in some.schema.fields if f.name not in ("doc_id", "mark")]
        some = some if "mark" in some.columns else some.join(places, "rep")
        texts = rows.join(broadcast_if_small(some), ["doc_id", "mark"]).select(*[f.name for f in passed], "text")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in passed)
        return texts.mapInArrow(_sets(n, [f.name for f in passed]), schema + ", grams array<long>")

    links = _spanning(wanted, with_sets, _similar(percent))

    # rows that share an id but not their set tie their classes together
    several = real.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).filter("low <> high").select("doc_id")
    shared = real.select("doc_id", "s1", "s2", "n").join(several, "doc_id", "left_semi").join(nodes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"])
    shared = materialised(shared.select("doc_id", "rep").distinct())
    heads = shared.groupBy("doc_id").agg(F.min("rep").alias("head"))
    found = links
    if shared.limit(1).count():
        found = components(links.select(F.col("node").alias("a"), F.col("component").alias("b")).union(shared.join(heads, "doc_id").select("rep", "head")))
    named = nodes.join(found, F.col("rep") == F.col("node")).select("s1", "s2", "n", "component", "doc_id")
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    single = nodes.select("s1", "s2", "n", F.col("rep").alias("component"), F.col("doc_id").alias("component_id")).join(
        found.select(F.col("node").alias("component")), "component", "left_anti")
    named = named.drop("doc_id").join(names, "component").unionByName(single)
    out = signed.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
