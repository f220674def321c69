"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a proof for every row.

Digests are lower-case hex SHA-256, and nodes hash the concatenated text of their children's digests.

1. A row's digest covers its fields in a fixed order, each as `-` for null, else as its UTF-8 length, `:` and its value.
2. Rows get their place within their group by key, over ranges of keys, so a group of any size spreads over tasks.
3. `FANOUT ** DEPTH` consecutive nodes are an aligned block, whose level is one string of concatenated digests. Cutting
   that string at fixed widths gives the runs to hash into the parents' string, and so on up to the block's root.
   What flanks a node in its run's substring are its siblings, to its left and to its right.
4. The blocks' roots are the nodes of the next round, until every group is one block. Then the groups' roots are the
   nodes of one more tree, whose root is the table's.
5. On the way down every block hands its own path, a (left, right) segment per level, to its nodes.

No task holds more than a block of nodes with their ids; paths are as long as the tree is high.

Defined cases. Nodes of the last run may be fewer; a single node is hashed too, unless it is all that is left. A null
group is a group, the first one; null keys come first. Rows that share a key are ordered by their digest, so equal rows
may swap places without any effect. An empty table has no root and gives no rows. The columns named by `fields`, `group`
and `key` are read; names of extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoledger.llm.common import numbered
from geoledger.session import materialised

# Children of a node, levels of a block, and hex digits of a digest.
FANOUT = 8
DEPTH = 3
WIDTH = 64
BLOCK = FANOUT ** DEPTH

PATH = "array<struct<left:string,right:string>>"


def row_digest(columns: Sequence[Column]) -> Column:
    """Digest of the columns' values in turn."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def _parents(level: Column) -> Column:
    """The string of the next level: the digests of fixed-width substrings."""
    runs = F.ceil(F.length(level) / (FANOUT * WIDTH)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substr(level, i * (FANOUT * WIDTH) + 1, F.lit(FANOUT * WIDTH)), 256))
    return F.array_join(hashed, "")


def _siblings(level: Column, at: Column) -> Column:
    """What flanks the node `at` in its run."""
    in_run = F.pmod(at, F.lit(FANOUT))
    start = (at - in_run) * WIDTH
    return F.struct(
        F.substr(level, start + 1, in_run * WIDTH).alias("left"),
        F.substr(level, start + (in_run + 1) * WIDTH + 1, (FANOUT - 1 - in_run) * WIDTH).alias("right"))


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and its path lead to."""
    return F.aggregate(path, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of nodes (g, place, total, digest, own): (g, place, total, members, levels, steps, digest)."""
    members = F.sort_array(F.collect_list(F.struct("place", "digest", "own")))
    blocks = nodes.groupBy("g", F.expr(f"place div {BLOCK}").alias("block"), "total").agg(members.alias("members"))
    # a group that is one block ends where one node is left; blocks of a larger group are all as high
    count = F.size("members")
    steps = F.when(F.col("total") > BLOCK, F.lit(DEPTH))
    for k in range(DEPTH + 1):
        steps = steps.when(count <= FANOUT ** k, F.lit(k))
    blocks = blocks.withColumn("steps", steps).withColumn("l0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    for k in range(1, DEPTH + 1):
        below = F.col(f"l{k - 1}")
        blocks = blocks.withColumn(f"l{k}", F.when(F.col("steps") >= k, _parents(below)).otherwise(below))
    return blocks.select(
        "g", F.col("block").alias("place"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), "members", "steps",
        F.array(*[F.col(f"l{k}") for k in range(DEPTH)]).alias("levels"), F.col(f"l{DEPTH}").alias("digest"))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, blocks of these blocks, and so on until every group is one block."""
    rounds: list[DataFrame] = []
    while True:
        blocks = materialised(_blocks(nodes))
        rounds.append(blocks)
        if not blocks.filter("total > 1").limit(1).count():
            return rounds
        nodes = blocks.select("g", "place", "total", "digest", F.lit(None).cast("string").alias("own"))


def _descend(rounds: list[DataFrame], crown: DataFrame) -> DataFrame:
    """(g, digest, own, path, and the crown's other columns) of all nodes.

    `crown` has (g, up) per group; `up` is the path from the group's root on.
    """
    rest = [c for c in crown.columns if c not in ("g", "up")]
    above = crown.withColumn("place", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        b, a = blocks.alias("b"), above.alias("a")
        both = b.join(a, F.col("b.g").eqNullSafe(F.col("a.g")) & (F.col("b.place") == F.col("a.place")))
        each = both.select("b.g", "levels", "steps", "up", *rest, F.explode("members").alias("m"))
        in_block = F.expr(f"cast(m.place % {BLOCK} as int)")
        here = F.array(*[_siblings(F.col("levels")[k], F.floor(in_block / FANOUT ** k).cast("int")) for k in range(DEPTH)])
        path = F.concat(F.slice(here, F.lit(1), F.col("steps")), "up")
        if blocks is rounds[0]:
            return each.select("g", F.col("m.digest").alias("digest"), F.col("m.own").alias("own"), path.alias("path"), *rest)
        above = materialised(each.select("g", F.col("m.place").alias("place"), path.alias("up"), *rest))
    raise AssertionError("a tree has a block")


def manifest(rows: DataFrame, key: str, group: str, fields: Sequence[str], own: Column | None = None) -> DataFrame:
    """(g, id, leaf, subroot, root, path, own): each row's digest, its group's root, the table's root, and the proof.

    `path` has the siblings of every level from the row to the table's root, so `fold(leaf, path)` is `root`.
    `own` is a text over the row that comes along.
    """
    # written first: finding the ranges of keys would read and hash all rows once more
    leaves = materialised(rows.select(
        F.col(group).alias("g"), F.col(key).alias("id"), row_digest([F.col(f) for f in fields]).alias("digest"),
        (F.lit(None) if own is None else own).cast("string").alias("own")))
    placed = numbered(leaves, ["g"], [F.asc_nulls_first("id"), F.asc("digest")], "place", "total")
    below = _climb(placed.select("g", "place", "total", "digest", F.struct("id", "own").alias("own")))

    groups = numbered(below[-1].select("g", "digest"), [], [F.asc_nulls_first("g")], "place", "total")
    tops = _climb(groups.select(F.lit(0).alias("g"), "place", "total", "digest", F.struct("g").alias("own")))
    crown = tops[-1].select("g", F.array().cast(PATH).alias("up"), F.col("digest").alias("root"))
    crown = _descend(tops, crown).select(F.col("own.g").alias("g"), F.col("path").alias("up"), F.col("digest").alias("subroot"), "root")
    return _descend(below, materialised(crown)).select(
        "g", F.col("own.id").alias("id"), F.col("digest").alias("leaf"), "subroot", "root", "path", F.col("own.own").alias("own"))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
