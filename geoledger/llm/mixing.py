"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, the source's target over its size. The whole part
is taken by all; the fraction is rounded dependently: two documents with fractional probabilities trade words, one
wins what the other loses, until the probability of one of them is 0 or 1. What happens to which is drawn so that
expectations stay, and the expected words of the pair stay exactly. Groups of some dozens of documents are folded at
once, each leaves one fractional document at most, and the left-overs of all groups meet again in the next level: a
reduction tree of as many levels as the logarithm of the rows. The last document of a source is rounded to the nearer
side, so the words taken differ from the target by half of one document at most.

All of it is DataFrame and SQL functions. Draws come from hashes of the ids, so reruns agree.

Defined cases. Null and empty texts have size 0 and take nothing. Sources are ordered by code point, null last. Repeated
rows are separate documents with the same id; they are numbered, so their draws differ and no group of them is folded as
one. Only id, text and source are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoledger.llm.common import free_name, let, width, words
from geoledger.session import broadcast_if_small, materialised

# Documents folded at once.
GROUP = 64
WEIGHTS = (5, 2, 1)
# Fixed by the contract: a document is taken at most three times.
MOST_COPIES = 3


def ranked(sources: DataFrame) -> DataFrame:
    """Sources (source, size) with `rank` from 0, by code point and null last, without one task seeing all of them."""
    spark = sources.sparkSession
    parts = materialised(sources.repartitionByRange(width(spark), F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row for every shuffle partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return parts.withColumn("within", within).join(before, "part").select(
        "source", "size", (F.col("before") + F.col("within") - 1).alias("rank"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Sources (source, size, rank) with `target`: shares of the whole by weight, at most `most` times the size.

    What a full source can't take is shared among the others by weight, again until none is above its limit.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = materialised(sources.withColumn("weight", weight).withColumn("full", F.lit(False)))
    while True:
        left = rows.agg(
            F.sum("size").alias("total"),
            F.sum(F.when(F.col("full"), F.col("size") * float(most))).alias("used"),
            F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight"),
            F.sum(F.col("full").cast("int")).alias("n")).first()
        unit = ((left["total"] or 0) - (left["used"] or 0.0)) / left["weight"] if left["weight"] else 0.0
        share = F.lit(float(unit)) * F.col("weight")
        limit = F.col("size") * float(most)
        above = F.col("full") | (share > limit)
        if not rows.filter(~F.col("full") & (share > limit)).limit(1).count():
            return rows.select("source", "size", F.when(F.col("full"), limit).otherwise(share).alias("target"))
        rows = materialised(rows.withColumn("full", above))


def _draw(*keys: Column) -> Column:
    """A number in [0, 1) from the hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def _trade(seed: int):
    """Step of the fold: the open document of the state meets the next one, and one of them closes.

    A document is (id, k, a, m): `a` words, `m` of them expected, so its probability is m / a.
    """

    def document(x: Column, mass: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["k"].alias("k"), x["a"].alias("a"), mass.alias("m"))

    def closed(x: Column, taken: Column) -> Column:
        return F.array(F.struct(x["id"].alias("id"), x["k"].alias("k"), x["a"].alias("a"), taken.alias("up")))

    def step(state: Column, y: Column) -> Column:
        x = state["open"]
        # words that can go from the next to the open one, and back
        gain, loss = F.least(x["a"] - x["m"], y["m"]), F.least(x["m"], y["a"] - y["m"])
        rises = _draw(F.lit(seed), x["id"], x["k"], y["id"], y["k"]) * (gain + loss) < loss

        def move(delta: Column, x_closes: Column, x_up: bool) -> Column:
            # the one that reaches its bound closes at it; at a tie the open one does
            return F.when(x_closes, F.struct(
                document(y, y["m"] - delta).alias("open"), F.concat(state["done"], closed(x, F.lit(x_up))).alias("done"),
            )).otherwise(F.struct(
                document(x, x["m"] + delta).alias("open"), F.concat(state["done"], closed(y, F.lit(not x_up))).alias("done")))

        up = move(gain, x["a"] - x["m"] <= y["m"], True)
        down = move(-loss, x["m"] <= y["a"] - y["m"], False)
        return F.when(rises, up).otherwise(down)

    return step


DONE = "array<struct<id:bigint,k:bigint,a:bigint,up:boolean>>"


def round_dependently(items: DataFrame, seed: int = 1, group: int = GROUP) -> DataFrame:
    """Round probabilities to 0 or 1. `items` (source, id, k, a, m) with 0 < m < a; returns (source, id, k, a, up).

    `a` is the size of an item and `m` its expected part. Per source the sum of `a` over the rounded-up items differs
    from the sum of `m` by half of one item at most.
    """
    level, open_, done = 0, materialised(items), []
    while True:
        counts = materialised(open_.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / group).alias("groups")))
        most = counts.agg(F.max("groups").alias("g")).first()["g"]
        if most is None:
            break
        groups = broadcast_if_small(counts.select(F.col("source").alias("s"), "groups"))
        dealt = open_.join(groups, F.col("source").eqNullSafe(F.col("s"))).withColumn(
            "g", F.pmod(F.xxhash64(F.lit(seed + level), "id", "k", "a"), F.col("groups")))
        item = F.struct((-F.col("a")).alias("neg"), F.xxhash64("id", "k").alias("mix"), "id", "k", "a", "m")
        # a group holds `group` items on average, dealt by the hash of a unique key
        folded = dealt.groupBy("source", "g").agg(F.sort_array(F.collect_list(item)).alias("items"))

        step = _trade(seed + level)

        def fold(x: Column) -> Column:
            first = F.get(x, F.lit(0))
            start = F.struct(
                F.struct(first["id"].alias("id"), first["k"].alias("k"), first["a"].alias("a"), first["m"].alias("m")).alias("open"),
                F.array().cast(DONE).alias("done"))
            return F.aggregate(F.slice(x, F.lit(2), F.size(x)), start, step)  # noqa: B023

        folded = materialised(folded.select("source", let(F.col("items"), fold).alias("f")))
        done.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.k", "d.a", "d.up"))
        rest = folded.select("source", "f.open.id", "f.open.k", "f.open.a", "f.open.m")
        # what both ends of a trade reached at once is whole already
        whole = (F.col("m") <= 0) | (F.col("m") >= F.col("a")) | F.lit(most == 1)
        done.append(rest.filter(whole).select("source", "id", "k", "a", (2 * F.col("m") >= F.col("a")).alias("up")))
        if most == 1:
            break
        open_, level = materialised(rest.filter(~whole)), level + 1
    rows = items.filter("false").select("source", "id", "k", "a", F.lit(True).alias("up"))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, k, source_size, target, copies) for every row; `k` numbers rows alike in the first three."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"))
    rows = materialised(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = materialised(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")))
    plan = materialised(targets(ranked(sums), weights, most).select(
        F.col("source").alias("s"), F.col("size").alias("source_size"), "target"))
    plan = broadcast_if_small(plan)
    same_source = F.col("source").eqNullSafe(F.col("s"))
    rate = F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    priced = rows.filter("size > 0").join(plan, same_source).withColumn("m", (rate - F.floor(rate)) * F.col("size"))
    items = priced.filter("m > 0 AND m < size").select("source", F.col("doc_id").alias("id"), "k", F.col("size").alias("a"), "m")
    rounded = round_dependently(items, seed).select(
        F.col("id").alias("doc_id"), "source", F.col("a").alias("size"), "k", F.col("up").cast("long").alias("more"))
    fixed = priced.filter("NOT (m > 0 AND m < size)").select(
        "doc_id", "source", "size", "k", (F.col("m") >= F.col("size")).cast("long").alias("more"))
    taking = rounded.unionByName(fixed).join(plan, same_source).withColumn("copies", F.floor(rate) + F.col("more"))
    empty = rows.filter("size = 0").join(plan, same_source).withColumn("copies", F.lit(0).cast("long"))
    shown = ["doc_id", "source", "size", "k", "source_size", "target", "copies"]
    return taking.select(*shown).unionByName(empty.select(*shown))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", copies: str = "copies", **options) -> DataFrame:
    """The documents that the mix takes, with their own columns and the number of times each is taken."""
    taken = mix(docs, key, text, source, **options).filter("copies > 0").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("k").alias("_k"), F.col("copies").alias("_c"))
    taken = broadcast_if_small(materialised(taken))
    size, number = free_name(docs.columns, "size"), free_name(docs.columns, "number")
    alike = Window.partitionBy(key, source, size).orderBy(F.asc_nulls_first(text))
    rows = docs.withColumn(size, F.size(words(F.col(text))).cast("long")).withColumn(number, F.row_number().over(alike).cast("long"))
    same = rows[key].cast("long").eqNullSafe(taken["_d"]) & rows[source].eqNullSafe(taken["_s"]) & (rows[size] == taken["_z"]) & (rows[number] == taken["_k"])
    return rows.join(taken, same).select(*[rows[c] for c in docs.columns], taken["_c"].alias(free_name(docs.columns, copies)))
