"""Quality rules as a short-circuit cascade: measured on a sample, the rules that reject most per second come first.

Every rule is a condition on features of the text, built from SQL functions only. A nested CASE evaluates them in turn
and stops at the first that rejects, so the costly ones see only what the cheap ones left over. The order never
changes the verdict, only the time it takes; the sample is bounded by `SAMPLE_ROWS`.

Null and empty texts have no words and are rejected by `few_words`. Repeated rows get equal verdicts. Extra columns
of `keep_good` pass whatever their names, and `judged` reads key and text only. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import let, words

# Rows the estimate of costs and selectivities reads at most, and the longest text among them in bytes.
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 1 << 16

WINDOW = 5

Feature = Callable[[str], Column]


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(r"[^ \t-\r]"))


def _only(text: Column, others: str) -> Column:
    """Code points of the text that the pattern doesn't match."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), others, "")).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    Equal windows are found by their 64-bit hashes. Texts without an equal pair, most of them, end after one look at
    the distinct count. Otherwise the windows are sorted by hash, so equal ones are neighbours, and the words covered
    are added up from the gaps between the sorted positions.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def positions(s: Column) -> Column:
        def twin(e: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), covered))

    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))


# Name of a feature -> its column for a text and its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, w: F.size(w).cast("long"),
    "word_chars": lambda text, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda text, w: _only(text, "[^#*$%&|<>]+"),
    "n_upper": lambda text, w: _only(text, r"[^\p{Lu}]+"),
    "n_marks": lambda text, w: _only(text, "[^!?]+"),
    "n_lines": lambda text, w: F.size(_lines(text)).cast("long"),
    "n_dup_lines": lambda text, w: let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_repeat_words": lambda text, w: _repeat_words(w),
}


def features(text: Column, w: Column, done: set[str] | None = None) -> Feature:
    """Features by name, computed where they are used; those in `done` are columns already."""
    return lambda name: F.col(name) if done and name in done else FEATURES[name](text, w)


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Feature], Column]


FEW_WORDS = Rule("few_words", lambda f: f("n_words") < 10)
REPEATED = Rule("repeated", lambda f: 100 * f("n_repeat_words") > 20 * f("n_words"))
# In sums of integers, so that any engine decides alike at the limits.
RULES = [
    FEW_WORDS,
    REPEATED,
    Rule("symbols", lambda f: 100 * f("n_symbols") > 25 * f("n_words")),
    Rule("short_or_long_words", lambda f: (10 * f("word_chars") < 25 * f("n_words")) | (f("word_chars") > 12 * f("n_words"))),
    Rule("shouting", lambda f: 2 * f("n_upper") > f("word_chars")),
    Rule("marks", lambda f: 2 * f("n_marks") > f("n_words")),
    Rule("duplicate_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
]


class Estimate(NamedTuple):
    rule: Rule
    seconds: float
    share: float

    @property
    def worth(self) -> float:
        """Rejected share of the sample per second."""
        return self.share / max(self.seconds, 1e-4)


def estimates(docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of every rule, each evaluated alone over the same bounded sample."""
    spark = docs.sparkSession
    sample = docs.select(F.col(text).alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    # take reads as many partitions as it needs, not all
    sample = spark.createDataFrame(pa.table({"text": pa.array([r["text"] for r in sample.take(rows)], pa.string())}), "text string")

    def run(condition: Column) -> tuple[float, float]:
        start = time.perf_counter()
        rejected = sample.agg(F.avg(condition.cast("double")).alias("share")).first()["share"]
        return time.perf_counter() - start, rejected or 0.0

    def of(rule: Rule) -> Column:
        return let(words(F.col("text")), lambda w: rule.rejects(features(F.col("text"), w)))

    run(F.length("text") < 0)
    floor = min(run(F.length("text") < 0)[0] for _ in range(2))
    found = []
    for rule in rules:
        seconds, share = run(of(rule))
        found.append(Estimate(rule, seconds - floor, share))
    return found


def ordered(found: list[Estimate]) -> list[Rule]:
    """Rules by rejection per cost, the best first."""
    return [e.rule for e in sorted(found, key=lambda e: -e.worth)]


def first_failed(rules: list[Rule], feature: Feature) -> Column:
    """Name of the first rule that rejects, else null. Later rules aren't evaluated once one has rejected."""
    column = F.lit(None).cast("string")
    for rule in reversed(rules):
        column = F.when(rule.rejects(feature), F.lit(rule.name)).otherwise(column)
    return column


def verdict(rules: list[Rule], text: Column) -> Column:
    """Name of the first rule that rejects a text, else null. The text is cut into words once for all rules."""
    return let(words(text), lambda w: first_failed(rules, features(text, w)))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order = ordered(estimates(docs, rules or RULES, text))
    return docs.filter(verdict(order, F.col(text)).isNull())


def judged(docs: DataFrame, base: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base features, and the verdicts: `base_failed` of the given rules, `kept` of the cascade of the others."""
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = ordered(estimates(docs, [r for r in RULES if r not in base], text))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), words(F.col(text)).alias("w"))
    rows = rows.select("doc_id", "text", "w", *[FEATURES[name](F.col("text"), F.col("w")).alias(name) for name in shown])
    feature = features(F.col("text"), F.col("w"), set(shown))
    failed = F.lit(False)
    for rule in base:
        failed = failed | rule.rejects(feature)
    kept = F.when(failed, F.lit(False)).otherwise(first_failed(order, feature).isNull())
    return rows.select("doc_id", *shown, failed.alias("base_failed"), kept.alias("kept"))
