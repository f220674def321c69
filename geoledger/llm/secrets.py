"""Secret scans: patterns, and Shannon entropy of sliding windows over candidate strings.

Base spans come from three patterns. Further candidates are runs of token characters; each belongs to a class by the
characters it is made of, with a threshold of its own. A window slides over the candidate: the counts of its
characters are kept, the one that enters and the one that leaves change the sum of c * log2(c) by their own terms only,
and so the entropy costs the same at every step however long the window is. A window within a piece between separators
needs the bits of the piece's class if these are fewer. A candidate with a window above the threshold gives a span from
the first such window to the last, unless a base span covers it. Windows that overlap an allowed string do not count;
of a placeholder's name, nor do those near it in the same piece.

All of it is SQL functions within the row; nothing is shuffled. Positions of matches come from the lengths of the
matches and of the pieces between them, in code points.

Defined cases. Null is as empty: no spans. Repeated rows get equal spans. Spans are ordered by start, then by kind in
the order of `KINDS`. Only the given columns are read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import let

# The patterns of the base spans and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"


class CharacterClass(NamedTuple):
    """Candidates that match `pattern` need `bits` of entropy in some window."""

    name: str
    pattern: str
    bits: float


PIECE = r"[A-Za-z0-9]+"

# Tried in turn. Candidates of one case without digits, and the like, belong to none: they are words. Words and numbers
# that separators join need more than a long piece does.
CLASSES = (
    CharacterClass("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    CharacterClass("one_case", r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z])([0-9A-Z]+|[0-9a-z]+)$", 3.4),
    CharacterClass("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*$", 3.7),
    CharacterClass("parted", r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z])([0-9A-Z+/_-]+|[0-9a-z+/_-]+)$", 3.7),
)
# Suppressed: names of placeholders, fillers, identifiers that are meant to be public, digests of nothing.
PLACEHOLDER = r"(?i)example|sample|placeholder"
ALLOWED = (
    PLACEHOLDER,
    r"(?i)x{6,}|0{8,}|1234567890|abcdefgh",
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])(?:da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e"
    r"|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)(?![0-9A-Za-z])",
)

NO_SPANS = "array<struct<start:bigint,rank:int,stop:bigint,text:string>>"


def _spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, rank, stop, text); `text` is the given group of the match."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    shown = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def walk(m: Column, between: Column, g: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(between, i))
            stop = start + F.length(F.get(m, i))
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"), F.get(g, i).alias("text"))
            return F.struct(stop.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(NO_SPANS).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step, lambda s: s["out"])

    nothing = F.array().cast(NO_SPANS)
    spans = let(found, lambda m: let(parts, lambda b: let(shown, lambda g: walk(m, b, g))))
    return F.when(text.rlike(pattern), spans).otherwise(nothing)


def _changed(counts: Column, i: Column, by: int) -> Column:
    """The counts with that of character number `i` changed."""
    return F.concat(F.slice(counts, F.lit(1), i), F.array(F.get(counts, i) + F.lit(by)), F.slice(counts, i + 2, F.lit(128)))


def high_windows(candidate: Column, bits: Column, pieces: Column, allowed: Column, window: int = WINDOW) -> Column:
    """(first, last): start of the first window with at least `bits` of entropy, end of the last; null without one.

    `pieces` (start, stop, bits) lower the bits of the windows they hold; windows that overlap one of `allowed` (start,
    stop) are passed over.
    """
    least = F.least(bits, F.array_min(F.transform(pieces, lambda x: x["bits"])))
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def scan(characters: Column) -> Column:
        def step(state: Column, p: Column) -> Column:
            entering, leaving = F.ascii(F.get(characters, p)), F.ascii(F.get(characters, p - window))

            def left(counts: Column) -> Column:
                n = F.get(counts, leaving)
                full = F.struct(_changed(counts, leaving, -1).alias("counts"), (state["sum"] - F.get(terms, n) + F.get(terms, n - 1)).alias("sum"))
                return F.when(p < window, F.struct(counts.alias("counts"), state["sum"].alias("sum"))).otherwise(full)

            def entered(s: Column) -> Column:
                n = F.get(s["counts"], entering)
                total = s["sum"] - F.get(terms, n) + F.get(terms, n + 1)

                def judged(t: Column) -> Column:
                    entropy = F.lit(math.log2(window)) - t / window + F.lit(1e-9)
                    within = F.exists(pieces, lambda x: (x["start"] <= p - (window - 1)) & (x["stop"] > p) & (x["bits"] <= entropy))
                    named = F.exists(allowed, lambda x: (x["start"] <= p) & (x["stop"] > p - (window - 1)))
                    high = (p >= window - 1) & (entropy >= least) & (F.coalesce(bits <= entropy, F.lit(False)) | within) & ~named
                    return F.struct(
                        _changed(s["counts"], entering, 1).alias("counts"), t.alias("sum"),
                        F.when(high, F.coalesce(state["first"], p - (window - 1))).otherwise(state["first"]).alias("first"),
                        F.when(high, p + 1).otherwise(state["last"]).alias("last"))

                return let(total, judged)

            return let(let(state["counts"], left), entered)

        none = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(characters) - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return let(F.split(candidate, ""), scan)


def _entropy_spans(text: Column, base: Column) -> Column:
    """Spans of candidates with a window above the threshold of their class."""
    def needed(candidate: Column) -> Column:
        column = F.lit(None).cast("double")
        for kind in reversed(CLASSES):
            column = F.when(candidate.rlike(kind.pattern), F.lit(kind.bits)).otherwise(column)
        return column

    def allowed(candidate: Column, pieces: Column) -> Column:
        def near(p: Column) -> Column:
            """What a placeholder's name in the piece speaks for."""
            return F.transform(_spans(p["text"], PLACEHOLDER, "entropy"), lambda w: F.struct(
                F.greatest(p["start"], p["start"] + w["start"] - WINDOW).alias("start"),
                F.least(p["stop"], p["start"] + w["stop"] + WINDOW).alias("stop")))

        names = F.flatten(F.transform(pieces, near))
        strings = [F.transform(_spans(candidate, a, "entropy"), lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop")))
                   for a in ALLOWED if a != PLACEHOLDER]
        nothing = F.array().cast("array<struct<start:bigint,stop:bigint>>")
        some = candidate.rlike(PLACEHOLDER)
        for a in ALLOWED[1:]:
            some = some | candidate.rlike(a)
        return F.when(some, F.concat(names, *strings)).otherwise(nothing)

    def judged(c: Column) -> Column:
        covered = F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["stop"] >= c["stop"]))

        def placed(w: Column) -> Column:
            return F.when(w["first"].isNotNull(), F.struct(
                (c["start"] + w["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"),
                (c["start"] + w["last"]).alias("stop"),
                F.substring(c["text"], w["first"] + 1, w["last"] - w["first"]).alias("text")))

        def scanned(pieces: Column) -> Column:
            inner = F.filter(pieces, lambda p: (F.length(p["text"]) >= WINDOW) & (F.length(p["text"]) < F.length(c["text"])))
            own = F.filter(F.transform(inner, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), needed(p["text"]).alias("bits"))),
                           lambda p: p["bits"].isNotNull())
            return let(needed(c["text"]), lambda n: let(own, lambda o: F.when(
                n.isNotNull() | (F.size(o) > 0),
                let(allowed(c["text"], pieces), lambda a: let(high_windows(c["text"], n, o, a), placed)))))

        # without a digit there is no class
        return F.when(~covered & c["text"].rlike("[0-9]"), let(_spans(c["text"], PIECE, "entropy"), scanned))

    found = F.filter(F.transform(_spans(text, CANDIDATE, "entropy"), judged), lambda s: s.isNotNull())
    # a window inside a base span adds nothing
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["stop"] >= s["stop"])))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, entropy): arrays of spans (start, rank, stop, text), ordered; `rank` is the kind's place in `KINDS`."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long_enough = F.filter(_spans(F.col("text"), ASSIGN, "assign", 2), lambda s: F.length(s["text"]) >= ASSIGN_CHARS)
    base = F.sort_array(F.concat(long_enough, _spans(F.col("text"), ACCESS, "access"), _spans(F.col("text"), HEX, "hex")))
    both = let(base, lambda b: F.struct(b.alias("base"), F.sort_array(_entropy_spans(F.col("text"), b)).alias("entropy")))
    return rows.select("doc_id", both.alias("found")).select("doc_id", "found.base", "found.entropy")


def written(spans: Column) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["stop"])), ",")
