"""Document keys, parts of a table by collection, and LIKE patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a LIKE escape may name.
_LIKE_ESCAPES = {"\\\\": "\\", "\\%": "%", "\\_": "_"}
_LIKE_TOKENS = re.compile(r"\\.|\\$|.", re.DOTALL)
# Columns that part a stored table by a hash of the collection, and the number of parts. Stored tables depend on them.
PART, SLICE = "collection_part", "collection_slice"
PARTS = {PART: 64, SLICE: 4}


def part_of(name: str, collection: Column) -> Column:
    """The part that rows of a collection are stored in; those without a collection go with the empty one."""
    return (F.crc32(F.coalesce(collection, F.lit("")).cast("binary")) % PARTS[name]).cast("int")


def parts_of(name: str, collections: Sequence[str]) -> set[int]:
    """Parts that the collections are stored in."""
    return {crc32(c.encode()) % PARTS[name] for c in collections}


def in_parts(columns: Sequence[str], collections: Sequence[str]) -> Column:
    """Rows of the parts that the collections are stored in; the planner can't derive them. True where the table has no parts."""
    condition = F.lit(True)
    for name in PARTS:
        if name in columns:
            condition = condition & F.col(name).isin(sorted(parts_of(name, collections)))
    return condition


def doc_id(item_id: Column, collection: Column) -> Column:
    """`id|collection`."""
    return F.concat_ws("|", item_id, collection)


def split_doc_id(key: Column) -> Column:
    """Back to a struct(id, collection); the id ends at the first bar, collection is null without one."""
    parts = F.split(key, r"\|", 2)
    return F.struct(parts.getItem(0).alias("id"), F.get(parts, 1).alias("collection"))


def like_regex(pattern: str) -> str:
    """CQL2 LIKE pattern to an anchored, case-insensitive regular expression.

    `%` and `*` match any run, `_` and `?` any one character; `\\%`, `\\_` and `\\\\` are literal and any
    other escape is an error.
    """
    out = []
    for token in _LIKE_TOKENS.findall(pattern):
        if token in ("%", "*"):
            out.append(".*")
        elif token in ("_", "?"):
            out.append(".")
        elif token[0] == "\\":
            if token not in _LIKE_ESCAPES:
                raise ValueError(f"invalid escape {token!r} in LIKE pattern")
            out.append(re.escape(_LIKE_ESCAPES[token]))
        else:
            out.append(re.escape(token))
    return r"(?is)\A" + "".join(out) + r"\z"
