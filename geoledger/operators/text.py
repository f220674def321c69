"""Free text: OR over query words, tolerant of typos, as a boolean condition.

Text fields are cut into lower-case words; keyword fields are compared whole with the whole query. The
allowed number of typos follows the length of the query word; swapping two neighbours is one typo.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoledger.operators.fields import Fields

ITEM_TEXT_FIELDS = ("id", "collection", "properties.title^3", "properties.description", "properties.keywords")
COLLECTION_TEXT_FIELDS = ("id", "title^3", "description", "keywords")
# Leaf names analysed as text; every other field is a keyword.
ANALYSED = ("title", "description")

# A word: letters, digits and underscores, with single inner apostrophes or points.
WORD = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def parse_terms(q: str | Sequence[str]) -> list[str]:
    """Query words: one string is cut at commas."""
    return [term.strip() for term in q.split(",")] if isinstance(q, str) else list(q)


def allowed_typos(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


def _swaps(word: str) -> set[str]:
    """The word with two neighbouring letters exchanged, every way."""
    return {word[:i] + word[i + 1] + word[i] + word[i + 2:] for i in range(len(word) - 1)} - {word}


def near(value: Column, word: str, typos: int) -> Column:
    """Edit distance, with neighbour swaps counted once, is at most `typos`.

    Spark's levenshtein knows no swaps, so they are made on the literal: one swap costs one typo of the
    budget, two swaps cost both.
    """
    if typos == 0:
        return value == F.lit(word)
    once = sorted(_swaps(word))
    plain = F.levenshtein(value, F.lit(word), typos) >= 0
    if typos == 1:
        return plain | value.isin(once) if once else plain
    tests = [plain] + [F.levenshtein(value, F.lit(s), 1) >= 0 for s in once]
    twice = sorted({t for s in once for t in _swaps(s)})
    if twice:
        tests.append(value.isin(twice))
    # no edit changes the length by more than one typo each: most words fail here without a distance
    close = F.length(value).between(len(word) - typos, len(word) + typos)
    return close & reduce(lambda a, b: a | b, tests)


def query_words_of(q: str | Sequence[str]) -> list[str]:
    """Words that analysed fields are searched for."""
    return _driver_words(" ".join(parse_terms(q)))


def near_any(token: Column, query_words: Sequence[str]) -> Column:
    """The word is some query word, up to the typos that one allows."""
    return reduce(lambda a, b: a | b, (near(token, w, allowed_typos(w)) for w in query_words))


def by_free_text(
    fields: Fields, q: str | Sequence[str], names: Sequence[str] = ITEM_TEXT_FIELDS, fuzzy: bool = True,
    known: Mapping[str, Sequence[str]] | None = None,
) -> Column:
    """Some field contains some query word. Boosts (`^n`) do not change which rows match and are dropped.

    `known` names, for some analysed fields, the words of the data that are near a query word; rows are then compared
    with these and no distance is computed.
    """
    query = " ".join(parse_terms(q))
    query_words = _driver_words(query)
    condition = F.lit(False)
    for name in names:
        path = name.split("^")[0]
        field = fields.get(path)
        if field is None:
            continue
        if path.rsplit(".", 1)[-1] in ANALYSED:
            listed = (known or {}).get(path) if fuzzy else query_words
            if not query_words or listed == []:
                continue
            if listed is None:
                condition = condition | field.any(lambda c: F.exists(words(c), lambda w: near_any(w, query_words)))
            else:
                condition = condition | field.any(lambda c, listed=listed: _has_word(c, listed))
        else:
            typos = allowed_typos(query) if fuzzy else 0
            condition = condition | field.any(lambda c: near(c.cast("string"), query, typos))
    return condition


def _has_word(text: Column, query_words: Sequence[str]) -> Column:
    """Some word of the text is a query word. A text without any of the letters in a row is not cut into words."""
    lower = F.lower(text)
    candidate = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in query_words))
    return candidate & F.arrays_overlap(words(text), F.array(*[F.lit(w) for w in query_words]))


def _driver_words(text: str) -> list[str]:
    # \w is what the classes of WORD are
    return list(dict.fromkeys(re.findall(r"\w+(?:['.]\w+)*", text.lower())))
