"""Pages over a dated store that end early: days are read in the order of the sort until the page is full."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.functions.ids import SLICE, parts_of
from geoledger.functions.times import parse_interval, to_utc
from geoledger.operators.fields import Fields
from geoledger.operators.paging import SortKey, decode_token, resolve_limit, sort_keys, top
from geoledger.plans.search import DEFAULT_ITEM_LIMIT, SearchOptions, SearchPage, SearchRequest, filter_items, search
from geoledger.session import materialised

# Days of the first read; each further one takes so many times more.
FIRST_DAYS = 2
MORE_DAYS = 4

_PARTITION = re.compile(rf"{SLICE}=(\d+)/has_datetime=(true|false)/item_date=([^/]*)/[^/]*$")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Day:
    """The partitions of one day, of all collections; `day` is null for rows without any time."""

    has_datetime: bool
    day: date | None


def stored_days(items: DataFrame, collections: Sequence[str] = ()) -> list[Day]:
    """Days of a dated store, from the names of its files alone; with `collections`, of the slices that hold them.

    The planner lists the files of any table it reads; no file is opened here.
    """
    wanted, found = parts_of(SLICE, collections), set()
    for name in items.inputFiles():
        match = _PARTITION.search(name)
        if match is None:
            raise ValueError("the items are not read from a dated store")
        if not collections or int(match[1]) in wanted:
            found.add(Day(match[2] == "true", None if match[3] == _NO_VALUE else date.fromisoformat(match[3])))
    return list(found)


def can_end_early(items: DataFrame, keys: Sequence[SortKey], use_datetime: bool = True) -> bool:
    """Whether days follow one another in this order: the first key is the datetime, by which the store is filed."""
    return use_datetime and {"has_datetime", "item_date"} <= set(items.columns) and keys[0].fill is not None and keys[0].field.path == "datetime"


def _rank(day: Day, keys: Sequence[SortKey], by_start: bool) -> tuple[date, date]:
    """Where a day stands: by datetime, then by start among the rows that lack a datetime, which all tie."""
    missing = to_utc(keys[0].fill).date()
    if day.has_datetime:
        return day.day, date.min
    if not by_start:
        return missing, date.min
    return missing, day.day or to_utc(keys[1].fill).date()


def in_order(days: Iterable[Day], keys: Sequence[SortKey]) -> list[tuple[tuple[date, date], list[Day]]]:
    """Steps of days, in the order of the keys; every row of a step comes before every row of the next."""
    days = list(days)
    missing = to_utc(keys[0].fill).date()
    # a real datetime on the day that stands for a missing one may tie with it, and starts need not follow days then
    by_start = (
        len(keys) > 1 and keys[1].field.path == "start_datetime" and keys[1].fill is not None and keys[1].descending == keys[0].descending
        and Day(True, missing) not in days)
    steps: dict[tuple[date, date], list[Day]] = {}
    for day in days:
        steps.setdefault(_rank(day, keys, by_start), []).append(day)
    return sorted(steps.items(), key=lambda s: s[0], reverse=keys[0].descending)


def _on(days: Sequence[Day]) -> Column:
    """Rows of neighbouring days, as bounds on the partition columns."""
    conditions = []
    for has in (True, False):
        some = [d.day for d in days if d.has_datetime == has]
        dated = [d for d in some if d is not None]
        of_kind = F.col("has_datetime") == F.lit(has)
        if dated:
            conditions.append(of_kind & F.col("item_date").between(F.lit(min(dated)), F.lit(max(dated))))
        if len(dated) < len(some):
            conditions.append(of_kind & F.col("item_date").isNull())
    return reduce(Column.__or__, conditions)


@dataclass
class EarlyPage(SearchPage):
    """A page that reads days of the store, the first ones of the order first, until it has its rows and one more.

    A step of days holds no row that sorts before a row of an earlier step, so what is left unread can't be on the page.
    Reads grow from one to the next, so a page that needs k days reads fewer than 5 k + 2, in about log4 k jobs. A page
    after a token starts at the token's day.
    """

    days: Sequence[Day] = ()

    @cached_property
    def _found(self) -> DataFrame:
        steps = in_order(self.days, self.keys)
        if self.token_values is not None:
            steps = [s for s in steps if not self._passed(s[0])]
        self.days_read: list[Day] = []
        found, lacking, count = None, self.limit + 1, FIRST_DAYS
        while steps and lacking > 0:
            now, steps = [d for _, days in steps[:count] for d in days], steps[count:]
            self.days_read += now
            rows = materialised(top(self.window.filter(_on(now)), self.keys, lacking))
            found = rows if found is None else found.unionByName(rows)
            lacking, count = lacking - rows.count(), count * MORE_DAYS
        return self.filtered.limit(0) if found is None else found

    def _passed(self, rank: tuple[date, date]) -> bool:
        """Whether all rows of a step sort before the token's row."""
        first = self.token_values[0]
        at = to_utc(self.keys[0].fill if first is None else first).date()
        mark = (at, rank[1])
        if rank[0] == at and rank[1] != date.min and self.token_values[1] is not None:
            mark = (at, to_utc(self.token_values[1]).date())
        return rank > mark if self.keys[0].descending else rank < mark

    @property
    def rows(self) -> DataFrame:
        return top(self._found, self.keys, self.limit)


def search_dated(items: DataFrame, request: SearchRequest, options: SearchOptions | None = None) -> SearchPage:
    """As `search`, over items read from a dated store; pages sorted by datetime first read only the days they need."""
    options = options or SearchOptions()
    keys = sort_keys(Fields.of(items, options.aliases), request.sortby)
    if not can_end_early(items, keys, options.use_datetime):
        return search(items, request, options)
    low, high = (t.date() for t in parse_interval(request.datetime, options.nanos))
    days = [
        d for d in stored_days(items, request.collections)
        if (low <= d.day <= high if d.has_datetime else d.day is not None and d.day <= high)]
    page = EarlyPage(
        filter_items(items, request, options), keys, resolve_limit(request.limit, DEFAULT_ITEM_LIMIT, options.max_limit),
        decode_token(request.token) if request.token else None, days=days)
    page.fields = request.fields
    return page
