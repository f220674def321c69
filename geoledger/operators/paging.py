"""Sort rules and keyset pages. A page is a filter plus a top-k, never an offset."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.functions.times import ts_lit
from geoledger.operators.fields import Field, Fields
from geoledger.session import materialised

# Page sizes.
DEFAULT_ITEM_LIMIT = 10
DEFAULT_COLLECTION_LIMIT = 300
MAX_LIMIT = 10_000
# What a missing time sorts as, descending and ascending.
MISSING_DESC = "1970-01-01T00:00:00Z"
MISSING_ASC = "2100-01-01T00:00:00Z"
_TEMPORAL = ("datetime", "start_datetime", "end_datetime")


@dataclass(frozen=True)
class SortKey:
    """One sort column. `fill` replaces missing times; without it missing values come last."""

    field: Field
    descending: bool = False
    fill: str | None = None

    @property
    def value(self) -> Column:
        if self.fill is None:
            return self.field.column
        return F.coalesce(self.field.column, ts_lit(self.fill).cast(self.field.dtype))

    @property
    def order(self) -> Column:
        return self.value.desc_nulls_last() if self.descending else self.value.asc_nulls_last()

    def literal(self, value: Any) -> Column:
        return self.field.literal(value)


def parse_sort(items: Sequence[str]) -> list[dict[str, str]]:
    """`+f`, `-f`, `f` to field and direction."""
    return [
        {"field": s.lstrip("+-"), "direction": "desc" if s.startswith("-") else "asc"} for s in items
    ]


def default_sort(fields: Fields) -> list[SortKey]:
    """Newest first by datetime then start (missing is the epoch), then id and collection descending."""
    return [
        SortKey(fields.get(name), True, MISSING_DESC if name in _TEMPORAL else None)
        for name in ("datetime", "start_datetime", "id", "collection")
    ]


def sort_keys(fields: Fields, sortby: Sequence[str | dict[str, str]] | None) -> list[SortKey]:
    """User sort, then id ascending. Only the bare time names have a fill value."""
    if not sortby:
        return default_sort(fields)
    keys, used = [], set()
    for item in sortby:
        spec = parse_sort([item])[0] if isinstance(item, str) else item
        name, descending = spec["field"], spec.get("direction", "asc") == "desc"
        field = fields.get(name)
        if field is None:
            raise ValueError(f"cannot sort by unknown field {name!r}")
        fill = (MISSING_DESC if descending else MISSING_ASC) if name in _TEMPORAL else None
        keys.append(SortKey(_scalar(field, descending), descending, fill))
        used.add(field.path.removeprefix("properties."))
    if "id" not in used:
        keys.append(SortKey(fields.get("id")))
    return keys


def _scalar(field: Field, descending: bool) -> Field:
    """A multi-valued field sorts by its smallest (ascending) or largest (descending) value."""
    column, dtype = field.column, field.dtype
    while isinstance(dtype, T.ArrayType):
        nested = isinstance(dtype.elementType, T.ArrayType)
        column = F.flatten(column) if nested else F.array_max(column) if descending else F.array_min(column)
        dtype = dtype.elementType
    return Field(column, dtype, field.path)


def resolve_limit(limit: int | None, default: int = DEFAULT_ITEM_LIMIT, cap: int | None = None) -> int:
    """Request limit, else the default, under an optional global cap and always under the page maximum."""
    size = default if limit is None else int(limit)
    if cap:
        size = min(size, cap)
    return min(size, MAX_LIMIT)


def after(keys: Sequence[SortKey], values: Sequence[Any]) -> Column:
    """Rows that sort after the given key values, compared field by field."""
    if len(keys) != len(values):
        raise ValueError("the token does not fit the sort")
    beyond, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, values):
        nullable = key.fill is None and key.field.path not in ("id", "collection")
        if value is None:
            # nothing sorts after a missing value but the later keys decide
            later, equal = F.lit(False), key.value.isNull()
        else:
            lit = key.literal(value)
            later = key.value < lit if key.descending else key.value > lit
            later = later | key.value.isNull() if nullable else later
            equal = key.value == lit
        beyond = beyond | (same & later)
        same = same & equal
    first, value = keys[0], values[0]
    if value is not None:
        # implied by the comparison above, but simple enough to reach the scan's row-group statistics
        lit, raw = first.literal(value), first.field.column
        beyond = beyond & (raw.isNull() | (raw <= lit if first.descending else raw >= lit))
    return beyond


def encode_token(values: Sequence[Any]) -> str:
    text = [v.isoformat(timespec="microseconds") + "Z" if isinstance(v, datetime) else v for v in values]
    return base64.urlsafe_b64encode(json.dumps(text).encode()).decode()


def decode_token(token: str) -> list[Any]:
    return json.loads(base64.urlsafe_b64decode(token.encode()))


def encode_bar_token(values: Sequence[Any]) -> str:
    """Collection pages: values joined by bars."""
    return "|".join(
        v.isoformat(timespec="microseconds") + "Z" if isinstance(v, datetime) else str(v) for v in values
    )


def decode_bar_token(token: str | None, arity: int) -> list[str] | None:
    """None when absent or when the number of values does not fit."""
    parts = token.split("|") if token else []
    return parts if parts and len(parts) == arity else None


def top(df: DataFrame, keys: Sequence[SortKey], limit: int) -> DataFrame:
    """The first rows in the order of the keys: every task keeps its own first rows, one task merges them."""
    return df.orderBy(*[k.order for k in keys]).limit(limit)


@dataclass
class Page:
    """One page of a filtered, sorted frame. Nothing runs until rows are read."""

    filtered: DataFrame
    keys: list[SortKey]
    limit: int
    token_values: Sequence[Any] | None = None
    bar_token: bool = False

    @property
    def window(self) -> DataFrame:
        df = self.filtered
        return df.filter(after(self.keys, self.token_values)) if self.token_values is not None else df

    @cached_property
    def _found(self) -> DataFrame:
        """The rows of the page and one more, chosen once: the token and the rows both read them."""
        return materialised(top(self.window, self.keys, self.limit + 1))

    @property
    def rows(self) -> DataFrame:
        chosen = self._found if "_found" in self.__dict__ else self.window
        return top(chosen, self.keys, self.limit)

    def matched(self) -> int:
        """Rows on all pages."""
        return self.filtered.count()

    def next_token(self) -> str | None:
        """Token of the following page. The page is chosen here, and `rows` reads it afterwards without another scan."""
        if not self.bar_token and self.limit >= MAX_LIMIT:
            return None
        values = [k.value.alias(f"k{i}") for i, k in enumerate(self.keys)]
        order = [k.order for k in self.keys]
        last = self._found.orderBy(*order).select(*values).offset(self.limit - 1).limit(2).collect()
        if len(last) < (1 if self.bar_token else 2):
            return None
        return encode_bar_token(last[0]) if self.bar_token else encode_token(last[0])
