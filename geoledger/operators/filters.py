"""Item conditions: ids, collections, time, property queries, hidden rows. Null counts as no match."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.functions.ids import in_parts
from geoledger.functions.times import parse_interval, ts_lit
from geoledger.operators.fields import Field, Fields, negate

QUERY_OPS = ("eq", "ne", "neq", "lt", "lte", "gt", "gte", "in", "contains")


def by_ids(fields: Fields, ids: Sequence[str]) -> Column:
    return fields.get("id").column.isin(list(ids))


def by_collections(fields: Fields, ids: Sequence[str]) -> Column:
    """Repeated on the parts of a stored table, it reaches the scan as a partition filter."""
    field = fields.get("collection")
    stored = in_parts(fields.schema.fieldNames(), ids) if field.path == "collection" else F.lit(True)
    return stored & field.column.isin(list(ids))


def keep_listed(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is in the list, which reaches the scan as a filter."""
    return df.filter(F.col(column).isin(list(values)))


def by_datetime(fields: Fields, interval: str | None, use_datetime: bool = True, nanos: bool = True) -> Column:
    """Time condition of a search.

    With `use_datetime`, rows with a datetime need it inside the bounds, and rows without one need a start
    and end that overlap them. Otherwise only start and end count. On a dated table (columns `has_datetime`,
    `item_date`) the bounds are repeated on the partition columns, which the planner cannot derive itself.
    """
    start, end = parse_interval(interval, nanos)
    a, b = ts_lit(start), ts_lit(end)
    low, high = F.lit(start.date().isoformat()).cast("date"), F.lit(end.date().isoformat()).cast("date")
    dt, first, last = (fields.get(n).column for n in ("datetime", "start_datetime", "end_datetime"))
    overlap = (first <= b) & (last >= a)

    has, day = fields.get("has_datetime"), fields.get("item_date")
    dated = has is not None and day is not None
    if not use_datetime:
        # the store may have been written under either rule: rows with a datetime sit at that day instead
        return overlap & (has.column | (day.column <= high)) if dated else overlap
    inside = dt.isNotNull() & dt.between(a, b)
    ranged = dt.isNull() & overlap
    if dated:
        inside = has.column & day.column.between(low, high) & inside
        ranged = ~has.column & (day.column <= high) & ranged
    return inside | ranged


def compare(field: Field | None, op: str, value: Any) -> Column:
    """One comparison; `op` is eq, ne, lt, lte, gt, gte, in. A field the frame lacks matches nothing."""
    if op in ("ne", "neq"):
        if field is not None and not field.is_array:
            # the complement spelled out, which the scan understands
            return field.column.isNull() | (field.column != field.literal(value))
        return negate(compare(field, "eq", value))
    if field is None:
        return F.lit(False)
    if op == "in":
        values = value if isinstance(value, (list, tuple, set)) else [value]
        literals = [field.literal(v) for v in values]
        return field.any(lambda c: c.isin(*literals)) if literals else F.lit(False)
    lit = field.literal(value)
    tests = {
        "eq": lambda c: c == lit,
        "lt": lambda c: c < lit,
        "lte": lambda c: c <= lit,
        "gt": lambda c: c > lit,
        "gte": lambda c: c >= lit,
    }
    return field.any(tests[op])


def by_query(fields: Fields, query: Mapping[str, Mapping[str, Any]], prefix: str = "properties.") -> Column:
    """All of `{field: {op: value}}`. Item fields are looked up under `properties.`; collections pass no prefix."""
    condition = F.lit(True)
    for name, tests in query.items():
        field = fields.get(prefix + name)
        for op, value in tests.items():
            if op not in QUERY_OPS:
                raise ValueError(f"unknown query operator {op!r}")
            if op == "contains":
                part = (
                    F.array_contains(field.column, field.literal(value))
                    if field is not None and field.is_array
                    else compare(field, "eq", value)
                )
            else:
                part = compare(field, op, value)
            condition = condition & part
    return condition


def visible(fields: Fields, path: str = "hidden") -> Column:
    """Rows whose flag is false or missing."""
    flag = fields.get(path)
    return F.lit(True) if flag is None else flag.column.isNull() | (flag.column == F.lit(False))
