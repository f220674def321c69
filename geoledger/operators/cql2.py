"""CQL2-JSON filters to Columns.

Negation is set complement: a row without the field satisfies `<>` and `not`. Conditions are left nullable
outside negations (null means no match), so plain comparisons are pushed to the Parquet scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoledger.functions.geometry import normalise_literal
from geoledger.functions.ids import like_regex
from geoledger.operators.fields import Field, Fields, holds, negate
from geoledger.operators.filters import compare
from geoledger.operators.spatial import spatial

# CQL2 operator names.
_COMPARISONS = {"=": "eq", "<>": "ne", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}
_SPATIAL = {
    "s_intersects": "intersects", "s_contains": "contains", "s_within": "within", "s_disjoint": "disjoint",
}


def cql2(fields: Fields, expr: dict[str, Any]) -> Column:
    """A filter expression `{"op": ..., "args": [...]}` as a condition."""
    op, args = str(expr["op"]).lower(), expr["args"]
    if op == "and":
        return reduce(lambda a, b: a & b, (cql2(fields, e) for e in args), F.lit(True))
    if op == "or":
        return reduce(lambda a, b: a | b, (cql2(fields, e) for e in args), F.lit(False))
    if op == "not":
        # several arguments: none of them holds
        return reduce(lambda a, b: a & b, (negate(cql2(fields, e)) for e in args), F.lit(True))
    if not args or not isinstance(args[0], dict) or "property" not in args[0]:
        raise ValueError(f"{op!r} needs a property as its first argument")

    name = args[0]["property"]
    field = fields.get(name)
    if op in _COMPARISONS:
        return compare(field, _COMPARISONS[op], _second(op, args))
    if op == "isnull":
        return is_missing(field)
    if op == "between":
        return _between(field, args)
    if op == "in":
        if not isinstance(_second(op, args), list):
            raise ValueError(f"'in' needs a list, got {args[1]!r}")
        return compare(field, "in", args[1])
    if op == "like":
        regex = like_regex(_second(op, args))
        return F.lit(False) if field is None else field.any(lambda c: c.cast("string").rlike(regex))
    if op in _SPATIAL:
        literal = normalise_literal(_second(op, args))
        return spatial(fields, _SPATIAL[op], literal, name=name)
    raise ValueError(f"unknown operator {expr['op']!r}")


def _second(op: str, args: list[Any]) -> Any:
    if len(args) < 2:
        raise ValueError(f"{op!r} needs two arguments")
    return args[1]


def _between(field: Field | None, args: list[Any]) -> Column:
    """Inclusive; bounds come as `[p, [low, high]]` or `[p, low, high]`."""
    if len(args) == 2 and isinstance(args[1], list):
        low, high = args[1]
    elif len(args) == 3:
        low, high = args[1:]
    else:
        raise ValueError("'between' needs a lower and an upper bound")
    if field is None:
        return F.lit(False)
    a, b = field.literal(low), field.literal(high)
    return field.any(lambda c: c.between(a, b))


def is_missing(field: Field | None) -> Column:
    """The field is null; an array is also missing when it holds no value."""
    if field is None:
        return F.lit(True)
    if field.is_array:
        return ~holds(F.exists(field.column, lambda c: c.isNotNull()))
    return field.column.isNull()


def cql2_properties(expr: dict[str, Any]) -> set[str]:
    """Property names a filter uses, without `properties.` or `assets.`."""
    names: set[str] = set()
    for arg in expr.get("args", []) if "op" in expr else []:
        if isinstance(arg, dict) and "op" in arg:
            names |= cql2_properties(arg)
        elif isinstance(arg, dict) and "property" in arg:
            names.add(arg["property"].removeprefix("properties.").removeprefix("assets."))
    return names
