"""Field names of a request resolved against the schema of the frame they run on."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoledger.functions.times import ts_lit

_TIME_TYPES = (T.TimestampNTZType, T.TimestampType, T.DateType)


@dataclass(frozen=True)
class Field:
    """One resolved field: its column and Spark type."""

    column: Column
    dtype: T.DataType
    path: str

    @property
    def is_array(self) -> bool:
        return isinstance(self.dtype, T.ArrayType)

    @property
    def element_type(self) -> T.DataType:
        return self.dtype.elementType if self.is_array else self.dtype

    def any(self, test: Callable[[Column], Column]) -> Column:
        """`test` on the value, or on any element of an array. Null means: does not match."""
        return F.exists(self.column, test) if self.is_array else test(self.column)

    def literal(self, value: Any) -> Column:
        """A request value as a literal of this field's type, so that the column itself is never cast."""
        if isinstance(value, Mapping):
            value = value.get("timestamp", value.get("date", value))
        dtype = self.element_type
        try:
            if isinstance(dtype, _TIME_TYPES):
                if not isinstance(value, (str, datetime)):
                    raise ValueError("a time is text")
                lit = ts_lit(value)
                return lit if isinstance(dtype, T.TimestampNTZType) else lit.cast(dtype)
            if isinstance(dtype, T.StringType):
                return F.lit(str(value).lower() if isinstance(value, bool) else str(value))
            if isinstance(dtype, T.BooleanType):
                if str(value).lower() not in ("true", "false"):
                    raise ValueError("a boolean is true or false")
                return F.lit(str(value).lower() == "true")
            if isinstance(dtype, T.NumericType):
                if isinstance(value, bool):
                    raise ValueError("a boolean is no number")
                return F.lit(value if isinstance(value, (int, float)) else float(value))
        except (TypeError, ValueError) as err:
            raise ValueError(f"{value!r} does not fit field {self.path} ({dtype.simpleString()}): {err}") from None
        raise ValueError(f"field {self.path} ({dtype.simpleString()}) cannot be compared with a value")


class Fields:
    """Name lookup for one frame.

    A name is tried as given, under `properties.`, and with a leading `properties.` or `assets.` dropped.
    `aliases` maps further names to paths.
    """

    def __init__(self, schema: T.StructType, aliases: Mapping[str, str] | None = None):
        self.schema = schema
        self.aliases = dict(aliases or {})

    @classmethod
    def of(cls, df: DataFrame, aliases: Mapping[str, str] | None = None) -> Fields:
        return cls(df.schema, aliases)

    def get(self, name: str) -> Field | None:
        """The field, or None when the frame has no such column."""
        name = self.aliases.get(name, name)
        candidates = [name, f"properties.{name}"]
        for prefix in ("properties.", "assets."):
            if name.startswith(prefix):
                candidates.append(name.removeprefix(prefix))
        for path in candidates:
            found = self._walk(path)
            if found:
                return found
        return None

    def _walk(self, path: str) -> Field | None:
        def step(column: Column | None, dtype: T.DataType, rest: str) -> tuple[Column, T.DataType] | None:
            if isinstance(dtype, T.MapType):
                key, _, tail = rest.partition(".")
                inner = column.getItem(key)
                return step(inner, dtype.valueType, tail) if tail else (inner, dtype.valueType)
            in_array = isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType)
            struct = dtype.elementType if in_array else dtype
            if not isinstance(struct, T.StructType):
                return None
            # longest field name first: names may themselves contain dots
            parts = rest.split(".")
            for n in range(len(parts), 0, -1):
                head, tail = ".".join(parts[:n]), ".".join(parts[n:])
                if head not in struct.fieldNames():
                    continue
                inner = F.col(f"`{head}`") if column is None else column.getField(head)
                inner_type = T.ArrayType(struct[head].dataType) if in_array else struct[head].dataType
                return step(inner, inner_type, tail) if tail else (inner, inner_type)
            return None

        found = step(None, self.schema, path)
        return Field(found[0], found[1], path) if found else None

    def names(self) -> list[str]:
        """Every leaf path, un-prefixed, in schema order."""
        return [path.removeprefix("properties.").removeprefix("assets.") for path, _ in leaf_paths(self.schema)]


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of every non-struct field, depth first."""
    out: list[tuple[str, T.DataType]] = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += leaf_paths(field.dataType, path + ".")
        else:
            out.append((path, field.dataType))
    return out


def holds(condition: Column) -> Column:
    """Two-valued reading of a condition: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def negate(condition: Column) -> Column:
    """Set complement: rows where the condition is null are kept."""
    return ~holds(condition)
