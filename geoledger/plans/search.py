"""Item and collection search: one request becomes one chain of filters, a top-k and a projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.functions.ids import in_parts
from geoledger.functions.times import to_utc, ts_lit
from geoledger.operators.cql2 import cql2, cql2_properties
from geoledger.operators.fields import Fields, negate
from geoledger.operators.filters import by_datetime, by_query, keep_listed, visible
from geoledger.operators.paging import (
    DEFAULT_COLLECTION_LIMIT, DEFAULT_ITEM_LIMIT, Page, SortKey, _scalar, decode_bar_token, decode_token,
    parse_sort, resolve_limit, sort_keys,
)
from geoledger.operators.projection import parse_fields, select_fields
from geoledger.operators.spatial import BOUNDS, bbox_2d, boxes_of, by_bbox, by_intersects
from geoledger.operators.text import COLLECTION_TEXT_FIELDS, ITEM_TEXT_FIELDS, by_free_text


@dataclass
class SearchRequest:
    """What a search asks for; everything given must hold."""

    ids: Sequence[str] = ()
    collections: Sequence[str] = ()
    datetime: str | None = None
    bbox: Sequence[float] = ()
    intersects: dict[str, Any] | None = None
    query: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    filter: dict[str, Any] | None = None
    q: str | Sequence[str] = ()
    sortby: Sequence[str | dict[str, str]] = ()
    fields: Sequence[str] = ()
    limit: int | None = None
    token: str | None = None


@dataclass
class SearchOptions:
    """Settings of a deployment rather than of one request."""

    use_datetime: bool = True
    nanos: bool = True
    hide_path: str | None = None
    text_fields: Sequence[str] = ITEM_TEXT_FIELDS
    fuzzy: bool = True
    max_limit: int | None = None
    aliases: Mapping[str, str] = field(default_factory=dict)
    queryables: Sequence[str] | None = None


class SearchPage(Page):
    """A page whose rows are cut to the requested fields."""

    fields: Sequence[str] = ()

    @property
    def items(self) -> DataFrame:
        include, exclude = parse_fields(self.fields)
        return select_fields(self.rows, include, exclude)


def check_fields(names: set[str], queryables: Sequence[str]) -> None:
    """Refuse names that are not queryable."""
    unknown = sorted(names - set(queryables))
    if unknown:
        raise ValueError(f"not queryable: {', '.join(unknown)}")


def filter_items(
    items: DataFrame, request: SearchRequest, options: SearchOptions | None = None, aggregating: bool = False
) -> DataFrame:
    """All conditions of a request, unsorted.

    A search without time bounds still asks for a time inside the clock's range; an aggregation does not, and
    it also counts hidden rows.
    """
    options = options or SearchOptions()
    fields = Fields.of(items, options.aliases)
    if options.queryables is not None:
        used = set(request.query) | (cql2_properties(request.filter) if request.filter else set())
        check_fields(used, options.queryables)

    df = items
    if request.ids:
        df = keep_listed(df, "id", request.ids)
    if request.collections:
        df = keep_listed(df.filter(in_parts(df.columns, request.collections)), "collection", request.collections)
    if request.datetime or not aggregating:
        df = df.filter(by_datetime(fields, request.datetime, options.use_datetime, options.nanos))
    if request.bbox:
        df = df.filter(by_bbox(fields, bbox_2d(list(request.bbox))))
    if request.intersects:
        df = df.filter(by_intersects(fields, request.intersects))
    if request.query:
        df = df.filter(by_query(fields, request.query))
    if request.filter:
        df = df.filter(cql2(fields, request.filter))
    if request.q:
        df = df.filter(by_free_text(fields, request.q, options.text_fields, options.fuzzy))
    if options.hide_path and not aggregating:
        df = df.filter(visible(fields, options.hide_path))
    return df


def search(items: DataFrame, request: SearchRequest, options: SearchOptions | None = None) -> SearchPage:
    """One page of items, newest first unless the request sorts."""
    options = options or SearchOptions()
    keys = sort_keys(Fields.of(items, options.aliases), request.sortby)
    page = SearchPage(
        filter_items(items, request, options),
        keys,
        resolve_limit(request.limit, DEFAULT_ITEM_LIMIT, options.max_limit),
        decode_token(request.token) if request.token else None,
    )
    page.fields = request.fields
    return page


def get_item(
    items: DataFrame, collection: str, item_id: str, hide_path: str | None = None
) -> DataFrame:
    """At most one row."""
    found = items.filter(in_parts(items.columns, [collection]) & (F.col("collection") == collection) & (F.col("id") == item_id))
    if hide_path:
        found = found.filter(visible(Fields.of(items), hide_path))
    return found.limit(1)


# ---------------------------------------------------------------- collections

COLLECTION_ALIASES = {"temporal": "extent.temporal.interval"}
_EARLIEST, _LATEST = "1800-01-01T00:00:00Z", "2999-12-31T23:59:59Z"


def collection_bbox(fields: Fields, bbox: str | Sequence[float] | None) -> Column:
    """The collection's box meets the given one. Text is cut at commas; anything but four numbers filters nothing."""
    if isinstance(bbox, str):
        try:
            bbox = [float(part) for part in bbox.split(",")]
        except ValueError:
            return F.lit(True)
    if not bbox or len(bbox) != 4:
        return F.lit(True)
    minx, miny, maxx, maxy = (fields.get(name).column for name in BOUNDS)

    def meets(x0: float, y0: float, x1: float, y1: float) -> Column:
        return (minx <= F.lit(x1)) & (maxx >= F.lit(x0)) & (miny <= F.lit(y1)) & (maxy >= F.lit(y0))

    return reduce(Column.__or__, [meets(*box) for box in boxes_of([float(v) for v in bbox])])


def collection_datetime(dates: Column, interval: str | None, open_end: bool = False) -> Column:
    """Some date is not after the end and some date is not before the start.

    `dates` is the array of all interval bounds. An open bound (null) is no date, so an open-ended collection
    misses later queries; `open_end` reads the interval pairs' nulls as unbounded instead.
    """
    if not interval:
        return F.lit(True)
    start, slash, end = interval.partition("/")
    end = end if slash else start
    a = ts_lit(to_utc(_EARLIEST if start in ("..", "") else start))
    b = ts_lit(to_utc(_LATEST if end in ("..", "") else end))
    early, late = F.exists(dates, lambda d: d <= b), F.exists(dates, lambda d: d >= a)
    if open_end:
        unbounded = F.exists(dates, lambda d: d.isNull())
        early, late = early | unbounded, late | unbounded
    return early & late


def interval_dates(fields: Fields) -> Column:
    """All dates of a collection's temporal extent in one array."""
    nested = fields.get("extent.temporal.interval")
    if nested is not None:
        return F.flatten(nested.column)
    return F.array(fields.get("t_min").column, fields.get("t_max").column)


def filter_collections(
    collections: DataFrame, request: SearchRequest, fuzzy: bool = True, open_end: bool = False
) -> DataFrame:
    """Collections that satisfy a request; catalogs are left out, rows without a type stay."""
    fields = Fields.of(collections, COLLECTION_ALIASES)
    df = collections
    if request.q:
        df = df.filter(by_free_text(fields, request.q, COLLECTION_TEXT_FIELDS, fuzzy))
    if request.filter:
        df = df.filter(cql2(fields, request.filter))
    if request.query:
        df = df.filter(by_query(fields, request.query, prefix=""))
    if request.bbox:
        df = df.filter(collection_bbox(fields, request.bbox))
    if request.datetime:
        df = df.filter(collection_datetime(interval_dates(fields), request.datetime, open_end))
    return df.filter(negate(F.col("type") == "Catalog"))


def collection_sort(fields: Fields, sortby: Sequence[str | dict[str, str]] | None) -> list[SortKey]:
    """User fields, then id ascending."""
    keys = []
    for item in sortby or ():
        spec = parse_sort([item])[0] if isinstance(item, str) else item
        found = fields.get(spec["field"])
        if found is None:
            raise ValueError(f"cannot sort by unknown field {spec['field']!r}")
        descending = spec.get("direction", "asc") == "desc"
        keys.append(SortKey(_scalar(found, descending), descending))
    if not any(key.field.path == "id" for key in keys):
        keys.append(SortKey(fields.get("id")))
    return keys


def search_collections(
    collections: DataFrame, request: SearchRequest, fuzzy: bool = True, open_end: bool = False
) -> SearchPage:
    """One page of collections, by id unless the request sorts. A full page always gives a token."""
    keys = collection_sort(Fields.of(collections, COLLECTION_ALIASES), request.sortby)
    page = SearchPage(
        filter_collections(collections, request, fuzzy, open_end),
        keys,
        resolve_limit(request.limit, DEFAULT_COLLECTION_LIMIT),
        decode_bar_token(request.token, len(keys)),
        bar_token=True,
    )
    page.fields = request.fields
    return page


def get_collection(collections: DataFrame, collection_id: str) -> DataFrame:
    """The collection, or an error when there is none."""
    found = collections.filter(F.col("id") == collection_id).limit(1)
    if found.isEmpty():
        raise LookupError(f"collection {collection_id} does not exist")
    return found
