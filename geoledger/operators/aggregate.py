"""Aggregations of a filtered item set, in one output shape.

Rows: (name, data_type, key, frequency, range_from, range_to, value, overflow). Every grouped aggregation is
reduced per task before its shuffle, so a key that holds a third of all rows costs one partial count per task. First
keys are chosen in the tasks; no count of groups is fixed, and a request of any number of steps or cells is answered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.functions import grids
from geoledger.functions.geometry import is_box
from geoledger.functions.predicates import eastward, shape_of, spans_between
from geoledger.functions.times import rfc3339, trunc_utc
from geoledger.operators.fields import Fields
from geoledger.operators.fine_grid import frequent_cells
from geoledger.session import materialised

OUTPUT = ("name", "data_type", "key", "frequency", "range_from", "range_to", "value", "overflow")

# What each aggregation reads.
TERMS = {
    "collection_frequency": ("collection", 100, None),
    "platform_frequency": ("platform", 100, None),
    "grid_code_frequency": ("grid:code", 10_000, "none"),
}
HISTOGRAMS = {
    "sun_elevation_frequency": ("view:sun_elevation", 5.0),
    "sun_azimuth_frequency": ("view:sun_azimuth", 5.0),
    "off_nadir_frequency": ("view:off_nadir", 5.0),
}
CLOUD_EDGES = (5.0, 15.0, 40.0)
INTERVALS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
GRIDS = {
    "centroid_geohash_grid_frequency": (1, 12),
    "centroid_geotile_grid_frequency": (0, 29),
    "geometry_geohash_grid_frequency": (1, 12),
    "geometry_geotile_grid_frequency": (0, 29),
}
GRID_BUCKETS = 10_000
# Precisions of geometry grids up to which every cell that a row touches is made: a million cells at most.
SPELLED = {"geohash": 4, "geotile": 9}
DEFAULT_AGGREGATIONS = {
    "total_count": "integer",
    "datetime_max": "datetime",
    "datetime_min": "datetime",
    "datetime_frequency": "frequency_distribution",
    "collection_frequency": "frequency_distribution",
    "geometry_geohash_grid_frequency": "frequency_distribution",
    "geometry_geotile_grid_frequency": "frequency_distribution",
}
METRICS = ("total_count", "datetime_min", "datetime_max")

@dataclass
class AggregationRequest:
    """Aggregations by name, with the parameters of the histograms and grids."""

    aggregations: Sequence[str]
    datetime_interval: str | None = None
    precision: dict[str, int] = field(default_factory=dict)

    def checked(self) -> AggregationRequest:
        """Defaults filled in; a value outside its range is an error."""
        if not self.aggregations:
            raise ValueError("no aggregations requested")
        if self.datetime_interval is not None and self.datetime_interval not in INTERVALS:
            raise ValueError(f"the interval must be one of {', '.join(INTERVALS)}")
        precision = {}
        for name, (low, high) in GRIDS.items():
            value = self.precision.get(name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"the precision of {name} must lie between {low} and {high}")
            precision[name] = low if value is None else value
        return AggregationRequest(self.aggregations, self.datetime_interval or "month", precision)


def _shape(df: DataFrame, name: str | Column, **columns: Column) -> DataFrame:
    """Fill the output shape; what is not given is null."""
    defaults: dict[str, Column] = {
        "data_type": F.lit("frequency_distribution"), "key": F.lit(None).cast("string"),
        "frequency": F.lit(None).cast("bigint"), "range_from": F.lit(None).cast("double"),
        "range_to": F.lit(None).cast("double"), "value": F.lit(None).cast("string"),
        "overflow": F.lit(0).cast("bigint"), "name": F.lit(name) if isinstance(name, str) else name,
    }
    defaults.update(columns)
    return df.select(*[defaults[c].alias(c) for c in OUTPUT])


# ---------------------------------------------------------------- single values


def metrics(df: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """total_count, datetime_min and datetime_max in one pass."""
    fields = Fields.of(df)
    dt = fields.get("datetime").column
    row = df.agg(F.count(fields.get("id").column).alias("n"), F.min(dt).alias("first"), F.max(dt).alias("last"))
    return _shown_metrics(row.withColumn("key", F.lit("")), names)


def _shown_metrics(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Single values from counts (key, n, first, last), where an empty key stands for rows with an id."""
    row = counts.agg(
        F.coalesce(F.sum(F.when(F.col("key") == "", F.col("n"))), F.lit(0)).cast("string").alias("total_count"),
        rfc3339(F.min("first")).alias("datetime_min"), rfc3339(F.max("last")).alias("datetime_max"))
    kinds = {"total_count": "integer", "datetime_min": "datetime", "datetime_max": "datetime"}
    rows = row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(kinds[n]).alias("data_type"), F.col(n).alias("value"))
        for n in METRICS if n in names
    ])).alias("m"))
    return _shape(
        rows, F.col("m.name"), data_type=F.col("m.data_type"), value=F.col("m.value"),
        overflow=F.lit(None).cast("bigint"),
    )


# ---------------------------------------------------------------- terms


def first_keys(counts: DataFrame, size: int, largest_key_first: bool = False) -> DataFrame:
    """The most frequent keys of (key, n): every task keeps its own first ones, so no task sorts all keys."""
    return counts.orderBy(F.col("n").desc(), F.col("key").desc() if largest_key_first else F.col("key").asc()).limit(size)


def top_terms(counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The most frequent keys per name, with the rest's total as `overflow`.

    `counts` has one row (name, key, n) per distinct key, and is a written table: it is read for the totals and for
    each name's first keys.
    """
    totals = counts.groupBy("name").agg(F.sum("n").alias("total"))
    chosen = [
        first_keys(counts.filter(F.col("name") == name).select("key", "n"), size).withColumn("name", F.lit(name))
        for name, size in sizes.items()
    ]
    shown = reduce(DataFrame.unionByName, chosen)
    rest = totals.join(shown.groupBy("name").agg(F.sum("n").alias("shown")), "name").select(
        "name", (F.col("total") - F.col("shown")).alias("overflow"))
    return shown.join(rest, "name").select("name", "key", "n", "overflow")


def _term(fields: Fields, name: str) -> Column:
    """The key that a row counts for."""
    source, _, missing = TERMS[name]
    found = fields.get(source)
    key = F.lit(None).cast("string") if found is None else found.column.cast("string")
    return F.coalesce(key, F.lit(missing)) if missing else key


def _shown_terms(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    top = top_terms(counts.select("name", "key", "n"), {name: TERMS[name][1] for name in names})
    return _shape(top, F.col("name"), key=F.col("key"), frequency=F.col("n"), overflow=F.col("overflow"))


def terms(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Term frequencies, all asked-for fields counted in one pass over the rows."""
    fields = Fields.of(df)
    return _shown_terms(materialised(count_keys(df, {name: _term(fields, name) for name in names})), names)


def count_keys(df: DataFrame, keys: dict[str, Column], *more: Column) -> DataFrame:
    """(name, key, n) of the non-null keys that every row gives under each name: one pass, one grouping."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), key.cast("string").alias("key")) for name, key in keys.items()])
    rows = df.select(F.explode(pairs).alias("t"), *more).select("t.name", "t.key", *[F.col("_time")] * len(more))
    extremes = [F.min("_time").alias("first"), F.max("_time").alias("last")] if more else []
    return rows.filter(F.col("key").isNotNull()).groupBy("name", "key").agg(F.count(F.lit(1)).alias("n"), *extremes)


# ---------------------------------------------------------------- ranges and histograms


def _range(column: Column, edges: Sequence[float] = CLOUD_EDGES) -> Column:
    """Number of the half-open range a value lies in; null for null."""
    passed = sum((F.when(column >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(column.isNotNull(), passed)


def _shown_ranges(spark: SparkSession, counts: DataFrame, name: str, edges: Sequence[float] = CLOUD_EDGES) -> DataFrame:
    """Counts (place, n) with the bounds of their ranges; empty ranges are shown."""
    bounds = [
        (i, f"{'*' if a is None else float(a)}-{'*' if b is None else float(b)}", a, b)
        for i, (a, b) in enumerate(zip([None, *edges], [*edges, None]))
    ]
    axis = spark.createDataFrame(bounds, "place int, key string, low double, high double")
    rows = axis.join(counts.select(F.col("place").alias("at"), "n"), F.col("place") == F.col("at"), "left")
    return _shape(rows, name, key=F.col("key"), frequency=F.coalesce("n", F.lit(0).cast("bigint")), range_from=F.col("low"),
                  range_to=F.col("high"))


def ranges(df: DataFrame, column: Column, name: str, edges: Sequence[float] = CLOUD_EDGES) -> DataFrame:
    """Counts of half-open ranges; empty ones are shown."""
    counts = df.select(_range(column, edges).alias("place")).filter(F.col("place").isNotNull()).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    return _shown_ranges(df.sparkSession, counts, name, edges)


def _step(column: Column, interval: float) -> Column:
    return F.floor(column.cast("double") / F.lit(float(interval))).cast("long")


def _shown_steps(counts: DataFrame, name: str, interval: float) -> DataFrame:
    """Counts (step, n) with the empty steps between the first and the last."""
    span = counts.agg(F.min("step").alias("low"), F.max("step").alias("high")).filter(F.col("low").isNotNull())
    filled = _fill(_numbers(span, "low", "high", "step"), counts, "step")
    return _shape(filled, name, key=(F.col("step") * F.lit(float(interval))).cast("string"), frequency=F.col("n"))


def histogram(df: DataFrame, column: Column, name: str, interval: float) -> DataFrame:
    """Counts per step of a numeric axis; steps without rows between the first and the last count 0."""
    counts = df.filter(column.isNotNull()).groupBy(_step(column, interval).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return _shown_steps(counts, name, interval)


# Numbers one array holds when a span is spelled out.
_BLOCK = 10_000


def _numbers(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """One row per whole number from `low` to `high` of each row, however many: in blocks, which spread over tasks."""
    blocks = df.withColumn("_start", F.explode(F.sequence(low, high, F.lit(_BLOCK).cast("long"))))
    blocks = blocks.hint("rebalance")
    last = F.least(F.col(high), F.col("_start") + F.lit(_BLOCK - 1))
    return blocks.withColumn(name, F.explode(F.sequence(F.col("_start"), last))).drop("_start")


def _fill(axis: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Axis steps with their counts, 0 where there is none: a union and a sum, cheaper than an outer join."""
    zeros = axis.select(key, F.lit(0).cast("bigint").alias("n"))
    return zeros.unionByName(counts).groupBy(key).agg(F.sum("n").alias("n"))


def datetime_histogram(df: DataFrame, interval: str = "month", name: str = "datetime_frequency") -> DataFrame:
    """Counts per calendar step (weeks start on Monday); steps without rows between first and last count 0."""
    if interval not in INTERVALS:
        raise ValueError(f"the interval must be one of {', '.join(INTERVALS)}")
    dt = Fields.of(df).get("datetime").column
    counts = (
        df.filter(dt.isNotNull())
        .groupBy(trunc_utc(interval, dt).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _shown_dates(counts, interval, name)


def _shown_dates(counts: DataFrame, interval: str, name: str = "datetime_frequency") -> DataFrame:
    """Counts (step, n) with the empty calendar steps between the first and the last."""
    span = counts.agg(F.min("step").alias("low"), F.max("step").alias("high")).filter(F.col("low").isNotNull())
    if interval in ("hour", "minute", "second"):
        # by day first, the days spread over tasks
        days = span.select("low", "high", F.explode(F.sequence(
            trunc_utc("day", F.col("low")), F.col("high"), F.expr("INTERVAL 1 DAY"))).alias("day"))
        axis = days.repartition("day").select(F.explode(F.sequence(
            F.greatest("low", "day"),
            F.least(F.col("high"), F.col("day") + F.expr("INTERVAL 1 DAY") - F.expr(f"INTERVAL 1 {interval}")),
            F.expr(f"INTERVAL 1 {interval}"),
        )).alias("step"))
    else:
        unit = {"quarter": "3 MONTH", "week": "7 DAY"}.get(interval, f"1 {interval}")
        axis = span.select(F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {unit}"))).alias("step"))
    filled = _fill(axis, counts, "step")
    return _shape(filled, name, key=rfc3339(F.col("step")), frequency=F.col("n"))


# ---------------------------------------------------------------- grids


def _cells_to_output(cells: DataFrame, name: str, key: Column, weight: Column | None = None) -> DataFrame:
    """Count cells by their numbers; the text of a cell is only made once per distinct cell."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    columns = [c for c in cells.columns if c != "weight"]
    counts = cells.groupBy(*columns).agg(n.alias("n")).select(key.alias("key"), "n")
    # the grids report no remainder
    shown = first_keys(counts, GRID_BUCKETS, largest_key_first=True)
    return _shape(shown, name, key=F.col("key"), frequency=F.col("n"))


def _centroid_cell(df: DataFrame, kind: str, precision: int) -> tuple[Column, Column]:
    """Column and row of the cell the centroid lies in."""
    low, high = GRIDS[f"centroid_{kind}_grid_frequency"]
    if not low <= precision <= high:
        raise ValueError(f"the precision must lie between {low} and {high}")
    fields = Fields.of(df, {"centroid.lon": "proj:centroid.lon", "centroid.lat": "proj:centroid.lat"})
    plain = Fields.of(df)
    lon = (fields.get("centroid.lon") or plain.get("centroid.lon") or plain.get("lon")).column
    lat = (fields.get("centroid.lat") or plain.get("centroid.lat") or plain.get("lat")).column
    column, row, _, _ = _GRID_FUNCTIONS[kind]
    there = lon.isNotNull() & lat.isNotNull()
    return F.when(there, column(lon, precision)), F.when(there, row(lat, precision))


def centroid_grid(df: DataFrame, kind: str, precision: int) -> DataFrame:
    """Counts per geohash or geotile cell of the centroid (fields `centroid.lat`, `centroid.lon`)."""
    cx, cy = _centroid_cell(df, kind, precision)
    cells = df.select(cx.alias("cx"), cy.alias("cy")).filter(F.col("cx").isNotNull())
    name_of = _GRID_FUNCTIONS[kind][2]
    return _cells_to_output(cells, f"centroid_{kind}_grid_frequency", name_of(F.col("cx"), F.col("cy"), precision))


_GRID_FUNCTIONS = {
    "geohash": (grids.geohash_column, grids.geohash_row, grids.geohash_name, grids.geohash_cell_box),
    "geotile": (grids.geotile_column, grids.geotile_row, grids.geotile_name, grids.geotile_cell_box),
}


def geometry_grid(df: DataFrame, kind: str, precision: int) -> DataFrame:
    """Counts per cell that a row's geometry touches; every touched cell counts the row once.

    Shapes that fill their bounds are counted per distinct range of cells first, and each range is spelled out once
    with that count. Other shapes become one row per grid column under their bounds; in each column, the spans of
    latitude the shape covers give the cells. Ranges of any size are spelled out in blocks. Grids finer than `SPELLED`
    are not spelled out: see `fine_grid`.
    """
    name = f"geometry_{kind}_grid_frequency"
    low, high = GRIDS[name]
    if not low <= precision <= high:
        raise ValueError(f"the precision must lie between {low} and {high}")
    fields = Fields.of(df)
    minx, miny, maxx, maxy = (fields.get(n).column for n in ("minx", "miny", "maxx", "maxy"))
    column, row, name_of, box = _GRID_FUNCTIONS[kind]

    def rows_between(south: Column, north: Column) -> tuple[Column, Column]:
        # tile rows count from the north
        return (row(south, precision), row(north, precision)) if kind == "geohash" else (
            row(north, precision), row(south, precision))

    first_x, last_x = column(minx, precision), column(maxx, precision)
    first_y, last_y = rows_between(miny, maxy)
    shape = fields.get("geometry")
    ranges_ = {"x0": first_x, "x1": last_x, "y0": first_y, "y1": last_y}
    rows = df.filter(minx.isNotNull())
    filled = rows if shape is None else rows.filter(is_box(shape.column, minx, miny, maxx, maxy))
    weighted = filled.select(*[c.alias(n) for n, c in ranges_.items()]).groupBy(*ranges_).agg(F.count(F.lit(1)).alias("weight"))
    exact = None if shape is None else rows.filter(~is_box(shape.column, minx, miny, maxx, maxy)).select(
        *[c.alias(n) for n, c in ranges_.items()], eastward(shape_of(shape.column)).alias("shape"))
    if precision > SPELLED[kind]:
        if exact is not None:
            shapes = exact.select(*ranges_, F.lit(1).cast("bigint").alias("weight"), "shape")
            weighted = shapes.unionByName(weighted, allowMissingColumns=True)
        cells = frequent_cells(materialised(weighted), kind, precision, GRID_BUCKETS)
        return _cells_to_output(cells, name, name_of(F.col("cx"), F.col("cy"), precision), F.col("weight"))
    cells = _numbers(_numbers(weighted, "x0", "x1", "cx"), "y0", "y1", "cy").select("cx", "cy", "weight")
    if exact is not None:
        strips = _numbers(exact, "x0", "x1", "strip")
        left, _, right, _ = box(F.col("strip"), F.lit(0), precision)
        spans = strips.select("strip", spans_between(F.col("shape"), left, right).alias("spans"))
        touched = F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(*rows_between(s["low"], s["high"])))))
        partly = spans.select(F.col("strip").alias("cx"), F.explode(touched).alias("cy"), F.lit(1).cast("bigint").alias("weight"))
        cells = cells.unionByName(partly)
    return _cells_to_output(cells, name, name_of(F.col("cx"), F.col("cy"), precision), F.col("weight"))


# ---------------------------------------------------------------- a whole request


def aggregate(df: DataFrame, request: AggregationRequest) -> DataFrame:
    """All aggregations of a request over one filtered frame, as one frame.

    One pass over the rows counts the keys of everything but geometry grids: single values, terms, ranges, histograms and
    centroid grids. The distinct keys are written once, and every aggregation is finished from them.
    """
    request = request.checked()
    fields, names = Fields.of(df), list(dict.fromkeys(request.aggregations))
    keys: dict[str, Column] = {}
    dt = fields.get("datetime")
    if any(n in METRICS for n in names):
        keys["total_count"] = F.when(fields.get("id").column.isNotNull(), F.lit("")).otherwise("no id")
    for name in names:
        source, kind = name.split("_")[0], name.split("_")[1] if "_" in name else ""
        if name in TERMS:
            keys[name] = _term(fields, name)
        elif name in HISTOGRAMS and fields.get(HISTOGRAMS[name][0]) is not None:
            keys[name] = _step(fields.get(HISTOGRAMS[name][0]).column, HISTOGRAMS[name][1])
        elif name == "cloud_cover_frequency":
            found = fields.get("eo:cloud_cover")
            keys[name] = _range(F.lit(None).cast("double") if found is None else found.column)
        elif name == "datetime_frequency":
            keys[name] = trunc_utc(request.datetime_interval, dt.column)
        elif name in GRIDS and source == "centroid":
            cx, cy = _centroid_cell(df, kind, request.precision[name])
            keys[name] = F.concat_ws(" ", cx, F.when(cx.isNotNull(), cy))
            keys[name] = F.when(cx.isNotNull(), keys[name])
    time = F.lit(None).cast("timestamp_ntz") if dt is None else dt.column
    counts = materialised(count_keys(df, keys, time.alias("_time"))) if keys else None

    def of(name: str) -> DataFrame:
        return counts.filter(F.col("name") == name)

    out = []
    if "total_count" in keys:
        out.append(_shown_metrics(of("total_count"), names))
    if any(n in TERMS for n in names):
        out.append(_shown_terms(counts.filter(F.col("name").isin([n for n in names if n in TERMS])), [n for n in names if n in TERMS]))
    for name in names:
        kind = name.split("_")[1] if "_" in name else ""
        if name in HISTOGRAMS and name in keys:
            out.append(_shown_steps(of(name).select(F.col("key").cast("long").alias("step"), "n"), name, HISTOGRAMS[name][1]))
        elif name == "cloud_cover_frequency":
            out.append(_shown_ranges(df.sparkSession, of(name).select(F.col("key").cast("int").alias("place"), "n"), name))
        elif name == "datetime_frequency":
            out.append(_shown_dates(of(name).select(F.col("key").cast("timestamp_ntz").alias("step"), "n"), request.datetime_interval))
        elif name in GRIDS and name in keys:
            x, y = (F.get(F.split("key", " "), i).cast("bigint") for i in (0, 1))
            cells = of(name).select(x.alias("cx"), y.alias("cy"), F.col("n").alias("weight"))
            key = _GRID_FUNCTIONS[kind][2](F.col("cx"), F.col("cy"), request.precision[name])
            out.append(_cells_to_output(cells, name, key, F.col("weight")))
        elif name in GRIDS:
            out.append(geometry_grid(df, kind, request.precision[name]))
    if not out:
        raise ValueError("none of the aggregations is known")
    return reduce(DataFrame.unionByName, out)


def available(collections: DataFrame, collection_id: str | None = None) -> DataFrame:
    """(collection, name) of what may be asked: a collection's own list, or the defaults where it has none.

    Without a collection, the defaults alone, under a null collection.
    """
    defaults = F.array(*[F.lit(n) for n in DEFAULT_AGGREGATIONS])
    rows = collections.filter(F.col("id") == collection_id) if collection_id else collections
    own = F.col("aggregations.name") if "aggregations" in collections.columns else F.lit(None).cast("array<string>")
    return rows.select(F.col("id").alias("collection"), F.explode(F.coalesce(own, defaults)).alias("name"))


def check_available(names: Sequence[str], collections: DataFrame, wanted: Sequence[str]) -> None:
    """Refuse an aggregation that some asked-for collection does not offer. The defaults are offered by all."""
    extra = [n for n in names if n not in DEFAULT_AGGREGATIONS]
    if not wanted and extra:
        raise ValueError(f"not offered for the whole catalogue: {', '.join(extra)}")
    if not extra:
        return
    offered = available(collections.filter(F.col("id").isin(list(wanted)))).filter(F.col("name").isin(extra))
    per_name = {r["name"]: r["n"] for r in offered.groupBy("name").agg(F.countDistinct("collection").alias("n")).collect()}
    refused = [n for n in extra if per_name.get(n, 0) < len(set(wanted))]
    if refused:
        raise ValueError(f"not offered by every collection asked for: {', '.join(refused)}")


def unique_values(df: DataFrame, names: Sequence[str], limit: int = 100) -> DataFrame:
    """(field, value) of every distinct value; a field with more than `limit` values is left out.

    Distinct values are found by a grouped shuffle, never gathered into one set.
    """
    fields = Fields.of(df)
    pairs = []
    for name in names:
        found = fields.get(name)
        if found is not None:
            values = found.column if found.is_array else F.array(found.column)
            pairs.append(F.struct(F.lit(name).alias("field"), F.transform(values, lambda v: v.cast("string")).alias("values")))
    values = (
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .select("p.field", F.explode("p.values").alias("value"))
        .filter(F.col("value").isNotNull())
        .distinct()
    )
    return few_values(values, limit)


def few_values(values: DataFrame, limit: int = 100) -> DataFrame:
    """Of distinct (field, value) rows those of fields with at most `limit` values."""
    small = values.groupBy("field").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= limit).select("field")
    # one row per asked-for field: bounded by the request
    return values.join(F.broadcast(small), "field", "left_semi")
