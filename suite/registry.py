"""Registration of cases, and the SQL form of the catalogue views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ITEMS = """items_v AS (
  SELECT id, collection, raw_ts, datetime, start_datetime, end_datetime, lon, lat,
         greatest(lon - half, -180.0) AS minx, greatest(lat - half, -90.0) AS miny,
         least(lon + half, 180.0) AS maxx, least(lat + half, 90.0) AS maxy,
         cloud_cover, platform, sun_elevation, title, hidden, event_id, user_id
  FROM (
    SELECT 'e' || event_id AS id, 'c' || CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % (SELECT count(*) FROM supplier) END AS collection, ts AS raw_ts,
           CASE WHEN event_id % 7 <> 0 AND event_id % 29 <> 0 THEN ts END AS datetime,
           CASE WHEN event_id % 29 <> 0 AND (event_id % 7 = 0 OR event_id % 3 = 0) THEN ts END AS start_datetime,
           CASE WHEN event_id % 29 <> 0 AND (event_id % 7 = 0 OR event_id % 3 = 0)
                THEN ts + INTERVAL 3 DAY END AS end_datetime,
           CAST(event_id * 37 % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - 180 AS lon,
           CAST(event_id * 53 % 1700 AS DOUBLE) / CAST(10 AS DOUBLE) - 85 AS lat,
           CAST(event_id % 5 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS half,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS cloud_cover,
           CASE WHEN event_id % 11 <> 0 THEN event_type END AS platform,
           value AS sun_elevation, event_type || ' user ' || user_id AS title,
           CASE WHEN event_id % 2 <> 0 THEN event_id % 13 = 0 END AS hidden, event_id, user_id
    FROM events))"""

COLLECTIONS = ITEMS + """, extent_v AS (
  SELECT collection, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy,
         min(raw_ts) AS t_min, max(raw_ts) AS t_max
  FROM items_v GROUP BY collection),
collections_v AS (
  SELECT 'c' || s_suppkey AS id, 'Collection' AS type, s_name AS title, 'n' || s_nationkey AS parent,
         minx, miny, maxx, maxy, t_min, t_max
  FROM supplier LEFT JOIN extent_v ON extent_v.collection = 'c' || s_suppkey
  UNION ALL
  SELECT 'n' || n_nationkey, 'Catalog', n_name, 'r' || n_regionkey, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL
  SELECT 'r' || r_regionkey, 'Catalog', r_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region)"""


def in_time(a: str, b: str) -> str:
    """SQL of the time condition of a search."""
    return (
        f"((datetime IS NOT NULL AND datetime BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}') OR (datetime IS NULL AND "
        f"start_datetime <= TIMESTAMP '{b}' AND end_datetime >= TIMESTAMP '{a}'))"
    )


ANY_TIME = in_time("1970-01-01 00:00:00", "2262-04-11 23:47:16.854775")


def case(name: str, sql: str | None = None, views: str | None = ITEMS):
    """Register a query under `name`; `sql` may use the given views."""

    def add(query: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two cases named {name}")
        QUERIES[name] = query
        if sql:
            ORACLES[name] = f"WITH {views} {sql}" if views else sql
        return query

    return add
