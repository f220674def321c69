"""Headline queries on $BENCH_SF_DIR: wall time of each after one warm-up. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "f_search", "f_search_all", "f_bbox", "f_intersects", "g_within", "f_free_text", "f_free_text_fuzzy", "f_free_text_documents",
    "cql_and", "cql_not", "cql_like", "s_default", "l_keyset_page", "p_include", "p_wildcard",
    "agg_collection_frequency", "agg_cloud_cover_frequency", "agg_sun_elevation_frequency", "agg_datetime_frequency_hour",
    "agg_centroid_geohash_grid", "agg_centroid_geotile_grid", "agg_geometry_geohash_grid", "agg_bundle", "agg_unique_values",
    "w_dedupe_last", "j_conflict", "m_bulk_create", "m_bulk_upsert", "m_merge_patch", "m_json_patch",
    "cat_descendants", "cat_search", "v_datetime_range", "typed_projection", "sd_queryables", "sink_items", "st_upsert_sink",
]


def main() -> None:
    from geoledger.session import build_session
    from suite import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="geoledger-bench-"),
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(run(name), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries, second run each", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
