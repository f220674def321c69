"""Run queries beside their SQL and compare rows. Usage: check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table(names, rows):
    index = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(canonical(r[i]) for i in index) for r in rows)


def compare(spark, con, name, sf_dir):
    """None when equal, else a description."""
    from suite import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None
    cur = con.execute(ORACLES[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        lack = [r for r in want[1] if r not in set(got[1])][:3]
        return f"rows {len(got[1])} / {len(want[1])}; only spark {extra}; only sql {lack}"
    return None if got[1] else "both empty"


def main() -> int:
    from geoledger.session import build_session
    from suite import QUERIES

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    spark = build_session("check", "local[8]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="geoledger-check-"),
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in args[1:] or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as err:  # noqa: BLE001
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
