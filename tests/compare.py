"""Run registered queries beside their SQL: python tests/compare.py [folder] [query ...]"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return repr(x)
    return str(x)


def _kind(dtype: str) -> str:
    name = dtype.lower()
    return {
        "bigint": "long", "int64": "long", "integer": "int", "varchar": "string", "int32": "int",
        "timestamp_ntz": "timestamp", "timestamp[us]": "timestamp",
    }.get(name, name)


def difference(spark, con, job, sql: str, folder: str) -> tuple[str | None, int]:
    """(None, rows) when the two agree, else (what differs, rows)."""
    got = job(spark, folder)
    schema = dict(got.dtypes)
    cols = sorted(schema)
    rows = sorted(tuple(_cell(r[c]) for c in cols) for r in got.collect())
    want = con.sql(sql)
    names = dict(zip(want.columns, [str(t) for t in want.types]))
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}", len(rows)
    kinds = [(c, _kind(schema[c]), _kind(names[c])) for c in cols]
    wrong = [k for k in kinds if k[1] != k[2]]
    if wrong:
        return f"types {wrong}", len(rows)
    place = [want.columns.index(c) for c in cols]
    theirs = sorted(tuple(_cell(r[i]) for i in place) for r in want.fetchall())
    if len(rows) != len(theirs):
        return f"{len(rows)} rows against {len(theirs)}", len(rows)
    bad = [(a, b) for a, b in zip(rows, theirs) if a != b]
    return (f"{len(bad)} of {len(rows)} rows, first {bad[0]}" if bad else None), len(rows)


def main() -> int:
    from stationlake.catalog import ORACLES, QUERIES
    from stationlake.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = get_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-")},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    failed = 0
    for name in wanted:
        began = time.time()
        try:
            problem, n = difference(spark, con, QUERIES[name], ORACLES[name], folder)
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__} {str(e)[:600]}", 0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={n} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
