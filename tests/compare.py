"""Run named queries in Spark and their SQL equivalents in DuckDB, and compare every value.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

from specaudit.plans import all_builders, all_oracles
from specaudit.session import local_session
from specaudit.sources.views import BASE_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return v
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_value(r[i]) for i in order)) for r in rows)


def compare(spark, con, folder: str, name: str, builders, oracles) -> tuple[str, str]:
    """(state, detail): state is ok, rows, FAIL or ERROR."""
    t0 = time.time()
    try:
        df = builders[name](spark, folder)
        got = df.collect()
    except Exception as e:  # noqa: BLE001
        return "ERROR", f"spark: {str(e)[:1500]}"
    t1 = time.time()
    if name not in oracles:
        return "rows", f"{len(got)} rows {t1 - t0:.1f}s"
    try:
        res = con.execute(oracles[name])
        columns = [d[0] for d in res.description]
        want = res.fetchall()
    except Exception as e:  # noqa: BLE001
        return "ERROR", f"sql: {str(e)[:1500]}"
    detail = f"{len(got)} rows spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = _rows(df.columns, got), _rows(columns, want)
    if a == b:
        return "ok", detail
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return "FAIL", f"{len(a)} vs {len(b)} rows; {sorted(columns)}\n  spark {only_a}\n  sql   {only_b}"


def main(argv: list[str]) -> int:
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    builders, oracles = all_builders(), all_oracles()
    names = argv or list(builders)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        state, detail = compare(spark, con, folder, name, builders, oracles)
        bad += state in ("FAIL", "ERROR")
        print(f"{state:6} {name}: {detail}", flush=True)
    print(f"{len(names)} queries, {bad} bad, {sum(n in oracles for n in names)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
