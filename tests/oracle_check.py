"""Run registered queries against their DuckDB twins: ``python tests/oracle_check.py DIR [names]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _normal(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def _sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs. Values have to match exactly."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    expected = rel.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    kinds = dict(zip(names, [str(c[1]) for c in rel.description]))
    got = [tuple(_normal(r[c]) for c in order) for r in spark_df.collect()]
    pos = [names.index(c) for c in order]
    want = [tuple(_normal(r[p]) for p in pos) for r in expected]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    wrong = [c for c in order if kinds[c].startswith(("HUGEINT", "DECIMAL"))]
    if wrong:
        return f"oracle types {[(c, kinds[c]) for c in wrong]}"
    got.sort(key=_sort_key)
    want.sort(key=_sort_key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        close = all(
            a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6))
            for g, w in bad for a, b in zip(g, w)
        )
        return f"{len(bad)} of {len(got)} rows differ (close={close}), first {bad[0]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from tests.conftest import build_session

    import __spark_entry__ as entry

    spark = build_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        begun = time.monotonic()
        try:
            df = fn(spark, sf_dir)
            problem = compare(df, con, oracles[name]) if name in oracles else (
                None if df.count() > 0 else "no rows"
            )
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:24s} {time.monotonic() - begun:7.2f}s {'ok' if problem is None else problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
