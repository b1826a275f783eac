"""Run registered queries next to their SQL and compare every value.

    python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        table = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {table} as select * from read_parquet('{path}')")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "<null>"
        if isinstance(value, pd.Timestamp):
            return value.isoformat()
        if isinstance(value, bool) or type(value).__name__ == "bool":
            return str(bool(value))
        if isinstance(value, float) or type(value).__name__.startswith("float"):
            return repr(float(value) + 0.0)
        return str(value)

    columns = sorted(frame.columns)
    nullable_floats = frame[columns].copy()
    for column in columns:
        if pd.api.types.is_integer_dtype(nullable_floats[column]):
            nullable_floats[column] = nullable_floats[column].astype(object)
    return sorted(tuple(plain(v) for v in row) for row in nullable_floats.itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    got = got.copy()
    for column in got.columns:
        if isinstance(want[column].dtype, pd.Int64Dtype) and pd.api.types.is_float_dtype(got[column]) and (got[column].dropna() % 1 == 0).all():
            got[column] = got[column].astype("Int64")  # whole numbers with nulls, which a plain column holds as floats
    for column in got.columns:
        g, w = got[column], want[column]
        if pd.api.types.is_float_dtype(g) != pd.api.types.is_float_dtype(w) and pd.api.types.is_numeric_dtype(g):
            return f"column {column}: type {g.dtype} against {w.dtype}"
    ours, theirs = rows(got), rows(want)
    for a, b in zip(ours, theirs):
        if a != b:
            only = [x for x in ours if x not in set(theirs)][:2]
            missing = [x for x in theirs if x not in set(ours)][:2]
            return f"{sorted(got.columns)}\n   ours {only}\n   sql  {missing}"
    return None


def main() -> int:
    from skyreel.session import local_session

    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("prefixes", nargs="*")
    options = parser.parse_args()
    folder = f"/root/testdata/sf{options.sf}"
    spark = local_session("8")
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not options.prefixes or any(n.startswith(p) for p in options.prefixes)]
    connection, failed, spent = duck(folder), [], []
    for name in chosen:
        began = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - began
            spent.append((took, name))
            note = difference(got, connection.sql(oracles[name]).df()) if name in oracles else "(no SQL)"
        except Exception as error:  # noqa: BLE001
            took, note = time.time() - began, f"{type(error).__name__}: {str(error)[:1500]}"
            if "-v" in os.environ.get("ORACLE", ""):
                traceback.print_exc()
            got = pd.DataFrame()
        ok = note is None or note == "(no SQL)"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:44s} {len(got):8d} rows {took:6.2f}s {'' if note is None else note}", flush=True)
    print(f"{len(chosen)} queries, {len(failed)} failed: {failed}")
    print("slowest:", [(f"{s:.1f}", n) for s, n in sorted(spent, reverse=True)[:12]])
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
