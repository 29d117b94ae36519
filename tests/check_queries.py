"""Compare registered queries with their SQL: python tests/check_queries.py [sf] [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].map(lambda v: isinstance(v, (list, tuple))).any() or str(df[c].dtype) == "object" \
                and df[c].map(lambda v: hasattr(v, "tolist")).any():
            df[c] = df[c].map(lambda v: str([float(x) for x in v]) if v is not None else None)
        elif pd.api.types.is_numeric_dtype(df[c]) or df[c].isna().all():
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty when equal, else the first thing that differs."""
    a, b = normal(spark_rows), normal(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} / {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}: {int((~same).sum())} differ, e.g. {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from saleloom.session import local_session

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/{args.pop(0) if args else 'sf0.01'}"
    spark = local_session(8)
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            rows = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            if name in oracle:
                problem = difference(rows, con.execute(oracle[name]).df())
            else:
                problem = "" if len(rows) else "no rows"
            sql_took = time.time() - start
        except Exception as error:  # noqa: BLE001
            took = sql_took = time.time() - start
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s sql {sql_took:.1f}s "
              f"rows {len(rows) if not problem else '-'} {'' if name in oracle else '(rows only)'} {problem}",
              flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
