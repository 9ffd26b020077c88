"""Runs registered queries beside their SQL in DuckDB: python -m tests.compare FOLDER [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

import __spark_entry__ as entry
from kindred.session import local_session


def normal(pdf: pd.DataFrame) -> list[tuple]:
    """Rows as comparable tuples, columns by name, in any order."""

    def one(x):
        if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
            return tuple(one(y) for y in x)
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        return float(x) if isinstance(x, float) else int(x) if hasattr(x, "item") and not isinstance(x, str) and float(x).is_integer() and not isinstance(x.item(), float) else x.item() if hasattr(x, "item") else x

    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(one(x) for x in row) for row in pdf.itertuples(index=False)), key=repr)


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        at = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def compare(spark, folder: str, name: str, sql: str | None) -> tuple[str, bool]:
    began = time.time()
    df = entry.queries()[name](spark, folder)
    mine = pd.DataFrame(df.collect(), columns=df.columns, dtype=object)
    took = time.time() - began
    if sql is None:
        return f"{name}: {len(mine)} rows, {took:.1f} s, no SQL", True
    rel = views(folder).sql(sql)
    theirs = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"{name}: columns {sorted(mine.columns)} and {sorted(theirs.columns)}", False
    a, b = normal(mine), normal(theirs)
    if a == b:
        return f"{name}: equal, {len(a)} rows, {took:.1f} s", True
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{name}: DIFFERENT, {len(a)} and {len(b)} rows; only mine {only[0]}; only SQL {only[1]}; types {dict(zip(rel.columns, map(str, rel.types)))} {dict(df.dtypes)}", False


if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark, sql = local_session(), entry.oracle_sql()
    bad = 0
    for name in names or sorted(entry.queries()):
        try:
            said, ok = compare(spark, folder, name, sql.get(name))
        except Exception as e:  # noqa: BLE001
            said, ok = f"{name}: ERROR {str(e)[:1500]}", False
        bad += not ok
        print(said, flush=True)
    sys.exit(bool(bad))
