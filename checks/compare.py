"""Compare every registered query with its SQL on one scale factor.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from glob import glob
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES
from millrace.session import ensure_shared_folder


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return db


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, so that equal bags give equal frames."""
    frame = frame[sorted(frame.columns)]
    for name in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[name]):
            frame = frame.assign(**{name: frame[name].astype("datetime64[us]")})
    ordered = frame.sort_values(list(frame.columns), na_position="first")
    return ordered.reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """Why two results differ, or ``None``; values are compared exactly."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got, want = canonical(got), canonical(want)
    for name in got.columns:
        left, right = got[name], want[name]
        if left.dtype.kind != right.dtype.kind:
            return f"{name}: type {left.dtype} != {right.dtype}"
        same = (left == right) | (left.isna() & right.isna())
        if not same.all():
            at = same.idxmin()
            return f"{name}[{at}]: {left[at]!r} != {right[at]!r}"
    return None


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_folder(spark)
    db = connect(sf_dir)
    failed = 0
    for name in names:
        begun = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - begun
            problem = None
            if name in ORACLE:
                problem = difference(got, db.execute(ORACLE[name]).df())
        except Exception as failure:
            got, took, problem = [], time.time() - begun, str(failure)[:1500]
        failed += problem is not None
        print(f"{name:28} {len(got):8} rows {took:6.2f}s  {problem or 'ok'}", flush=True)
    print(f"{failed} of {len(names)} differ")
    sys.exit(failed > 0)


if __name__ == "__main__":
    main()
