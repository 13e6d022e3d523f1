"""Runs a registered query and its oracle SQL side by side. Usage: python tests/oracle_check.py [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype.kind == "f":
            pdf[c] = pdf[c].astype(float) + 0.0
        elif pdf[c].dtype == object:
            pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v)
    if len(pdf.columns):
        pdf = pdf.sort_values(list(pdf.columns), key=lambda s: s.map(lambda v: (v is None or v != v, str(v)))
                              if s.dtype == object else s, kind="stable").reset_index(drop=True)
    return pdf


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _canon(got), _canon(want)
    kinds = [(c, a[c].dtype.kind, b[c].dtype.kind) for c in a.columns
             if a[c].dtype.kind != b[c].dtype.kind and not a[c].isna().any()]  # nulls change the kind in pandas
    for c in a.columns:
        left, right = a[c], b[c]
        if left.dtype.kind == "f" or right.dtype.kind == "f":
            left, right = left.astype(float), right.astype(float)
            bad = ~((left == right) | (left.isna() & right.isna()))
        else:
            bad = pd.Series([x != y and not (pd.isna(x) and pd.isna(y)) for x, y in zip(left.astype(object), right.astype(object))])
        if bad.any():
            i = int(bad.to_numpy().argmax())
            return f"{int(bad.sum())} values differ in {c}; first {left[i]!r} != {right[i]!r}"
    return f"type kinds {kinds}" if kinds else None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from assaylake.session import local_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        t0 = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"ROWS {name} rows={len(got)} spark={t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            diff = difference(got, want)
            print(f"{'OK  ' if diff is None else 'FAIL'} {name} rows={len(got)} spark={t1 - t0:.1f}s "
                  f"sql={time.time() - t1:.1f}s {diff or ''}", flush=True)
            failed += diff is not None
        except Exception as e:  # report and go on with the next query
            failed += 1
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
