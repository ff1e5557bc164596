"""Run named queries and their SQL twins side by side: ``compare.py [--sf DIR] [prefix ...]``."""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import warnings

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.plans import all_oracles, all_queries  # noqa: E402
from tickloom.session import local_session  # noqa: E402


warnings.filterwarnings("ignore")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        kind = str(out[c].dtype)
        if kind.startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        elif kind in ("bool", "boolean"):
            out[c] = out[c].astype(str)
        elif kind == "object" or kind.startswith("str"):
            out[c] = out[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else str(v))
        else:
            out[c] = out[c].astype("float64")
    return out.sort_values(list(out.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        if a[c].dtype != b[c].dtype:
            return f"column {c}: {a[c].dtype} vs {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"column {c} ({(~same).sum()} rows), first: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("prefix", nargs="*")
    args = ap.parse_args()
    spark, con, oracles, bad = local_session(), connect(args.sf), all_oracles(), 0
    for name, fn in all_queries().items():
        if args.prefix and not any(name == p or name.startswith(p + "_") or (p.endswith("*") and name.startswith(p[:-1])) for p in args.prefix):
            continue
        t0 = time.time()
        try:
            got = fn(spark, args.sf).toPandas()
            took = time.time() - t0
            if name not in oracles:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            t1 = time.time()
            want = con.sql(oracles[name]).df()
            diff = difference(got, want)
            print(f"{'OK  ' if diff is None else 'DIFF'} {name} {len(got)} {took:.1f}s duck {time.time() - t1:.1f}s", diff or "", flush=True)
            bad += diff is not None
        except Exception as exc:  # report every query
            print("FAIL", name, str(exc).replace(chr(10)," ")[:700], flush=True)
            bad += 1
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
