"""Run registered queries beside their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from palimpsest.catalog import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def check(spark, con, name: str, sf_dir: str):
    df = QUERIES[name](spark, sf_dir)
    got, cols = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return len(got), None
    cur = con.execute(ORACLES[name])
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols, f"{name}: columns {cols} vs {want_cols}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:5]
        only_want = [r for r in want if r not in set(got)][:5]
        raise AssertionError(
            f"{name}: {len(got)} rows vs {len(want)}\n cols {cols}\n got  {only_got}\n want {only_want}"
        )
    return len(got), True


if __name__ == "__main__":
    from palimpsest.session import local_session

    sf = f"/root/testdata/{sys.argv[1]}"
    names = [n for n in QUERIES if len(sys.argv) < 3 or any(a in n or QUERIES[n].__module__.endswith("." + a) for a in sys.argv[2:])]
    spark = local_session()
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            rows, ok = check(spark, con, n, sf)
            print(f"{'ok  ' if ok else 'rows'} {n} {rows} rows {time.time() - t:.1f}s", flush=True)
        except Exception as error:
            bad += 1
            text = str(error) if isinstance(error, AssertionError) else str(error)[:700] + "".join(traceback.format_tb(error.__traceback__)[-3:])[:900]
            print(f"FAIL {n} {time.time() - t:.1f}s {text}", flush=True)
    print("failures:", bad)
