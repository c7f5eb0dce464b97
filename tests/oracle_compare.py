"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Rows are compared as multisets after sorting columns by name, rounding
floats to 6 places and rendering timestamps as ISO text.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from convlytics.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    if isinstance(v, int):
        return float(v)
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return names, out


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as exc:  # noqa: BLE001
            results[name] = f"SPARK-ERROR {type(exc).__name__}: {str(exc)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        if name not in sqls:
            results[name] = f"rows-only {len(srows)}"
            if verbose:
                print(name, results[name], f"{time.time() - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            results[name] = f"SQL-ERROR {str(exc)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        sn, sr = canon(scols, srows)
        dn, dr = canon(dcols, drows)
        if sn != dn:
            results[name] = f"SCHEMA {sn} vs {dn}"
        elif len(sr) != len(dr):
            results[name] = f"ROWCOUNT {len(sr)} vs {len(dr)}"
        elif sr != dr:
            bad = next(i for i in range(len(sr)) if sr[i] != dr[i])
            results[name] = f"VALUES first diff row {bad}: {str(sr[bad])[:300]} vs {str(dr[bad])[:300]}"
        else:
            results[name] = f"OK {len(sr)}"
        if verbose:
            print(name, results[name], f"{time.time() - t0:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    from convlytics.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v)
