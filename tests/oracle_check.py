"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]

Compares row count, column names and an order-insensitive hash of values
(floats rounded to 9 significant decimals), like the driver's gate, and prints
one line per query plus a JSON summary on the last line.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {str(k): _norm(x) for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))}
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return v


def digest(cols, rows) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    import __spark_entry__ as E
    from cadenza.session import get_spark

    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    summary = {}
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        rec = {"oracle": name in sqls}
        try:
            df = fn(spark, sf_dir)
            srows = df.collect()
            scols = df.columns
            rec["rows"] = len(srows)
            rec["spark_s"] = round(time.time() - t0, 2)
            if name in sqls:
                res = con.execute(sqls[name])
                dcols = [d[0] for d in res.description]
                drows = res.fetchall()
                rec["oracle_rows"] = len(drows)
                rec["cols_match"] = sorted(scols) == sorted(dcols)
                rec["match"] = rec["cols_match"] and len(srows) == len(drows) and digest(scols, srows) == digest(dcols, drows)
                if not rec["cols_match"]:
                    rec["cols"] = [sorted(set(scols) - set(dcols)), sorted(set(dcols) - set(scols))]
        except Exception as e:  # noqa: BLE001
            rec["error"] = f"{type(e).__name__}: {str(e)[:400]}"
        summary[name] = rec
        print(name, rec, flush=True)
    ok = sum(1 for r in summary.values() if r.get("match"))
    print(json.dumps({"checked": len(summary), "matched": ok,
                      "failed": [k for k, r in summary.items() if r.get("oracle") and not r.get("match")]}))


if __name__ == "__main__":
    main()
