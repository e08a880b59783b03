"""Run registered queries in Spark and their SQL in DuckDB; compare rows, names and values.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Prints one line per query and a JSON summary on the last line.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def table_digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [columns[i] for i in order], h, lines


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck_connect(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            report[name] = {"ok": False, "error": f"spark: {exc!r}"[:400]}
            print(name, "SPARK ERROR", repr(exc)[:400], flush=True)
            continue
        t_spark = time.time() - t0
        entry_ = {"rows": len(s_rows), "spark_sec": round(t_spark, 2)}
        if name in sqls:
            try:
                cur = con.execute(sqls[name])
                d_cols = [d[0] for d in cur.description]
                d_rows = cur.fetchall()
            except Exception as exc:  # noqa: BLE001
                report[name] = {**entry_, "ok": False, "error": f"duckdb: {exc!r}"[:400]}
                print(name, "DUCKDB ERROR", repr(exc)[:400], flush=True)
                continue
            sc, sh, sl = table_digest(s_cols, s_rows)
            dc, dh, dl = table_digest(d_cols, d_rows)
            ok = sc == dc and len(s_rows) == len(d_rows) and sh == dh
            entry_.update(ok=ok, oracle_rows=len(d_rows))
            if not ok and verbose:
                print(name, "MISMATCH cols", sc, dc, "rows", len(s_rows), len(d_rows), flush=True)
                only_s = sorted(set(sl) - set(dl))[:5]
                only_d = sorted(set(dl) - set(sl))[:5]
                print("  spark-only:", only_s, "\n  duck-only:", only_d, flush=True)
        else:
            entry_.update(ok=None)
        report[name] = entry_
        print(name, entry_, flush=True)
    return report


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    from trolley.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    report = compare(spark, sf_dir, names)
    bad = [k for k, v in report.items() if v.get("ok") is False]
    print(json.dumps({"n": len(report), "bad": bad}))


if __name__ == "__main__":
    main()
