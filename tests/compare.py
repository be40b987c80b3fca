"""Run registered queries and compare them with their SQL on DuckDB: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def table_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(row[i]) for i in order]) for row in rows)


def kinds(columns, rows):
    return {c: {type(r[i]).__name__ for r in rows if r[i] is not None} for i, c in enumerate(columns)}


def main() -> None:
    from alertlake.plans.catalog import load_all
    from alertlake.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("compare", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, q in load_all().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = q.build(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(got)} rows {took:.2f}s {df.columns if names else ''}", flush=True)
            if names:
                for r in got[:3]:
                    print("     ", str(r)[:700])
            continue
        start = time.time()
        try:
            cur = con.execute(q.sql)
            want_columns = [d[0] for d in cur.description]
            want = cur.fetchall()
        except Exception as error:
            bad += 1
            print(f"SQL  {name}: {str(error)[:1500]}", flush=True)
            continue
        a, b = table_of(df.columns, got), table_of(want_columns, want)
        ok = a == b and kinds(df.columns, got) == kinds(want_columns, want)
        bad += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got)} rows {took:.2f}s (sql {time.time() - start:.2f}s)", flush=True)
        if not ok:
            print("   columns", a[0], b[0], "\n   kinds", kinds(df.columns, got), kinds(want_columns, want))
            print("   rows", len(a[1]), len(b[1]))
            only = [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3]
            print("   spark only", *[o[:600] for o in only[0]], sep="\n      ")
            print("   sql only", *[o[:600] for o in only[1]], sep="\n      ")
    print("bad:", bad)


if __name__ == "__main__":
    main()
