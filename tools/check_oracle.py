"""Compare every registered Spark query with its DuckDB oracle.

Usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]

Per query: row count, column names, column type families and an
order-insensitive hash of the values (floats rounded to 6 places) — the same
three checks the correctness gate applies.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import sys
import time

import duckdb

sys.path.insert(0, ".")

from tidemark.registry import ORACLE_SQL, QUERIES  # noqa: E402
from tidemark.session import get_session  # noqa: E402
from tidemark.sources.testmap import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, bool):
        return str(v)
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12], lines


FAMILY = {
    "bigint": "int64", "long": "int64", "int": "int32", "integer": "int32", "double": "float64",
    "string": "string", "varchar": "string", "date": "date", "boolean": "bool",
    "timestamp_ntz": "timestamp", "timestamp": "timestamp", "float": "float32",
    "smallint": "int16", "tinyint": "int8", "hugeint": "int128",
}


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
        stypes = [FAMILY.get(f.dataType.simpleString().split("(")[0], f.dataType.simpleString())
                  for f in df.schema.fields]
        ts = time.time() - t0
        if name not in ORACLE_SQL:
            print(f"{name:32s} spark rows={len(rows):7d} ({ts:.1f}s)  [no oracle]")
            continue
        cur = con.execute(ORACLE_SQL[name])
        ocols = [d[0] for d in cur.description]
        orows = cur.fetchall()
        otypes = [FAMILY.get(str(d[1]).lower().split("(")[0], str(d[1]).lower()) for d in cur.description]
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        schema_ok = sorted(zip(cols, stypes)) == sorted(zip(ocols, otypes))
        ok = len(rows) == len(orows) and schema_ok and h1 == h2
        bad += not ok
        print(f"{name:32s} spark rows={len(rows):7d} oracle rows={len(orows):7d} "
              f"schema={'ok' if schema_ok else 'DIFF'} hash={'ok' if h1 == h2 else 'DIFF'} ({ts:.1f}s)")
        if not schema_ok:
            print("   spark :", sorted(zip(cols, stypes)))
            print("   oracle:", sorted(zip(ocols, otypes)))
        if h1 != h2:
            s1, s2 = set(l1), set(l2)
            print("   only spark :", sorted(s1 - s2)[:3])
            print("   only oracle:", sorted(s2 - s1)[:3])
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
