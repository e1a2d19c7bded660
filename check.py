"""Runs registered queries on Spark and their checking SQL side by side: python check.py [sf] [name part ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from satbill.plans import catalog
from satbill.plans.bind import BASE
from satbill.session import local_session


def norm(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.4f}"
    return "" if value is None else str(value)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duckdb.connect()
    for base in BASE:
        con.execute(f"CREATE VIEW {base} AS SELECT * FROM '{folder}/{base}.parquet'")
    bad = 0
    for name, query in sorted(catalog.load().items()):
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = query.spark(spark, folder)
            left = sorted(tuple(norm(v) for v in row) for row in df.collect())
        except Exception as err:  # report and go on with the next query
            print(f"{name:40s} SPARK ERROR {str(err)[:600]}")
            bad += 1
            continue
        spent, sql = time.time() - start, query.check()
        if sql is None:
            print(f"{name:40s} rows={len(left):7d} {spent:6.2f}s  no check")
            continue
        start = time.time()
        try:
            cursor = con.execute(sql)
            names = [d[0] for d in cursor.description]
            right = sorted(tuple(norm(v) for v in row) for row in cursor.fetchall())
        except Exception as err:
            print(f"{name:40s} CHECK ERROR {str(err)[:600]}")
            bad += 1
            continue
        same = left == right and names == df.columns
        print(f"{name:40s} rows={len(left):7d} {spent:6.2f}s  {'ok' if same else 'DIFFERENT'} ({time.time() - start:.2f}s)")
        if not same:
            bad += 1
            extra, lost = set(left) - set(right), set(right) - set(left)
            print(f"   columns {df.columns == names}, rows {len(left)} / {len(right)}, only here {len(extra)}, only there {len(lost)}")
            for label, rows in (("here ", extra), ("there", lost)):
                for row in sorted(rows)[:3]:
                    print("   ", label, row)
    print("not matching:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
