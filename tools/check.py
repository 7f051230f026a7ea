"""Compare registered queries with their SQL in DuckDB: ``check.py SF [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tonewell.plans import catalog  # noqa: E402
from tonewell.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def main() -> int:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    names = [n for n in catalog.QUERIES if not wanted or any(w in n for w in wanted)]
    spark = local_session(cpus="8")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            cols = sorted(df.columns)
            rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
            spent = time.time() - start
            if name not in catalog.ORACLES:
                print(f"rows {name:32s} {len(rows):8d} {spent:6.2f}s")
                continue
            start = time.time()
            cur = con.execute(catalog.ORACLES[name])
            have = [d[0] for d in cur.description]
            raw = cur.fetchall()
            sql_time = time.time() - start
            if sorted(have) != cols:
                print(f"BAD  {name}: columns {cols} vs {sorted(have)}")
                bad += 1
                continue
            wide = [d[0] for d in cur.description if str(d[1]).startswith(("HUGEINT", "DECIMAL", "UHUGEINT"))]
            if wide:
                print(f"TYPE {name}: cast {wide} in the SQL")
            at = [have.index(c) for c in cols]
            expect = [tuple(plain(r[i]) for i in at) for r in raw]
            a, b = Counter(rows), Counter(expect)
            if a == b:
                print(f"ok   {name:32s} {len(rows):8d} {spent:6.2f}s sql {sql_time:5.2f}s")
            else:
                bad += 1
                print(f"BAD  {name}: rows {len(rows)} vs {len(expect)}, cols {cols}")
                for row in list((a - b).elements())[:3]:
                    print("   spark", str(row)[:300])
                for row in list((b - a).elements())[:3]:
                    print("   sql  ", str(row)[:300])
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {str(exc)[:700]}")
    print("bad:", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
