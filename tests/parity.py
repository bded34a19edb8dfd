"""Run queries against their SQL twins: python tests/parity.py [sf_dir] [name-prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(norm(row[i]) for i in order) for row in rows]


def compare(spark, con, sf_dir, run, sql):
    """(ok, message) for one query."""
    from collections import Counter

    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {type(v) for row in got[:2000] for v in row} ^ {type(v) for row in want[:2000] for v in row}
    a, b = Counter(got), Counter(want)
    if a != b:
        extra, lack = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(got)} vs {len(want)} rows; differing {sum((a - b).values())}; cols {sorted(names)}; spark {extra}; sql {lack}"
    return bool(got), f"{len(got)} rows" + (f" (types {types})" if types else "")


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from dustledger.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    bad = 0
    for name, run in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            if name in oracle_sql():
                ok, text = compare(spark, con, sf_dir, run, oracle_sql()[name])
            else:
                n = run(spark, sf_dir).count()
                ok, text = n > 0, f"{n} rows, no SQL"
        except Exception as exc:  # report and go on to the next query
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - started:.1f}s {text}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
