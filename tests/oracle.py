"""Runs registered queries against their SQL twins in DuckDB and compares the results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        number = float(value)
        return None if math.isnan(number) else float(f"{number:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value if isinstance(value, str) else str(value)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    order = sorted(columns)
    right_at = [columns.index(c) for c in order]
    right = Counter(tuple(_norm(r[i]) for i in right_at) for r in want.fetchall())
    left = Counter(tuple(_norm(v) for v in r) for r in spark_df.select(*order).collect())
    if left == right:
        return None
    only_left = list((left - right).items())[:3]
    only_right = list((right - left).items())[:3]
    return (
        f"rows {sum(left.values())} vs {sum(right.values())}; columns {order}\n"
        f"   spark only ({sum((left - right).values())}): {only_left}\n"
        f"   sql only ({sum((right - left).values())}): {only_right}"
    )


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from gaugeworks.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                kind = "sql"
            else:
                problem, kind = None, f"rows={df.count()}"
        except Exception as error:  # report and go on with the next query
            problem, kind = f"{type(error).__name__}: {str(error)[:1500]}", "error"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - began:.1f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
