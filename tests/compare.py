"""Run registered queries next to their SQL in DuckDB and compare rows.

python tests/compare.py SF [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "\x00null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def shape(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return type(a) is type(b) and a == b


def difference(df, con, sql) -> str | None:
    got_names, got = shape(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_names, want = shape(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    for g, w in zip(got, want):
        if not all(same(x, y) for x, y in zip(g, w)):
            return f"{got_names}\n   got  {g}\n   want {w}"
    return None if got else "both sides are empty"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from plumbline.runtime import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con, bad = local_session(8), duck(folder), 0
    oracles = oracle_sql()
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                issue = difference(df, con, oracles[name])
            else:
                rows = df.collect()
                issue = None if rows else "no rows"
                if wanted:
                    print("   ", rows[:3])
        except Exception as exc:  # report and go on with the next query
            issue = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += issue is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if issue is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {issue or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
