"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle_check.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import importlib
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from threadloom.plans import base  # noqa: E402


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value == int(value) and abs(value) < 2**53:
        return int(value)
    if isinstance(value, list | tuple):
        return tuple(_cell(v) for v in value)
    return value if isinstance(value, int | float | str) else str(value)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in base.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def compare(spark, con, q: base.Query, root: str) -> tuple[bool, str]:
    t0 = time.time()
    df = q.build(base.Tables(spark, root))
    got = df.collect()
    spent = time.time() - t0
    if len(set(df.columns)) != len(df.columns):
        return False, "duplicate column names"
    if q.sql is None:
        return len(got) > 0, f"rows={len(got)} {spent:.1f}s rows-only"
    t1 = time.time()
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    note = f"rows={len(got)}/{len(want)} {spent:.1f}s sql {time.time() - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = bag(df.columns, got), bag(cols, want)
    if a == b:
        return bool(got), note + ("" if got else " EMPTY")
    names = sorted(cols)
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, f"{note}\n   cols {names}\n   spark {only_a}\n   sql   {only_b}"[:1800]


def main(argv: list[str]) -> int:
    root = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        root = argv[at + 1]
        del argv[at : at + 2]
    modules = [a[2:] for a in argv if a.startswith("m:")]
    wanted = [a for a in argv if not a.startswith("m:")]
    if modules:
        for m in modules:
            importlib.import_module(f"threadloom.plans.{m}")
        table = {n: q for n, q in base.QUERIES.items() if q.build.__module__.rsplit('.', 1)[-1] in modules}
    else:
        from threadloom.plans import catalogue

        table = catalogue()
    from threadloom.session import get_session

    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(root)
    bad = 0
    for name, q in table.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, q, root)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
