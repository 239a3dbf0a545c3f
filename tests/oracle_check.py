"""Run registered queries next to their SQL counterparts and compare all values.

python tests/oracle_check.py [table folder] [name part ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return None if value is None else str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    values = sorted(
        [tuple(plain(r[i]) for i in order) for r in rows], key=lambda t: [(v is None, v or "") for v in t]
    )
    return [columns[i] for i in order], values


def compare(frame, con, sql: str) -> str:
    """Empty when equal, else what differs first."""
    cursor = con.execute(sql)
    expected = table_of([d[0] for d in cursor.description], cursor.fetchall())
    actual = table_of(frame.columns, [tuple(r) for r in frame.collect()])
    if expected[0] != actual[0]:
        return f"columns {actual[0]} != {expected[0]}"
    if len(expected[1]) != len(actual[1]):
        return f"rows {len(actual[1])} != {len(expected[1])}"
    for a, e in zip(actual[1], expected[1]):
        if a != e:
            diff = [(c, x, y) for c, x, y in zip(actual[0], a, e) if x != y]
            return f"first difference {diff} in {a}"
    return ""


def main() -> None:
    from tests.conftest import make_session
    from tallyscope.plans import oracles, registry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = make_session(), connect(folder)
    sqls, good = oracles.oracle_sql(), 0
    names = [n for n in registry.queries() if not parts or any(p in n for p in parts)]
    for name in names:
        start = time.time()
        try:
            frame = registry.queries()[name](spark, folder)
            result = compare(frame, con, sqls[name]) if name in sqls else f"rows only {frame.count()}"
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        good += not result
        print(f"{name:34s} {time.time() - start:6.1f}s {result or 'equal'}", flush=True)
    print(f"{good} of {len(names)} equal")


if __name__ == "__main__":
    main()
