"""Run every registered query and its SQL on the same tables and compare the rows.

    python -m checks.verify [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks.queries import ORACLES, QUERIES
from somnotab.session import local_session


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, name: str) -> str | None:
    """What differs, or None."""
    result = QUERIES[name](spark, folder)
    got_names, got = result.columns, [tuple(r) for r in result.collect()]
    if name not in ORACLES:
        return None
    cursor = connection.execute(ORACLES[name])
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} against {sorted(want_names)}"
    a, b = _rows(got_names, got), _rows(want_names, want)
    if a == b:
        return None
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"{len(a)} rows against {len(b)}; {only_a} against {only_b}"


def connect(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def main(folder: str, names: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failures = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s", problem or "", flush=True)
    print(f"{failures} failures of {len(names or QUERIES)}")
    return failures


if __name__ == "__main__":
    sys.exit(main(*(sys.argv[1:2] or ["/root/testdata/sf0.01"]), sys.argv[2:]))
