"""Run registered queries beside their SQL and report differences.

``python tests/compare.py [sf_dir] [query ...]``
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(value))
    return (3, str(value))


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Problems found, empty when both sides agree."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    actual = [tuple(r) for r in spark_df.collect()]
    problems = []
    if sorted(columns) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(columns)}"]
    names = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "SMALLINT": "smallint"}
    for name, kind in spark_df.dtypes:
        if names.get(kinds[name], kinds[name]) != kind:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    left, right = normal(actual, spark_df.columns), normal(expected, columns)
    if left != right:
        extra, lost = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        problems.append(f"rows {len(left)} vs {len(right)}; only spark {extra}; only sql {lost}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from cardwatch.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connection(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            found = differences(frame, con, sql[name]) if name in sql else [f"no sql, {frame.count()} rows"]
        except Exception as problem:  # report and go on with the next query
            found = [f"{type(problem).__name__}: {str(problem)[:700]}"]
        bad += bool(found) and name in sql
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.2f}s {' '.join(found)}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
