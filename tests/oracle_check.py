"""Compare catalog queries with their SQL on the sample tables.

``python tests/oracle_check.py /root/testdata/sf0.01 [names]``
"""

from __future__ import annotations

import glob
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark, connection, directory, name, query, sql) -> str | None:
    """None when rows, column names and values agree, else what differs."""
    actual = query(spark, directory)
    columns = actual.columns
    mine = sorted_rows(columns, [tuple(r) for r in actual.collect()])
    cursor = connection.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs = sorted_rows(theirs_columns, cursor.fetchall())
    if sorted(columns) != sorted(theirs_columns):
        return f"columns {sorted(columns)} != {sorted(theirs_columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a}\n   != {b}"
    return None


if __name__ == "__main__":
    from conftest import make_session

    from buzzlens.plans.catalog import QUERIES
    from buzzlens.plans.oracles import ORACLES

    folder = sys.argv[1]
    chosen = sys.argv[2].split(",") if len(sys.argv) > 2 else list(QUERIES)
    session, database = make_session(), connect(folder)
    for key in chosen:
        if key not in ORACLES:
            print(key, "no SQL")
            continue
        try:
            problem = differences(session, database, folder, key, QUERIES[key], ORACLES[key])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print(key, problem[:1500] if problem else "ok", flush=True)
