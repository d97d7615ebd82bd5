"""Compare registered queries with their oracle SQL: rows, column names and values, whatever the order."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

SAME_TYPE = {
    "string": ("VARCHAR",), "double": ("DOUBLE",), "bigint": ("BIGINT",), "int": ("INTEGER",), "date": ("DATE",), "boolean": ("BOOLEAN",), "timestamp_ntz": ("TIMESTAMP",),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def differences(spark_df, connection, sql: str) -> str:
    """Empty text when equal, else a short description."""
    result = connection.execute(sql)
    names, expected = rows_of([d[0] for d in result.description], result.fetchall())
    columns, actual = rows_of(spark_df.columns, spark_df.collect())
    if columns != names:
        return f"columns {columns} != {names}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    return f"{len(wrong)} of {len(actual)} rows differ: {wrong[:2]}" if wrong else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tapeloom.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    sqls = entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in sqls:
                message = differences(df, connection, sqls[name])
                types = dict((d[0], str(d[1])) for d in connection.execute(sqls[name]).description)
            else:
                message, types = f"no oracle, {df.count()} rows", {}
        except Exception as error:  # report and go on with the next query
            message, types = f"{type(error).__name__}: {str(error)[:600]}", {}
        if message and not message.startswith("no oracle"):
            bad += 1
        mistyped = [] if message else [(n, d, types[n]) for n, d in df.dtypes if types.get(n) not in SAME_TYPE.get(d, ())]
        print(f"## {'ok  ' if not message else 'note' if message.startswith('no oracle') else 'FAIL'} {name} {time.time() - start:.1f}s {message} {mistyped or ''}", flush=True)
    print(f"## {bad} failed", flush=True)
