"""Compare the named queries with their SQL on DuckDB.

    python tests/oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _value(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_value(row[i]) for i in order) for row in rows)


def compare(df, db, sql: str) -> str:
    """Empty if both have the same columns and rows, else what differs."""
    spark_names, spark_rows = _rows(df.columns, df.collect())
    cursor = db.execute(sql)
    duck_names, duck_rows = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if spark_names != duck_names:
        return f"columns {spark_names} {duck_names}"
    if spark_rows != duck_rows:
        ours, theirs = set(spark_rows) - set(duck_rows), set(duck_rows) - set(spark_rows)
        return (
            f"{len(spark_rows)} rows against {len(duck_rows)}; only Spark {len(ours)}: {sorted(ours)[:3]}; "
            f"only SQL {len(theirs)}: {sorted(theirs)[:3]}"
        )
    return ""


def main(folder: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from vacatlas.session import session

    spark = session(
        master="local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls, found = connect(folder), oracle_sql(), queries()
    unknown = set(sqls) - set(found)
    print("== without a query:", sorted(unknown))
    for name in names or found:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(found[name](spark, folder), db, sqls[name])
            else:
                problem = f"rows only: {found[name](spark, folder).count()}"
        except Exception as error:  # noqa: BLE001 - a report of all queries
            problem = f"ERROR {type(error).__name__} {str(error)[:700]}"
        print(f"== {name} {time.time() - start:.1f}s {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
