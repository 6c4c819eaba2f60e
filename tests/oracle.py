"""Compare a query's Spark result with its SQL run by DuckDB on the same tables.

As a script: ``python tests/oracle.py [folder] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(v).__name__, _plain(v)) for v in (row[i] for i in order)) for row in rows)


def compare(spark_df, connection, sql: str) -> list[str]:
    """Differences between both results; an empty list if they agree."""
    result = connection.execute(sql)
    duck_columns = [d[0] for d in result.description]
    duck = _rows(result.fetchall(), duck_columns)
    mine = _rows(spark_df.collect(), spark_df.columns)
    problems = []
    if sorted(spark_df.columns) != sorted(duck_columns):
        problems.append(f"columns {sorted(spark_df.columns)} != {sorted(duck_columns)}")
    if sum(mine.values()) != sum(duck.values()):
        problems.append(f"rows {sum(mine.values())} != {sum(duck.values())}")
    if mine != duck:
        only_mine, only_duck = mine - duck, duck - mine
        problems.append(
            f"values: {sum(only_mine.values())} only in Spark {list(only_mine)[:2]}, "
            f"{sum(only_duck.values())} only in SQL {list(only_duck)[:2]}"
        )
    return problems


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = connect(folder), contract.oracle_sql(), 0
    for name, fn in contract.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = fn(spark, folder)
            problems = compare(df, connection, oracles[name]) if name in oracles else [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001  (report every query)
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok':4} {time.time() - started:6.1f}s {kind:4} {name}", *problems, sep="\n     " if problems else " ", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
