"""Run every query and its SQL twin on one data folder and report differences.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.star_oracle import ORACLE_SQL
from checks.star_queries import QUERIES

SPARK_TO_SQL = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def local_spark(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-check")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> list[str]:
    """Differences in columns, types, row count and exact values (empty when equal)."""
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    relation = con.sql(ORACLE_SQL[name])
    if names != sorted(relation.columns):
        return [f"columns {sorted(set(names) ^ set(relation.columns))}"]
    types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    problems = [
        f"type of {c}: {t} vs {types[c]}"
        for c, t in df.dtypes
        if SPARK_TO_SQL.get(t, t) != types[c]
    ]

    def ordered(rows):
        return sorted((tuple(r) for r in rows), key=repr)

    left = ordered(df.select(*names).collect())
    right = ordered(relation.select(*[f'"{c}"' for c in names]).fetchall())
    if len(left) != len(right):
        return [*problems, f"rows {len(left)} vs {len(right)}"]
    differing = [(a, b) for a, b in zip(left, right) if a != b]
    if differing:
        a, b = differing[0]
        cells = [f"{n}: {x!r} vs {y!r}" for n, x, y in zip(names, a, b) if x != y]
        problems.append(f"{len(differing)} of {len(left)} rows differ, first: {cells}")
    return problems


def main(sf_dir: str, only: list[str]) -> int:
    spark, con = local_spark(), open_tables(sf_dir)
    failed = 0
    for name in only or QUERIES:
        start = time.time()
        if name in ORACLE_SQL:
            problems = compare(spark, con, name, sf_dir)
            status = "; ".join(problems) or "equal"
        else:
            problems = []
            status = f"{QUERIES[name](spark, sf_dir).count()} rows, no SQL"
        failed += bool(problems)
        print(f"{name:24s} {time.time() - start:6.2f}s  {status}", flush=True)
    print(f"{failed} of {len(only or QUERIES)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
