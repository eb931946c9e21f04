"""Take the sound records of CSV tables and keep account of the others.

``load_tables`` fails at the first record that does not parse. Here every table is parsed once,
all its columns together, and stored as Parquet in a shared folder; what does not parse (a
wrong number of fields, a value that is not of its type) is kept there as its own text, with
its file. Later reads are columnar and split, also those of tables whose CSV is one task per file.

A quote that is never closed makes one record of the rest of its file: such a record counts
once, so ``require_sound`` looks at shares of rows and cannot see how long a record is;
``rejected`` shows its text.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.work import stored
from tidemark.sources.readers import path_exists, read_permissive
from tidemark.sources.schemas import OPTIONAL_TABLES, TABLE_COLUMNS
from tidemark.sources.tables import Tables

RECORD, FILE = "_rejected_record", "_source_file"


@dataclass(frozen=True)
class Intake:
    """Tables of sound records; ``rejected`` (table_name, file, record); ``counts`` by table and file."""

    tables: Tables
    rejected: DataFrame
    counts: DataFrame


def load_sound(
    spark: SparkSession, root: str, folder: str, files: Mapping[str, str] | None = None
) -> Intake:
    """Read all CSV tables under ``root`` by way of ``folder``; names as in ``load_tables``.

    ``counts`` has a row per table and file that holds a record: rows_read, rows_kept, rows_rejected.
    """
    names = {t: f"{t}.csv" for t in TABLE_COLUMNS} | dict(files or {})
    frames, rejected, counts = {}, [], []
    for table, name in names.items():
        path = f"{root}/{name}"
        if table in OPTIONAL_TABLES and not path_exists(spark, path):
            continue
        parsed = read_permissive(spark, table, path, RECORD)
        all_rows = stored(parsed.select("*", F.col("_metadata.file_path").alias(FILE)), folder, table)
        frames[table] = all_rows.where(F.col(RECORD).isNull()).drop(RECORD, FILE)
        origin = [F.lit(table).alias("table_name"), F.col(FILE).alias("file")]
        rejected.append(
            all_rows.where(F.col(RECORD).isNotNull()).select(*origin, F.col(RECORD).alias("record"))
        )
        counts.append(
            all_rows.groupBy(*origin).agg(
                F.count("*").alias("rows_read"),
                F.count_if(F.col(RECORD).isNull()).alias("rows_kept"),
                F.count(RECORD).alias("rows_rejected"),
            )
        )
    return Intake(
        Tables(**frames), reduce(DataFrame.unionByName, rejected), reduce(DataFrame.unionByName, counts)
    )


def by_table(counts: DataFrame) -> DataFrame:
    """The counts of ``Intake`` by table; a table without any record has no row."""
    sums = [F.sum(c).alias(c) for c in ("rows_read", "rows_kept", "rows_rejected")]
    return counts.groupBy("table_name").agg(*sums)


def require_sound(counts: DataFrame, most: float) -> None:
    """Stop where more than the share ``most`` of a table's records was rejected."""
    broken = by_table(counts).where(F.col("rows_rejected") > F.col("rows_read") * most).collect()
    if broken:
        told = sorted(f"{r.table_name}: {r.rows_rejected} of {r.rows_read}" for r in broken)
        raise ValueError(f"too many rejected records: {', '.join(told)}")
