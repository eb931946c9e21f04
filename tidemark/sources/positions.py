"""The place of each row in its input, for results that follow input order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITION = "row_position"


def with_position(frame: DataFrame, name: str = POSITION) -> DataFrame:
    """Add each row's place, from 0: files by path, rows as they lie in their file.

    ``frame`` must be a plain Parquet read, for the place comes from file metadata: it is the same in
    every run and after every retry. Only the offsets of the files go through one task, a
    row per file.
    """
    if name in frame.columns:
        raise ValueError(f"there is a column {name!r} already")
    placed = frame.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    rows = placed.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    ahead = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select("_file", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_file").select(
        *[F.col(f"`{c}`") for c in frame.columns], (F.col("_offset") + F.col("_row")).alias(name)
    )
