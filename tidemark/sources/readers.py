"""Read the input tables and saved results. Nothing here scans data eagerly."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schemas import MULTILINE_TABLES, OPTIONAL_TABLES, TABLE_COLUMNS
from tidemark.sources.tables import Tables


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return bool(hadoop_path.getFileSystem(conf).exists(hadoop_path))


def read_table(spark: SparkSession, table: str, path: str, fmt: str = "csv") -> DataFrame:
    """Read one named table with its declared column types.

    CSV columns are matched by header name in any order; columns that are not
    declared stay text. A value that does not parse fails the job instead of
    turning into a null.
    """
    columns = TABLE_COLUMNS[table]
    if fmt == "csv":
        frame = _read_csv(spark, table, path, columns)
    else:
        frame = spark.read.format(fmt).load(path)
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"table {table!r} at {path} lacks columns {missing}")
    if fmt == "csv":
        return frame
    # Keys keep the type they were stored with; dates must not carry a zone.
    return frame.select(
        *[
            F.col(c).cast("timestamp_ntz").alias(c) if columns.get(c) == "timestamp_ntz" else F.col(c)
            for c in frame.columns
        ]
    )


def read_optional(spark: SparkSession, table: str, path: str, fmt: str = "csv") -> DataFrame | None:
    """Read a table, or None where the path does not exist."""
    return read_table(spark, table, path, fmt) if path_exists(spark, path) else None


def load_tables(
    spark: SparkSession, root: str, fmt: str = "csv", files: Mapping[str, str] | None = None
) -> Tables:
    """All input tables under ``root``; ``files`` overrides single file names.

    Tables are named ``<table>.<fmt>`` unless overridden.
    """
    names = {t: f"{t}.{fmt}" for t in TABLE_COLUMNS} | dict(files or {})
    frames = {}
    for table, name in names.items():
        reader = read_optional if table in OPTIONAL_TABLES else read_table
        frames[table] = reader(spark, table, f"{root}/{name}", fmt)
    return Tables(**frames)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_high_risk_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read an exported list back with the types of the scored table."""
    return spark.read.schema(like.schema).option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> dict:
    """The nested metrics document written by ``write_metrics_document``."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_models(spark: SparkSession, path: str) -> dict:
    """Both fitted models, the importance table and the feature lists."""
    lists = json.loads(spark.read.text(f"{path}/features", wholetext=True).first()[0])
    return {
        "operational": PipelineModel.load(f"{path}/operational"),
        "calibrated": PipelineModel.load(f"{path}/calibrated"),
        "importance": spark.read.parquet(f"{path}/importance"),
        **lists,
    }


def load_results(spark: SparkSession, out_dir: str) -> tuple[dict, DataFrame, DataFrame]:
    """Metrics, scored customers and feature importance of a finished ``run``."""
    return (
        read_metrics(spark, f"{out_dir}/metrics"),
        read_scored(spark, f"{out_dir}/scored_customers"),
        spark.read.parquet(f"{out_dir}/models/importance"),
    )


def read_permissive(spark: SparkSession, table: str, path: str, rejected: str) -> DataFrame:
    """A CSV table with the text of each record that does not parse in ``rejected``, null elsewhere.

    Read all columns together, as by writing them: a record only counts as unsound by the columns read.
    """
    columns = TABLE_COLUMNS[table]
    frame = _read_csv(spark, table, path, columns, rejected)
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"table {table!r} at {path} lacks columns {missing}")
    return frame


def _read_csv(
    spark: SparkSession, table: str, path: str, columns: Mapping[str, str], rejected: str | None = None
) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", table in MULTILINE_TABLES)
    )
    header = reader.csv(path).columns
    schema = ", ".join(f"`{c}` {columns.get(c, 'string')}" for c in header)
    reader = reader.option("enforceSchema", False)
    if rejected is None:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    if rejected in header:
        raise ValueError(f"table {table!r} at {path} has a column {rejected!r} of its own")
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", rejected)
    return reader.schema(f"{schema}, `{rejected}` string").csv(path)
