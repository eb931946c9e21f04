"""Write result tables, exports, metrics and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from tidemark.plans.training import TrainedModels


def write_table(df: DataFrame, path: str) -> None:
    """A result table as Parquet, replacing an earlier run."""
    df.write.mode("overwrite").parquet(path)


def write_lookup_table(df: DataFrame, path: str, key: str, row_group_bytes: int | None = None) -> None:
    """A result table that is looked up by ``key``, as Parquet, replacing an earlier run.

    Rows are sorted within their partitions, which moves none, so that row groups cover narrow
    ranges of keys; a Bloom filter in each tells the others apart. A lookup of one key then reads
    about one row group, however many files there are.
    """
    writer = df.sortWithinPartitions(key).write.mode("overwrite")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", True)
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def write_high_risk_csv(high_risk: DataFrame, path: str, single_file: bool = False) -> None:
    """The sorted list as CSV with a header; part files follow the sort order.

    ``single_file`` sends everything through one task: only for short lists.
    """
    out = high_risk.coalesce(1) if single_file else high_risk
    out.write.mode("overwrite").option("header", True).csv(path)


def write_metrics_table(tidy: DataFrame, path: str) -> None:
    """(section, metric, value) rows as JSON lines."""
    tidy.write.mode("overwrite").json(path)


def write_metrics_document(spark: SparkSession, document: dict, path: str) -> None:
    """The nested metrics payload as one indented JSON document."""
    _write_text(spark, json.dumps(document, indent=2), path)


def save_models(
    spark: SparkSession, models: TrainedModels, importance: DataFrame, path: str
) -> None:
    """Both models, the importance table and the feature lists under one folder."""
    models.operational.write().overwrite().save(f"{path}/operational")
    models.calibrated.write().overwrite().save(f"{path}/calibrated")
    importance.write.mode("overwrite").parquet(f"{path}/importance")
    lists = {
        "numerical_features": list(NUMERIC_FEATURES),
        "categorical_features": list(CATEGORICAL_FEATURES),
    }
    _write_text(spark, json.dumps(lists), f"{path}/features")


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
