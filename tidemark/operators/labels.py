"""The eligible cohort and its future-window churn label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import SnapshotConfig
from tidemark.operators.customer_base import LABEL_COLUMNS, customer_base
from tidemark.sources.tables import Tables


def cohort_labels(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """Customers with a valid order up to the snapshot, labelled by the window after it."""
    return customer_base(tables, cfg, parts=(), with_label=True).select(
        "customer_unique_id", *LABEL_COLUMNS
    )


def label_summary(cohort: DataFrame) -> DataFrame:
    """One row: eligible, churned and active counts and rates."""
    churn = F.col("churn")
    return cohort.agg(
        F.count("*").alias("eligible_customers"),
        F.count_if(churn == 1).alias("churned_customers"),
        F.count_if(churn == 0).alias("active_customers"),
        F.avg((churn == 1).cast("int")).alias("churn_rate"),
        F.avg((churn == 0).cast("int")).alias("active_rate"),
    )
