"""Data-quality checks. Each yields (check_name, violations); all must be 0."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SnapshotConfig
from tidemark.functions.columns import ntz
from tidemark.operators.features import snapshot_features
from tidemark.operators.labels import label_summary
from tidemark.operators.tiers import risk_tier
from tidemark.sources.tables import Tables

KEY = "customer_unique_id"
AGE_TOLERANCE = -1e-5


def as_of(tables: Tables, cfg: SnapshotConfig) -> Tables:
    """The tables as they stood at the snapshot: later rows and arrivals are not there yet."""
    snapshot, arrived = ntz(cfg.snapshot), F.col("order_delivered_customer_date")
    orders = tables.orders.where(F.col("order_purchase_timestamp") <= snapshot)
    return replace(
        tables,
        orders=orders.withColumn(
            "order_delivered_customer_date", F.when(arrived <= snapshot, arrived)
        ),
        reviews=tables.reviews.where(F.col("review_creation_date") <= snapshot),
    )


def leakage_audit(
    tables: Tables,
    features: DataFrame,
    cfg: SnapshotConfig,
    review_median: float | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Nothing after the snapshot reaches the features.

    The feature table (stored; any columns of ``snapshot_features``, with
    ``frequency_orders`` and ``review_count``) is held against the one that the tables as of the
    snapshot give. Pass the ``review_median`` it was made with, if any. With a shared
    ``folder`` their totals are stored there, so that the tables are read once.
    """
    expected = snapshot_features(as_of(tables, cfg), cfg, review_median, folder=folder and f"{folder}/as_of")
    shared = [c for c in expected.columns if c in features.columns and c != KEY]
    made = features.select(KEY, F.struct(*shared).alias("made"))
    both = made.join(expected.select(KEY, F.struct(*shared).alias("expected")), KEY, "full")

    def exceeds(name: str) -> Column:
        return F.col(f"made.{name}") > F.coalesce(F.col(f"expected.{name}"), F.lit(0))

    return _union(
        _count(
            features,
            {
                "negative_recency": F.col("recency_days") < 0,
                "tenure_below_recency": F.col("tenure_days") - F.col("recency_days")
                < AGE_TOLERANCE,
                "purchase_after_snapshot": F.col("last_purchase") > ntz(cfg.snapshot),
            },
        ),
        _count(
            both,
            {
                "order_after_snapshot": exceeds("frequency_orders"),
                "review_after_snapshot": exceeds("review_count"),
                "differs_from_tables_as_of_snapshot": ~F.col("made").eqNullSafe(F.col("expected")),
            },
        ),
    )


def target_audit(
    cohort: DataFrame, features: DataFrame, expected: Mapping[str, int] | None = None
) -> DataFrame:
    """The label is binary, agrees with its count, and covers each customer once.

    ``expected`` may name counts of ``label_summary`` (eligible_customers, churned_customers,
    active_customers); each adds a row with the distance from the cohort's own count.
    """
    per_customer = cohort.groupBy(KEY).agg(F.count("*").alias("_n"))
    unmatched = cohort.select(KEY, F.lit(1).alias("_c")).join(
        features.select(KEY, F.lit(1).alias("_f")), KEY, "full"
    )
    counts = [
        label_summary(cohort).select(
            F.lit(f"unexpected_{name}").alias("check_name"),
            F.abs(F.col(name) - number).alias("violations"),
        )
        for name, number in (expected or {}).items()
    ]
    return _union(
        _count(
            cohort,
            {
                "label_not_binary": ~F.col("churn").isin(0, 1) | F.col("churn").isNull(),
                "label_disagrees_with_count": (F.col("churn") == 1)
                != (F.col("target_orders_count") == 0),
            },
        ),
        _count(per_customer, {"duplicate_customer": F.col("_n") > 1}),
        _count(unmatched, {"cohort_features_mismatch": F.col("_f").isNull() | F.col("_c").isNull()}),
        *counts,
    )


def scoring_audit(scored: DataFrame, high_risk: DataFrame, cfg: SnapshotConfig) -> DataFrame:
    """Scores are probabilities, tiers follow the thresholds, the export is all High."""
    score, prob = F.col("operational_risk_score"), F.col("calibrated_churn_prob")
    expected = risk_tier(score, cfg)
    return _union(
        _count(
            scored,
            {
                "operational_out_of_range": ~F.coalesce(score.between(0, 1), F.lit(False)),
                "calibrated_out_of_range": ~F.coalesce(prob.between(0, 1), F.lit(False)),
                "tier_disagrees": ~F.col("business_risk_tier").eqNullSafe(expected),
            },
        ),
        high_risk.agg(
            F.count_if(~(score > cfg.high_threshold)).alias("export_not_above_threshold"),
            F.count_if(~F.col("business_risk_tier").eqNullSafe(F.lit("High Risk"))).alias(
                "export_not_high"
            ),
            (F.count("*") == 0).cast("long").alias("export_empty"),
        ).select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("check_name"), F.col(c).alias("violations"))
                        for c in ("export_not_above_threshold", "export_not_high", "export_empty")
                    ]
                )
            )
        ),
    )


def key_audit(tables: Tables) -> DataFrame:
    """Orders and customers must be unique by key, or sums would be counted twice."""

    def repeated(df: DataFrame, key: str) -> DataFrame:
        keys = df.groupBy(key).agg(F.count("*").alias("_n"))
        return _count(keys, {f"duplicate_{key}": F.col("_n") > 1})

    return _union(
        repeated(tables.orders.where(F.col("order_id").isNotNull()), "order_id"),
        repeated(tables.customers.where(F.col("customer_id").isNotNull()), "customer_id"),
    )


def metric_checks(document: dict) -> list[str]:
    """Names of the metric bounds a finished run breaks (empty when sound)."""
    auc = document["discrimination"]["roc_auc_operational"]
    brier = document["calibration"]["brier_score_calibrated"]
    lift = document["dual_pr_auc"]["active_class_0"]["relative_lift_over_baseline"]
    checks = {
        "auc_not_above_half": not 0.5 < auc <= 1.0,
        "brier_too_large": not brier < 0.05,
        "lift_not_above_one": not lift > 1.0,
    }
    return [name for name, broken in checks.items() if broken]


def _count(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One pass over ``df`` counting rows that break each check."""
    counted = df.agg(*[F.count_if(broken).alias(name) for name, broken in checks.items()])
    rows = [
        F.struct(F.lit(name).alias("check_name"), F.col(name).alias("violations"))
        for name in checks
    ]
    return counted.select(F.inline(F.array(*rows)))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
