"""Business risk tiers, percentiles, the scored customer table and its exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import HIGH_RISK, LOW_RISK, MEDIUM_RISK, SnapshotConfig
from tidemark.functions.columns import round_half_even
from tidemark.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES

SCORE_DIGITS = 4
KEY = "customer_unique_id"
PRIMARY_COLUMNS = (
    KEY,
    "business_risk_tier",
    "operational_risk_score",
    "calibrated_churn_prob",
    "risk_percentile",
)
FEATURE_COLUMNS = (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, "first_purchase", "last_purchase")
TIERS = (HIGH_RISK, MEDIUM_RISK, LOW_RISK)


def risk_tier(score: Column, cfg: SnapshotConfig) -> Column:
    """Tier of an already rounded score; a missing or NaN score has none."""
    known = score.isNotNull() & ~F.isnan(score)
    return (
        F.when(known & (score > cfg.high_threshold), HIGH_RISK)
        .when(known & (score >= cfg.low_threshold), MEDIUM_RISK)
        .when(known, LOW_RISK)
    )


def risk_tiers(df: DataFrame, cfg: SnapshotConfig) -> DataFrame:
    """Round both scores to four digits, then assign the tier on the rounded one."""
    return df.withColumns(
        {
            "operational_risk_score": round_half_even(F.col("operational_score"), SCORE_DIGITS),
            "calibrated_churn_prob": round_half_even(F.col("calibrated_prob"), SCORE_DIGITS),
        }
    ).withColumn("business_risk_tier", risk_tier(F.col("operational_risk_score"), cfg))


def risk_percentile(tiered: DataFrame) -> DataFrame:
    """Add risk_percentile: the average rank of the rounded score, as a percentage.

    A rounded probability takes at most 10,001 values, so the ranks come from a
    table of that size and are joined back by broadcast: no global sort. A score that is null,
    NaN or outside 0 to 1 has no percentile and does not count, so the table keeps its bound.
    """
    ticks = F.rint(F.col("operational_risk_score") * float(10**SCORE_DIGITS)).cast("int")
    ticked = tiered.withColumn(
        "_tick", F.when(F.col("operational_risk_score").between(0.0, 1.0), ticks)
    )
    counts = ticked.where(F.col("_tick").isNotNull()).groupBy("_tick").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_tick").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum("_n").over(upto) - F.col("_n") + (F.col("_n") + 1) / 2.0
    ranks = counts.select(
        "_tick",
        round_half_even(rank / F.sum("_n").over(Window.partitionBy()) * 100.0, 1).alias(
            "risk_percentile"
        ),
    )
    return ticked.join(F.broadcast(ranks), "_tick", "left").drop("_tick")


def scored_customers(df: DataFrame, cfg: SnapshotConfig, with_actual: bool = True) -> DataFrame:
    """The published table: tier, scores, percentile, optional label, then features."""
    ranked = risk_percentile(risk_tiers(df, cfg))
    actual = [F.col("churn").alias("actual_churn")] if with_actual else []
    rest = [c for c in FEATURE_COLUMNS if c in df.columns]
    return ranked.select(*PRIMARY_COLUMNS, *actual, *rest)


def high_risk_customers(scored: DataFrame, cfg: SnapshotConfig, threshold: float | None = None) -> DataFrame:
    """Customers above the threshold, highest score first, then by id."""
    limit = cfg.high_threshold if threshold is None else threshold
    score = F.col("operational_risk_score")
    return scored.where((score > limit) & ~F.isnan(score)).orderBy(score.desc(), F.col(KEY))


def tier_summary(scored: DataFrame) -> DataFrame:
    """One row per tier, High to Low; an absent tier keeps its row with null figures."""
    spark = scored.sparkSession
    figures = scored.groupBy("business_risk_tier").agg(
        F.count(KEY).alias("customer_count"),
        F.avg("operational_risk_score").alias("avg_risk_score"),
        F.avg("calibrated_churn_prob").alias("avg_calibrated_prob"),
        F.avg("total_spend").alias("avg_spend"),
        F.avg("recency_days").alias("avg_recency"),
    )
    # Over at most four rows; rows without a tier count in the total.
    shares = figures.withColumn("_all", F.sum("customer_count").over(Window.partitionBy()))
    order = spark.createDataFrame(
        [(i + 1, t) for i, t in enumerate(TIERS)], "tier_no int, business_risk_tier string"
    )
    return (
        order.join(F.broadcast(shares), "business_risk_tier", "left")
        .select(
            "tier_no",
            "business_risk_tier",
            "customer_count",
            "avg_risk_score",
            "avg_calibrated_prob",
            "avg_spend",
            "avg_recency",
            (F.col("customer_count") / F.col("_all") * 100.0).alias("percentage"),
        )
        .orderBy("tier_no")
    )
