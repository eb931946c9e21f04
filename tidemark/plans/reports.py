"""The questions the dashboard and the write-up ask, as table queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import HIGH_RISK, LOW_RISK, MEDIUM_RISK, SnapshotConfig
from tidemark.functions.columns import ntz
from tidemark.operators.customer_base import customer_base, historical_orders
from tidemark.operators.ranking import ranking_summary
from tidemark.operators.tiers import risk_tier
from tidemark.sources.tables import Tables

KEY = "customer_unique_id"
# The explorer's bounds, defaults and columns, in their published order.
SPEND_SLIDER_MAX = 2000.0
DEFAULT_SPEND = (0.0, 1000.0)
DEFAULT_TIERS = (HIGH_RISK, LOW_RISK)
EXPLORER_ROWS = 100
PICKER_ROWS = 20
EXPLORER_COLUMNS = (
    KEY,
    "business_risk_tier",
    "operational_risk_score",
    "calibrated_churn_prob",
    "risk_percentile",
    "recency_days",
    "tenure_days",
    "frequency_orders",
    "total_spend",
    "avg_review_score",
    "customer_state",
)


def kpi_overview(scored: DataFrame, test: DataFrame) -> DataFrame:
    """Cohort size and rates of the scored table, with the hold-out's AUC and lift."""
    views = ranking_summary(test, ["churn", "active"])
    figures = views.agg(
        F.expr("struct(max(if(view = 'churn', roc_auc, NULL)) AS roc_auc,"
               " max(if(view = 'active', relative_lift, NULL)) AS active_lift) AS f")
    ).scalar()
    churned = F.count_if(F.col("actual_churn") == 1)
    active = F.count_if(F.col("actual_churn") == 0)
    return scored.agg(
        F.count("*").alias("eligible_customers"),
        churned.alias("churned_customers"),
        active.alias("active_customers"),
        (churned / F.count("*")).alias("churn_rate"),
        (active / F.count("*")).alias("active_rate"),
    ).select("*", figures.getField("roc_auc").alias("roc_auc"), figures.getField("active_lift").alias("active_lift"))


def tier_profile(scored: DataFrame) -> DataFrame:
    """Per tier, Low to High: size, share, mean recency, spend and review score."""
    spark = scored.sparkSession
    figures = scored.groupBy("business_risk_tier").agg(
        F.count("*").alias("customers"),
        F.avg("recency_days").alias("avg_recency"),
        F.avg("total_spend").alias("avg_spend"),
        F.avg("avg_review_score").alias("avg_review"),
    )
    shares = figures.withColumn("_all", F.sum("customers").over(Window.partitionBy()))
    order = spark.createDataFrame(
        [(1, LOW_RISK), (2, MEDIUM_RISK), (3, HIGH_RISK)], "tier_no int, business_risk_tier string"
    )
    count = F.coalesce("customers", F.lit(0))
    # At most four tier rows on the broadcast side.
    return order.join(F.broadcast(shares), "business_risk_tier", "left").select(
        "tier_no",
        "business_risk_tier",
        count.alias("customers"),
        (F.col("customers") / F.col("_all")).alias("share"),
        "avg_recency",
        "avg_spend",
        "avg_review",
    )


def explore(
    scored: DataFrame,
    tiers: Sequence[str] = DEFAULT_TIERS,
    id_pattern: str = "",
    spend: tuple[float, float] = DEFAULT_SPEND,
) -> DataFrame:
    """Customers of the chosen tiers (none chosen: all) within a spend range.

    ``id_pattern`` is a regular expression, matched anywhere, ignoring case.
    """
    kept = scored
    if tiers:
        kept = kept.where(F.col("business_risk_tier").isin(*tiers))
    if id_pattern:
        kept = kept.where(F.col(KEY).cast("string").rlike(f"(?i){id_pattern}"))
    return kept.where(F.col("total_spend").between(*spend))


def explorer_page(matches: DataFrame, rows: int = EXPLORER_ROWS) -> DataFrame:
    return matches.select(*EXPLORER_COLUMNS).orderBy(KEY).limit(rows)


def explorer_count(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("matching_customers"))


def explorer_ids(matches: DataFrame, rows: int = PICKER_ROWS) -> DataFrame:
    return matches.select(KEY).orderBy(KEY).limit(rows)


def spend_bounds(scored: DataFrame) -> DataFrame:
    """Range of the spend slider: smallest spend, largest spend capped."""
    return scored.agg(
        F.min("total_spend").alias("min_spend"),
        F.least(F.lit(SPEND_SLIDER_MAX), F.max("total_spend")).alias("max_spend"),
    )


def customer_profile(scored: DataFrame, customer_id: str | DataFrame) -> DataFrame:
    """Tier, scores and "top x percent" of one customer (an id, or a one-row frame of it)."""
    wanted = customer_id.scalar() if isinstance(customer_id, DataFrame) else F.lit(customer_id)
    return scored.where(F.col(KEY) == wanted).select(
        KEY,
        "business_risk_tier",
        "operational_risk_score",
        "calibrated_churn_prob",
        (F.lit(100.0) - F.col("risk_percentile")).alias("top_percent"),
    )


def population_profile(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """All customers ever, those with a valid delivery, and one-time versus repeat buyers."""
    universe = tables.customers.agg(F.count_distinct(KEY)).scalar()
    # Lifetime view: the same totals with a snapshot after every order.
    lifetime = customer_base(tables, _end_of_time(cfg), parts=())
    buyers = F.count("*")
    one_time = F.count_if(F.col("frequency_orders") == 1)
    repeat = F.count_if(F.col("frequency_orders") > 1)
    return lifetime.agg(
        buyers.alias("delivered_customers"),
        one_time.alias("one_time_buyers"),
        repeat.alias("repeat_buyers"),
        F.try_divide(one_time, buyers).alias("one_time_share"),
        F.try_divide(repeat, buyers).alias("repeat_share"),
    ).withColumn("customer_universe", universe)


def late_review_audit(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """Reviews written after the snapshot for orders placed before it.

    Reviews are counted per order first; the count of a much-reviewed order is
    one row in the joins.
    """
    late = (
        tables.reviews.where(F.col("review_creation_date") > ntz(cfg.snapshot))
        .groupBy("order_id")
        .agg(F.count("*").alias("late"))
    )
    items = tables.order_items.select("order_id").distinct()
    orders = historical_orders(tables, cfg).select("order_id")
    return (
        orders.join(items, "order_id")
        .join(late, "order_id")
        .agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late_reviews"))
    )


def calibrated_tier_mix(scored: DataFrame, cfg: SnapshotConfig) -> DataFrame:
    """Tier shares if the thresholds were applied to the calibrated probability."""
    mix = (
        scored.select(risk_tier(F.col("calibrated_churn_prob"), cfg).alias("business_risk_tier"))
        .groupBy("business_risk_tier")
        .agg(F.count("*").alias("customers"))
    )
    whole = F.sum("customers").over(Window.partitionBy())  # over at most four rows
    return mix.withColumn("share", F.col("customers") / whole)


def _end_of_time(cfg: SnapshotConfig) -> SnapshotConfig:
    return replace(cfg, snapshot=datetime(9999, 12, 31, 23, 59, 59))
