"""Customer features as of the snapshot, and the single-topic views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import OTHER_STATE, SnapshotConfig
from tidemark.functions.columns import days, micros_between, money, ntz_text
from tidemark.functions.prefix import even_splits, exact_median
from tidemark.operators.customer_base import (
    ITEMS,
    LABEL_COLUMNS,
    PAYMENTS,
    REVIEWS,
    customer_base,
    distinct_products,
)
from tidemark.plans.work import stored
from tidemark.sources.tables import Tables

# The model inputs, in their published order.
NUMERIC_FEATURES = (
    "recency_days",
    "tenure_days",
    "frequency_orders",
    "frequency_items",
    "is_repeat_buyer_hist",
    "total_spend",
    "total_freight",
    "avg_order_value",
    "avg_item_price",
    "freight_ratio",
    "avg_review_score",
    "has_low_review",
    "has_review_at_snapshot",
    "avg_delivery_delay_days",
    "late_delivery_rate",
    "pending_delivery_at_snapshot",
    "has_delivery_history",
    "avg_payment_installments",
    "credit_card_share",
    "boleto_share",
    "distinct_categories",
)
CATEGORICAL_FEATURES = ("customer_state",)
KEY = "customer_unique_id"
SHARE_EPSILON = "1e-6D"

# Feature formulas over the totals of ``customer_base``.
REVIEW_RANGE = (1.0, 5.0)
REVIEW_AVERAGE = "try_divide(double(review_sum), review_count)"
INSTALLMENTS = "try_divide(double(installments_sum), installments_count)"
SPEND, FREIGHT = money("spend"), money("freight")
ITEM_COLUMNS = (
    "frequency_items",
    f"{SPEND} AS total_spend",
    f"{FREIGHT} AS total_freight",
    "coalesce(distinct_categories, 0L) AS distinct_categories",
)
# Customers without a countable item have no item price: null, not infinity.
RATIO_COLUMNS = (
    f"try_divide({SPEND}, frequency_orders) AS avg_order_value",
    f"try_divide({SPEND}, frequency_items) AS avg_item_price",
    f"{FREIGHT} / ({SPEND} + {FREIGHT} + {SHARE_EPSILON}) AS freight_ratio",
)
LOGISTICS_COLUMNS = (
    f"coalesce({days('try_divide(delay_micros, delay_count)')}, 0D) AS avg_delivery_delay_days",
    "coalesce(try_divide(double(late_count), delivered_count), 0D) AS late_delivery_rate",
    "delivered_count",
    "int(pending_count > 0) AS pending_delivery_at_snapshot",
    "int(delivered_count > 0) AS has_delivery_history",
)
SHARE_COLUMNS = tuple(
    f"{money(stem)} / ({money('paid')} + {SHARE_EPSILON}) AS {name}"
    for stem, name in (("card", "credit_card_share"), ("boleto", "boleto_share"))
)


def snapshot_features(
    tables: Tables,
    cfg: SnapshotConfig,
    review_median: float | None = None,
    with_label: bool = False,
    folder: str | None = None,
) -> DataFrame:
    """The full feature table, one row per eligible customer.

    ``review_median`` fills missing review averages; by default the exact median
    of all customers' averages is computed in the same query, by a second pass over the
    tables. With a shared ``folder`` the totals are stored there once, and both read them.
    """
    base = feature_base(tables, cfg, with_label)
    if folder is not None and review_median is None:
        return finish_features(stored(base, folder, "feature_base"), cfg)
    return finish_features(base, cfg, review_median, _review_base(tables, cfg))


def feature_base(tables: Tables, cfg: SnapshotConfig, with_label: bool = False) -> DataFrame:
    """Raw totals of every part, with the distinct product count joined on."""
    base = customer_base(tables, cfg, with_label=with_label, with_place=True)
    return base.join(distinct_products(tables, cfg), KEY, "left")


def finish_features(
    base: DataFrame,
    cfg: SnapshotConfig,
    review_median: float | None = None,
    review_base: DataFrame | None = None,
) -> DataFrame:
    """Turn raw totals into features. A projection: no shuffle of its own.

    The median fill comes from ``review_median`` or else from ``review_base``
    (default: ``base``, the right choice when it is already a stored table).
    """
    if review_median is None:
        averages = (review_base or base).selectExpr(f"{REVIEW_AVERAGE} AS average")
        median = exact_median(averages, "average", even_splits(*REVIEW_RANGE)).scalar()
        fill = F.coalesce(median, F.lit(cfg.review_fallback))
    else:
        fill = F.lit(float(review_median))
    label = [c for c in LABEL_COLUMNS if c in base.columns]
    states = ", ".join(f"'{s}'" for s in cfg.top_states)
    return base.selectExpr(
        KEY,
        *label,
        "first_purchase",
        "last_purchase",
        "frequency_orders",
        f"if(customer_state IN ({states}), customer_state, '{OTHER_STATE}') AS customer_state",
        "customer_city",
        *_age_columns(cfg),
        *ITEM_COLUMNS,
        *RATIO_COLUMNS,
        f"{REVIEW_AVERAGE} AS avg_review_score",
        "coalesce(has_low_review, 0) AS has_low_review",
        "coalesce(review_count, 0L) AS review_count",
        "int(review_rows IS NOT NULL) AS has_review_at_snapshot",
        *LOGISTICS_COLUMNS,
        f"coalesce({INSTALLMENTS}, 1D) AS avg_payment_installments",
        *SHARE_COLUMNS,
    ).withColumn("avg_review_score", F.coalesce("avg_review_score", fill))


def rfm_features(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """First and last purchase, order count, home place, recency and tenure."""
    return customer_base(tables, cfg, parts=(), with_place=True).selectExpr(
        KEY,
        "first_purchase",
        "last_purchase",
        "frequency_orders",
        "customer_state",
        "customer_city",
        *_age_columns(cfg),
    )


def item_features(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """Item count, spend, freight and distinct products."""
    base = customer_base(tables, cfg, parts=(ITEMS,))
    return base.join(distinct_products(tables, cfg), KEY, "left").selectExpr(KEY, *ITEM_COLUMNS)


def review_features(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """Customers with a review row by the snapshot: mean score, low flag, count."""
    return (
        _review_base(tables, cfg)
        .where("review_rows > 0")
        .selectExpr(KEY, f"{REVIEW_AVERAGE} AS avg_review_score", "has_low_review", "review_count")
    )


def logistics_features(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """Delay, lateness and open deliveries, with the neutral fills applied."""
    return customer_base(tables, cfg, parts=()).selectExpr(KEY, *LOGISTICS_COLUMNS)


def payment_features(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """Customers with a payment row: mean installments, totals and type shares."""
    base = customer_base(tables, cfg, parts=(PAYMENTS,)).where("payment_rows > 0")
    return base.selectExpr(
        KEY,
        f"{INSTALLMENTS} AS avg_payment_installments",
        f"{money('paid')} AS total_payment_val",
        f"{money('card')} AS cc_payment_val",
        f"{money('boleto')} AS boleto_payment_val",
        *SHARE_COLUMNS,
    )


def _review_base(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    return customer_base(tables, cfg, parts=(REVIEWS,))


def _age_columns(cfg: SnapshotConfig) -> list[str]:
    def age(since: str) -> str:
        return days(micros_between(since, ntz_text(cfg.snapshot)))

    return [
        f"{age('last_purchase')} AS recency_days",
        f"{age('first_purchase')} AS tenure_days",
        "int(frequency_orders > 1) AS is_repeat_buyer_hist",
    ]
