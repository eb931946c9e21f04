"""Additive per-customer totals as of the snapshot, in one pass over orders.

Shape of the plan, chosen so that no single key can overload a task:

1. items, reviews and payments are folded to one row per order (map-side
   combine absorbs an order with very many lines);
2. those rows join the orders on ``order_id``;
3. order rows fold to one row per (order, account), which moves nothing, as they already lie
   by order: an order that is listed more than once counts as one order, while its amounts
   count once per row, as a join gives them;
4. these fold to one row per ``customer_id`` before customers are joined,
   so an account with very many orders is a single row in that join;
5. the result folds to one row per ``customer_unique_id``.

Every measure is a min, max or sum, so each step is a partial aggregation. Customer
keys must be unique; ``audits.key_audit`` checks that. One order id under two accounts
of one person counts for each account.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SnapshotConfig
from tidemark.functions.columns import micros_between, money_rest, money_units, ntz_text
from tidemark.operators.orders import DELIVERED
from tidemark.sources.tables import Tables

ITEMS, REVIEWS, PAYMENTS = "items", "reviews", "payments"
ALL_PARTS = (ITEMS, REVIEWS, PAYMENTS)
LABEL_COLUMNS = ("target_orders_count", "churn")

# How each pre-folded total of a part folds further up.
PART_FOLDS = {
    ITEMS: {
        "frequency_items": "sum",
        "spend_units": "sum",
        "spend_rest": "sum",
        "freight_units": "sum",
        "freight_rest": "sum",
    },
    REVIEWS: {
        "review_rows": "sum",
        "review_count": "sum",
        "review_sum": "sum",
        "has_low_review": "max",
    },
    PAYMENTS: {
        "payment_rows": "sum",
        "installments_sum": "sum",
        "installments_count": "sum",
        "paid_units": "sum",
        "paid_rest": "sum",
        "card_units": "sum",
        "card_rest": "sum",
        "boleto_units": "sum",
        "boleto_rest": "sum",
    },
}


@dataclass(frozen=True)
class Measure:
    """One running total: its name, how it folds, and its value on an order row.

    ``within`` is how it folds over the rows of one order, if otherwise.
    """

    name: str
    fold: str
    value: str
    within: str | None = None


def customer_base(
    tables: Tables,
    cfg: SnapshotConfig,
    parts: Collection[str] = ALL_PARTS,
    with_label: bool = False,
    with_place: bool = False,
) -> DataFrame:
    """One row per eligible customer with the raw totals features are made of.

    ``with_label`` widens the scan to the end of the label window and adds the
    label; every other total still counts only orders up to the snapshot.
    """
    until = cfg.target_end if with_label else cfg.snapshot
    facts = _order_facts(tables, cfg, until, parts)
    measures = _measures(cfg, parts, with_label)
    if with_place and cfg.order_position:
        past = f"order_purchase_timestamp <= {ntz_text(cfg.snapshot)}"
        measures.append(Measure("first_place", "min", f"if({past}, `{cfg.order_position}`, NULL)"))
    by_order = facts.groupBy("order_id", "customer_id").agg(
        *[F.expr(f"{m.within or m.fold}({m.value}) AS {m.name}") for m in measures]
    )
    by_account = by_order.groupBy("customer_id").agg(
        *[F.expr(f"{m.fold}({m.name}) AS {m.name}") for m in measures]
    )
    first = "first_place" if cfg.order_position else "first_purchase"
    place = [_first_known(c, first) for c in ("customer_state", "customer_city")] if with_place else []
    base = (
        by_account.join(_owners(tables, with_place), "customer_id")
        .groupBy("customer_unique_id")
        .agg(*[F.expr(f"{m.fold}({m.name}) AS {m.name}") for m in measures], *place)
        .where("frequency_orders > 0")
    )
    return base.selectExpr("*", "int(target_orders_count = 0) AS churn") if with_label else base


def historical_orders(
    tables: Tables, cfg: SnapshotConfig, until: datetime | None = None
) -> DataFrame:
    """Delivered orders with an account, placed up to ``until`` (default: the snapshot).

    Item existence is not checked here; callers join items.
    """
    return tables.orders.where(
        f"order_status = '{DELIVERED}' AND customer_id IS NOT NULL"
        f" AND order_purchase_timestamp <= {ntz_text(until or cfg.snapshot)}"
    )


def distinct_products(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """Distinct products per customer over historical orders.

    A distinct count is not additive, so items get their own narrow path: look up
    the owner, then count distinct, which Spark does by (customer, product) first
    and so spreads a customer with very many items. In both lookups one side has
    one row per key; a hot order or account on the other side is split across
    tasks by the adaptive skew join.
    """
    owners = (
        historical_orders(tables, cfg)
        .select("order_id", "customer_id")
        .join(_owners(tables, with_place=False), "customer_id")
        .select("order_id", "customer_unique_id")
    )
    return (
        tables.order_items.where("product_id IS NOT NULL")
        .select("order_id", "product_id")
        .join(owners, "order_id")
        .groupBy("customer_unique_id")
        .agg(F.count_distinct("product_id").alias("distinct_categories"))
    )


def reviews_by_order(tables: Tables, cfg: SnapshotConfig) -> DataFrame:
    """Reviews written up to the snapshot, folded to one row per order."""
    return (
        tables.reviews.where(f"review_creation_date <= {ntz_text(cfg.snapshot)}")
        .groupBy("order_id")
        .agg(
            F.expr("count(*) AS review_rows"),
            F.expr("count(review_score) AS review_count"),
            F.expr("sum(review_score) AS review_sum"),
            F.expr("max(int(coalesce(review_score <= 2, false))) AS has_low_review"),
        )
    )


def _order_facts(
    tables: Tables, cfg: SnapshotConfig, until: datetime, parts: Collection[str]
) -> DataFrame:
    orders = historical_orders(tables, cfg, until).select(
        "order_id",
        "customer_id",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        *([F.col(f"`{cfg.order_position}`")] if cfg.order_position else []),
    )
    facts = orders.join(_items_by_order(tables, ITEMS in parts), "order_id")
    if REVIEWS in parts:
        facts = facts.join(reviews_by_order(tables, cfg), "order_id", "left")
    if PAYMENTS in parts:
        facts = facts.join(_payments_by_order(tables), "order_id", "left")
    return facts


def _items_by_order(tables: Tables, with_totals: bool) -> DataFrame:
    if not with_totals:
        return tables.order_items.select("order_id").distinct()
    return tables.order_items.groupBy("order_id").agg(
        F.expr("count(order_item_id) AS frequency_items"),
        *_amount_sums("spend", "price"),
        *_amount_sums("freight", "freight_value"),
    )


def _payments_by_order(tables: Tables) -> DataFrame:
    return tables.payments.groupBy("order_id").agg(
        F.expr("count(*) AS payment_rows"),
        F.expr("sum(payment_installments) AS installments_sum"),
        F.expr("count(payment_installments) AS installments_count"),
        *_amount_sums("paid", "payment_value"),
        *_amount_sums("card", "payment_value", "payment_type = 'credit_card'"),
        *_amount_sums("boleto", "payment_value", "payment_type = 'boleto'"),
    )


def _amount_sums(stem: str, amount: str, when: str = "true") -> list[Column]:
    """The two sums that ``money(stem)`` puts together, over the rows that ``when`` holds for."""
    parts = {f"{stem}_units": money_units(amount), f"{stem}_rest": money_rest(amount)}
    return [F.expr(f"sum(if({when}, {part}, 0D)) AS {name}") for name, part in parts.items()]


def _owners(tables: Tables, with_place: bool) -> DataFrame:
    place = ["customer_state", "customer_city"] if with_place else []
    return tables.customers.where("customer_unique_id IS NOT NULL").select(
        "customer_id", "customer_unique_id", *place
    )


def _first_known(column: str, first: str) -> Column:
    """The value at the customer's account of the least ``first`` that has one."""
    known = f"{column} IS NOT NULL AND {first} IS NOT NULL"
    order = f"if({known}, struct({first}, customer_id), NULL)"
    return F.expr(f"min_by({column}, {order}) AS {column}")


def _measures(cfg: SnapshotConfig, parts: Collection[str], with_label: bool) -> list[Measure]:
    snapshot = ntz_text(cfg.snapshot)
    placed, arrived = "order_purchase_timestamp", "order_delivered_customer_date"
    by_snapshot = f"coalesce({arrived} <= {snapshot}, false)"
    delay = micros_between("order_estimated_delivery_date", arrived)

    def past(value: str) -> str:
        """Only historical orders contribute; without a label all of them are."""
        return f"if({placed} <= {snapshot}, {value}, NULL)" if with_label else value

    def tally(name: str, predicate: str, within: str | None = None) -> Measure:
        return Measure(name, "sum", f"bigint(coalesce({past(predicate)}, false))", within)

    measures = [
        Measure("first_purchase", "min", past(placed)),
        Measure("last_purchase", "max", past(placed)),
        tally("frequency_orders", "true", within="max"),
        tally("delivered_count", by_snapshot),
        tally("late_count", f"{by_snapshot} AND {delay} > 0"),
        tally("delay_count", f"{by_snapshot} AND {delay} IS NOT NULL"),
        # Whole microseconds as doubles: exact for any realistic customer, no overflow.
        Measure("delay_micros", "sum", past(f"double(if({by_snapshot}, {delay}, NULL))")),
        tally("pending_count", f"NOT {by_snapshot}"),
    ]
    if with_label:
        measures.append(
            Measure("target_orders_count", "sum", f"bigint({placed} > {snapshot})", "max")
        )
    for part in parts:
        measures += [Measure(name, fold, past(name)) for name, fold in PART_FOLDS[part].items()]
    return measures
