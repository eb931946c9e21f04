"""Order-level preparation: ownership, item existence, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import is_true
from tidemark.sources.tables import Tables

DELIVERED = "delivered"
OWNER_COLUMNS = ("customer_id", "customer_unique_id", "customer_state", "customer_city")


def validated_orders(tables: Tables) -> DataFrame:
    """Every order with its owner and the flags has_items, is_valid_delivered.

    Orders of unknown customers stay, with a null owner. Item order ids are
    reduced to one row per order before the join, so an order with very many
    lines costs no more than any other.
    """
    with_items = (
        tables.order_items.select("order_id").distinct().withColumn("_has_items", F.lit(True))
    )
    return (
        tables.orders.join(tables.customers.select(*OWNER_COLUMNS), "customer_id", "left")
        .join(with_items, "order_id", "left")
        .withColumn("has_items", is_true(F.col("_has_items")))
        .withColumn(
            "is_valid_delivered", is_true(F.col("order_status") == DELIVERED) & F.col("has_items")
        )
        .select(
            *tables.orders.columns,
            *OWNER_COLUMNS[1:],
            "has_items",
            "is_valid_delivered",
        )
    )
