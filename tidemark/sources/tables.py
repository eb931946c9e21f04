"""The bundle of lazy input tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    orders: DataFrame
    customers: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame | None = None
    sellers: DataFrame | None = None
    category_translation: DataFrame | None = None
