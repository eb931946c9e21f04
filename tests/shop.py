"""Tiny hand-made shops."""

from datetime import datetime, timedelta

from tidemark import SnapshotConfig, Tables

CFG = SnapshotConfig()
SNAP = CFG.snapshot
TEND = CFG.target_end
MICRO = timedelta(microseconds=1)
DAY = timedelta(days=1)

ORDERS = (
    "order_id string, customer_id string, order_status string,"
    " order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz,"
    " order_estimated_delivery_date timestamp_ntz"
)
CUSTOMERS = "customer_id string, customer_unique_id string, customer_state string, customer_city string"
ITEMS = "order_id string, order_item_id int, product_id string, price double, freight_value double"
PAYMENTS = (
    "order_id string, payment_type string, payment_installments int, payment_value double"
)
REVIEWS = "order_id string, review_score int, review_creation_date timestamp_ntz"


def order(order_id, customer_id, bought, status="delivered", arrived=None, promised=None):
    return (order_id, customer_id, status, bought, arrived, promised)


def item(order_id, number=1, product="p1", price=10.0, freight=1.0):
    return (order_id, number, product, price, freight)


def shop(spark, orders=(), customers=(), items=(), payments=(), reviews=()):
    def frame(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return Tables(
        orders=frame(orders, ORDERS),
        customers=frame(customers, CUSTOMERS),
        order_items=frame(items, ITEMS),
        payments=frame(payments, PAYMENTS),
        reviews=frame(reviews, REVIEWS),
    )


def days_ago(n):
    return SNAP - n * DAY


def by_key(df, key="customer_unique_id"):
    return {r[key]: r for r in df.collect()}


__all__ = ["CFG", "SNAP", "TEND", "MICRO", "DAY", "datetime", "order", "item", "shop", "days_ago", "by_key"]
