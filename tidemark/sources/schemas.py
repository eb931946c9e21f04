"""Columns the analytics read, by table. Other columns pass through as text."""

from __future__ import annotations

ORDERS = {
    "order_id": "string",
    "customer_id": "string",
    "order_status": "string",
    "order_purchase_timestamp": "timestamp_ntz",
    "order_approved_at": "timestamp_ntz",
    "order_delivered_carrier_date": "timestamp_ntz",
    "order_delivered_customer_date": "timestamp_ntz",
    "order_estimated_delivery_date": "timestamp_ntz",
}
CUSTOMERS = {
    "customer_id": "string",
    "customer_unique_id": "string",
    "customer_state": "string",
    "customer_city": "string",
}
ORDER_ITEMS = {
    "order_id": "string",
    "order_item_id": "int",
    "product_id": "string",
    "price": "double",
    "freight_value": "double",
    "shipping_limit_date": "timestamp_ntz",
}
PAYMENTS = {
    "order_id": "string",
    "payment_type": "string",
    "payment_installments": "int",
    "payment_value": "double",
}
REVIEWS = {
    "order_id": "string",
    "review_score": "int",
    "review_creation_date": "timestamp_ntz",
    "review_answer_timestamp": "timestamp_ntz",
}

# Products, sellers and the category translation are loaded but never read by
# name, so they declare no columns.
TABLE_COLUMNS = {
    "orders": ORDERS,
    "customers": CUSTOMERS,
    "order_items": ORDER_ITEMS,
    "payments": PAYMENTS,
    "reviews": REVIEWS,
    "products": {},
    "sellers": {},
    "category_translation": {},
}
OPTIONAL_TABLES = ("category_translation",)
# Free text in these tables may hold quoted line breaks.
MULTILINE_TABLES = ("reviews",)
