"""Present the driver's star schema (orders, lineitem, ...) as the input tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.config import SnapshotConfig
from tidemark.sources.tables import Tables

STAR_CONFIG = SnapshotConfig(
    snapshot=datetime(1999, 12, 31, 23, 59, 59),
    top_states=("NATION_2", "NATION_3", "NATION_7", "NATION_11", "NATION_19"),
)
PROMISED_DAYS = 90
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def star_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Map orders, customer, nation and lineitem onto the five input tables."""

    def read(name: str) -> DataFrame:
        return _read(spark, f"{sf_dir}/{name}.parquet")

    lineitem = read("lineitem")
    return Tables(
        orders=_orders(read("orders"), lineitem),
        customers=_customers(read("customer"), read("nation")),
        order_items=lineitem.selectExpr(
            "l_orderkey AS order_id",
            "l_linenumber AS order_item_id",
            "l_partkey AS product_id",
            "l_extendedprice AS price",
            "l_extendedprice * l_tax AS freight_value",
            "l_shipdate AS shipping_limit_date",
        ),
        payments=lineitem.selectExpr(
            "l_orderkey AS order_id",
            "CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'R' THEN 'boleto'"
            " WHEN 'N' THEN 'voucher' END AS payment_type",
            "l_linenumber AS payment_installments",
            "l_extendedprice AS payment_value",
        ),
        reviews=lineitem.where("l_linenumber = 1").selectExpr(
            "l_orderkey AS order_id",
            "int(floor((l_quantity - 1) / 10) + 1) AS review_score",
            "l_shipdate AS review_creation_date",
        ),
    )


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Read a table; its schema is taken from the file footers once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    delivered = lineitem.groupBy("l_orderkey").agg(F.expr("max(l_shipdate) AS delivered"))
    return orders.join(delivered, orders.o_orderkey == delivered.l_orderkey, "left").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'"
        " WHEN 'P' THEN 'processing' END AS order_status",
        "o_orderdate AS order_purchase_timestamp",
        "delivered AS order_delivered_customer_date",
        f"o_orderdate + INTERVAL {PROMISED_DAYS} DAY AS order_estimated_delivery_date",
    )


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").selectExpr(
        "c_custkey AS customer_id",
        "c_name AS customer_unique_id",
        "n_name AS customer_state",
        "c_mktsegment AS customer_city",
    )
