"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F
from shop import CFG, days_ago, item, order, shop

from tidemark.functions.prefix import ordered_prefix
from tidemark.operators.customer_base import distinct_products
from tidemark.operators.features import snapshot_features
from tidemark.operators.labels import cohort_labels
from tidemark.operators.orders import validated_orders
from tidemark.operators.tiers import risk_percentile, risk_tiers
from tidemark.sources.star_schema import STAR_CONFIG, star_tables

SF = "/root/testdata/sf0.001"
LARGE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    df.collect()
    return plan_of(df)


@pytest.mark.parametrize("build", [snapshot_features, cohort_labels])
def test_filters_and_columns_reach_the_scan(spark, conf, build):
    conf(LARGE)
    plan = plan_of(build(star_tables(spark, SF), STAR_CONFIG))
    assert "LessThanOrEqual(o_orderdate," in plan
    assert "o_totalprice" not in plan and "l_suppkey" not in plan and "c_acctbal" not in plan
    for word in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_no_customer_sized_input_goes_to_one_task(spark, conf):
    conf(LARGE)
    assert "SinglePartition" not in plan_of(cohort_labels(star_tables(spark, SF), STAR_CONFIG))
    groups = spark.range(1000).selectExpr("id / 1000D AS v", "1L AS n")
    plan = plan_of(ordered_prefix(groups, "v", ["n"]))
    # The one unpartitioned window reads rows already folded per cell.
    below = plan.split("Exchange SinglePartition")[1:]
    assert len(below) == 1
    assert below[0].split("HashAggregate(keys=[")[1].startswith("_cell")


def test_joins_stay_correct_without_any_broadcast(spark, conf):
    before = sorted(snapshot_features(star_tables(spark, SF), STAR_CONFIG).collect())
    conf(LARGE)
    assert sorted(snapshot_features(star_tables(spark, SF), STAR_CONFIG).collect()) == before


def test_broadcasts_are_bounded(spark, conf):
    """Without size-based broadcasts only the tables of fixed size are broadcast."""
    conf(LARGE)
    assert "Broadcast" not in plan_of(cohort_labels(star_tables(spark, SF), STAR_CONFIG))
    assert "Broadcast" not in plan_of(validated_orders(star_tables(spark, SF)))
    scores = spark.range(50).selectExpr(
        "string(id) AS customer_unique_id", "id / 50D AS operational_score", "0.9D AS calibrated_prob"
    )
    plan = plan_of(risk_percentile(risk_tiers(scores, CFG)))
    assert plan.count("BroadcastExchange") == 1 and "_tick" in plan.split("BroadcastExchange")[1]


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.shuffle.partitions": "8",
}


def hot_shop(spark, n=6000):
    """One order with a third of the items, one account with a third of the orders."""
    t = shop(spark)
    orders = spark.range(n, numPartitions=8).selectExpr(
        "string(id) AS order_id",
        f"if(id < {n // 3}, 'hot', concat('c', id)) AS customer_id",
        "'delivered' AS order_status",
        "timestamp_ntz'2018-01-01 00:00:00' AS order_purchase_timestamp",
        "timestamp_ntz'2018-01-09 00:00:00' AS order_delivered_customer_date",
        "timestamp_ntz'2018-01-10 00:00:00' AS order_estimated_delivery_date",
    )
    account = f"if(id = {n // 3 - 1}, 'hot', concat('c', id))"
    customers = spark.range(n // 3 - 1, n, numPartitions=8).selectExpr(
        f"{account} AS customer_id", f"concat('u_', {account}) AS customer_unique_id",
        "'SP' AS customer_state", "'x' AS customer_city",
    )
    items = spark.range(2 * n, numPartitions=8).selectExpr(
        f"string(if(id < {2 * n // 3}, 7, id % {n})) AS order_id",
        "1 AS order_item_id",
        "concat('p', id) AS product_id",
        "1.0D AS price",
        "0.5D AS freight_value",
    )
    return t.__class__(orders, customers, items, t.payments, t.reviews)


def test_hot_keys_are_split_and_counted_whole(spark, conf):
    conf(SKEW)
    n = 6000
    t = hot_shop(spark, n)
    orders = validated_orders(t)
    assert orders.agg(F.count_if(F.col("customer_unique_id") == "u_hot")).first()[0] == n // 3
    assert "SortMergeJoin(skew=true)" in final_plan_of(validated_orders(t))
    products = distinct_products(t, CFG)
    assert "SortMergeJoin(skew=true)" in final_plan_of(products)
    items = t.order_items.collect()
    owner = {str(i): "u_hot" if i < n // 3 else f"u_c{i}" for i in range(n)}
    expected = {}
    for r in items:
        expected.setdefault(owner[r.order_id], set()).add(r.product_id)
    got = {r.customer_unique_id: r.distinct_categories for r in products.collect()}
    assert got == {k: len(v) for k, v in expected.items()}
    (hot,) = snapshot_features(t, CFG).where("customer_unique_id = 'u_hot'").collect()
    assert hot.frequency_orders == n // 3
    assert hot.frequency_items == sum(owner[r.order_id] == "u_hot" for r in items)


def test_totals_fold_before_every_shuffle(spark, conf):
    """A hot order or account reaches each exchange as partial sums."""
    conf(LARGE)
    t = shop(
        spark,
        orders=[order("o1", "a", days_ago(2))],
        customers=[("a", "u", None, None)],
        items=[item("o1")],
    )
    plan = plan_of(cohort_labels(t, CFG))
    for key in ("customer_id", "customer_unique_id"):
        assert f"HashAggregate(keys=[{key}" in plan
    assert plan.count("HashAggregate") >= 6
