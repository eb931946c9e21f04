import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from shop import CFG, DAY, MICRO, SNAP, by_key, days_ago, item, order, shop

from tidemark.functions.columns import ntz
from tidemark.operators.features import (
    NUMERIC_FEATURES,
    finish_features,
    logistics_features,
    payment_features,
    review_features,
    rfm_features,
    snapshot_features,
)
from tidemark.plans.work import stored, work_folder
from tidemark.operators.features import feature_base
from tidemark.sources.star_schema import STAR_CONFIG, star_tables


def stored_shop(spark, rows=40):
    """A small shop in files, so that plans tell what they read."""
    t = shop(
        spark,
        orders=[order(f"o{k}", f"c{k}", days_ago(k + 1)) for k in range(rows)],
        customers=[(f"c{k}", f"u{k % 30}", "SP", "x") for k in range(rows)],
        items=[item(f"o{k}", product=f"p{k % 7}") for k in range(rows)],
        reviews=[(f"o{k}", 1 + k % 5, days_ago(1)) for k in range(0, rows, 3)],
    )
    folder = work_folder(spark)
    names = ("orders", "customers", "order_items", "payments", "reviews")
    return replace(t, **{n: stored(getattr(t, n), folder, n) for n in names})


def test_features_and_median_read_the_tables_once(spark):
    t, folder = stored_shop(spark), work_folder(spark)
    made = snapshot_features(t, CFG, folder=folder)
    assert made.inputFiles() and all(f"{folder}/feature_base" in f for f in made.inputFiles())
    assert sorted(map(repr, made.collect())) == sorted(map(repr, snapshot_features(t, CFG).collect()))


def one_order(spark, **tables):
    base = {
        "orders": [order("o1", "c1", days_ago(10))],
        "customers": [("c1", "u1", "SP", "x")],
        "items": [item("o1")],
    }
    return shop(spark, **(base | tables))


def test_age_and_repeat_flags(spark):
    t = one_order(
        spark,
        orders=[order("o1", "c1", days_ago(10)), order("o2", "c1", SNAP - DAY / 2)],
        items=[item("o1"), item("o2")],
    )
    (r,) = rfm_features(t, CFG).collect()
    assert (r.recency_days, r.tenure_days, r.frequency_orders) == (0.5, 10.0, 2)
    assert r.is_repeat_buyer_hist == 1


def test_place_is_the_first_known_one(spark):
    t = shop(
        spark,
        orders=[
            order("o1", "a", days_ago(9)),
            order("o2", "b", days_ago(8)),
            order("o3", "c", days_ago(7)),
            order("o4", "d", days_ago(9)),
            order("o5", "e", SNAP + MICRO),
        ],
        customers=[
            ("a", "u1", None, None),
            ("b", "u1", "SP", None),
            ("c", "u1", "RJ", "town"),
            ("d", "u2", "BA", "city"),
            ("e", "u2", "MG", "later"),
        ],
        items=[item(f"o{i}") for i in range(1, 6)],
    )
    rfm = by_key(rfm_features(t, CFG))
    assert (rfm["u1"].customer_state, rfm["u1"].customer_city) == ("SP", "town")
    assert (rfm["u2"].customer_state, rfm["u2"].customer_city) == ("BA", "city")
    full = by_key(snapshot_features(t, CFG, with_label=True))
    assert full["u1"].customer_state == "SP"
    assert full["u2"].customer_state == "Other"
    assert full["u2"].customer_city == "city"


def test_missing_state_is_other(spark):
    t = one_order(spark, customers=[("c1", "u1", None, None)])
    assert snapshot_features(t, CFG).first().customer_state == "Other"


def test_item_totals_with_missing_values(spark):
    t = one_order(
        spark,
        items=[
            item("o1", 1, "p1", None, float("nan")),
            item("o1", None, "p1", None, None),
            item("o1", None, None, None, 0.5),
        ],
    )
    r = snapshot_features(t, CFG).first()
    assert (r.frequency_items, r.total_spend, r.total_freight) == (1, 0.0, 0.5)
    assert r.distinct_categories == 1
    assert r.avg_order_value == 0.0 and r.avg_item_price == 0.0
    assert r.freight_ratio == pytest.approx(0.5 / (0.5 + 1e-6))


def test_no_countable_item_gives_no_item_price(spark):
    t = one_order(spark, items=[item("o1", None, "p1", 3.0, 1.0)])
    r = snapshot_features(t, CFG).first()
    assert r.frequency_items == 0 and r.avg_item_price is None and r.total_spend == 3.0


def test_money_sums_do_not_depend_on_order(spark):
    prices = [0.1, 0.2, 0.3, 1e9, 0.7] * 20
    t = one_order(spark, items=[item("o1", i, "p", p, 0.1) for i, p in enumerate(prices)])
    r = snapshot_features(t, CFG).first()
    assert r.total_spend == 20_000_000_026.0
    assert r.total_freight == 10.0


def test_amounts_are_not_cut_before_they_are_summed(spark):
    prices = [0.12345678] * 1000 + [0.00004] * 20 + [-7.000012345, 2.5]
    t = one_order(
        spark,
        items=[item("o1", i, "p", p, p / 2) for i, p in enumerate(prices)],
        payments=[("o1", kind, 1, p) for p in prices for kind in ("credit_card", "boleto", "voucher")],
    )
    r = snapshot_features(t, CFG).first()
    whole = math.fsum(prices)
    assert r.total_spend == pytest.approx(whole, abs=1e-9)
    assert r.total_freight == pytest.approx(whole / 2, abs=1e-6)
    assert r.avg_item_price == pytest.approx(whole / len(prices), abs=1e-9)
    paid = payment_features(t, CFG).first()
    assert paid.cc_payment_val == pytest.approx(whole, abs=1e-9)
    assert paid.boleto_payment_val == pytest.approx(whole, abs=1e-9)
    assert paid.total_payment_val == pytest.approx(3 * whole, abs=1e-9)


def test_reviews_as_of_the_snapshot(spark):
    t = shop(
        spark,
        orders=[order(f"o{i}", f"c{i}", days_ago(10)) for i in range(1, 6)],
        customers=[(f"c{i}", f"u{i}", None, None) for i in range(1, 6)],
        items=[item(f"o{i}") for i in range(1, 6)],
        reviews=[
            ("o1", 2, SNAP),
            ("o1", 5, days_ago(1)),
            ("o2", 5, SNAP + MICRO),
            ("o3", None, days_ago(1)),
            ("o4", 4, days_ago(2)),
            ("other", 1, days_ago(2)),
        ],
    )
    part = by_key(review_features(t, CFG))
    assert set(part) == {"u1", "u3", "u4"}
    assert (part["u1"].avg_review_score, part["u1"].has_low_review, part["u1"].review_count) == (
        3.5, 1, 2,
    )
    assert part["u3"].avg_review_score is None and part["u3"].review_count == 0
    full = by_key(snapshot_features(t, CFG))
    # Median of 3.5 and 4.0, also for a customer whose only review has no score.
    assert {k: r.avg_review_score for k, r in full.items()} == {
        "u1": 3.5, "u2": 3.75, "u3": 3.75, "u4": 4.0, "u5": 3.75,
    }
    assert {k: r.has_review_at_snapshot for k, r in full.items()} == {
        "u1": 1, "u2": 0, "u3": 1, "u4": 1, "u5": 0,
    }
    assert full["u3"].has_low_review == 0


def test_no_reviews_at_all_uses_the_fallback(spark):
    assert snapshot_features(one_order(spark), CFG).first().avg_review_score == 4.0
    given = snapshot_features(one_order(spark), CFG, review_median=2.5)
    assert given.first().avg_review_score == 2.5


def test_logistics(spark):
    t = shop(
        spark,
        orders=[
            order("o1", "a", days_ago(20), arrived=days_ago(10), promised=days_ago(12)),
            order("o2", "a", days_ago(20), arrived=days_ago(10), promised=None),
            order("o3", "a", days_ago(20), arrived=SNAP + MICRO, promised=days_ago(1)),
            order("o4", "b", days_ago(20), arrived=None, promised=days_ago(1)),
            order("o5", "c", days_ago(20), arrived=SNAP, promised=SNAP + DAY),
            order("o6", "d", days_ago(20), arrived=days_ago(1), promised=None),
        ],
        customers=[(c, f"u_{c}", None, None) for c in "abcd"],
        items=[item(f"o{i}") for i in range(1, 7)],
    )
    got = by_key(logistics_features(t, CFG))

    def row(c):
        r = got[f"u_{c}"]
        return (
            r.avg_delivery_delay_days, r.late_delivery_rate, r.delivered_count,
            r.pending_delivery_at_snapshot, r.has_delivery_history,
        )

    # An unknown promise leaves the delay out but counts as on time.
    assert row("a") == (2.0, 0.5, 2, 1, 1)
    assert row("b") == (0.0, 0.0, 0, 1, 0)
    assert row("c") == (-1.0, 0.0, 1, 0, 1)
    assert row("d") == (0.0, 0.0, 1, 0, 1)


def test_payments(spark):
    t = shop(
        spark,
        orders=[order(f"o{i}", f"c{i}", days_ago(10)) for i in range(1, 5)],
        customers=[(f"c{i}", f"u{i}", None, None) for i in range(1, 5)],
        items=[item(f"o{i}") for i in range(1, 5)],
        payments=[
            ("o1", "credit_card", 3, 60.0),
            ("o1", "boleto", 1, 30.0),
            ("o1", "voucher", None, 10.0),
            ("o1", None, 2, None),
            ("o2", "boleto", 1, 0.0),
            ("o3", "credit_card", None, None),
        ],
    )
    part = by_key(payment_features(t, CFG))
    assert set(part) == {"u1", "u2", "u3"}
    assert part["u3"].avg_payment_installments is None
    full = by_key(snapshot_features(t, CFG))
    assert full["u1"].avg_payment_installments == 2.0
    assert full["u1"].credit_card_share == pytest.approx(60 / (100 + 1e-6), abs=1e-15)
    assert full["u1"].boleto_share == pytest.approx(30 / (100 + 1e-6), abs=1e-15)
    assert (full["u2"].credit_card_share, full["u2"].boleto_share) == (0.0, 0.0)
    assert full["u3"].avg_payment_installments == 1.0
    assert full["u4"].avg_payment_installments == 1.0 and full["u4"].boleto_share == 0.0


def test_several_payments_and_items_do_not_multiply(spark):
    t = one_order(
        spark,
        items=[item("o1", i, f"p{i}", 10.0, 1.0) for i in range(3)],
        payments=[("o1", "voucher", 1, 10.0)] * 3,
        reviews=[("o1", 5, days_ago(1))] * 2,
    )
    r = snapshot_features(t, CFG).first()
    assert (r.total_spend, r.frequency_items, r.review_count, r.frequency_orders) == (30.0, 3, 2, 1)


def test_no_feature_is_missing_or_extra(spark):
    columns = snapshot_features(one_order(spark), CFG).columns
    assert len(columns) == 28 and set(NUMERIC_FEATURES) < set(columns)
    labelled = snapshot_features(one_order(spark), CFG, with_label=True).columns
    assert len(labelled) == 30


def test_features_ignore_everything_after_the_snapshot(spark):
    """Cutting all inputs at the snapshot must not change a single feature."""
    t = star_tables(spark, "/root/testdata/sf0.001")
    snap = ntz(STAR_CONFIG.snapshot)
    arrived = F.col("order_delivered_customer_date")
    cut = replace(
        t,
        orders=t.orders.where(F.col("order_purchase_timestamp") <= snap).withColumn(
            "order_delivered_customer_date", F.when(arrived <= snap, arrived)
        ),
        reviews=t.reviews.where(F.col("review_creation_date") <= snap),
    )
    whole = snapshot_features(t, STAR_CONFIG).collect()
    labelled = snapshot_features(t, STAR_CONFIG, with_label=True)
    labelled = labelled.drop("target_orders_count", "churn").collect()
    truncated = snapshot_features(cut, STAR_CONFIG).collect()

    def key(row):
        return row.customer_unique_id

    assert len(whole) == 140
    assert sorted(whole, key=key) == sorted(truncated, key=key) == sorted(labelled, key=key)


def test_partitioning_does_not_change_results(spark, conf):
    t = star_tables(spark, "/root/testdata/sf0.001")
    first = sorted(snapshot_features(t, STAR_CONFIG).collect())
    conf({"spark.sql.shuffle.partitions": "7", "spark.sql.autoBroadcastJoinThreshold": "-1"})
    assert sorted(snapshot_features(t, STAR_CONFIG).collect()) == first


def test_two_step_form_equals_one_query(spark):
    t = star_tables(spark, "/root/testdata/sf0.001")
    base = stored(feature_base(t, STAR_CONFIG, with_label=True), work_folder(spark), "base")
    two = finish_features(base, STAR_CONFIG).collect()
    one = snapshot_features(t, STAR_CONFIG, with_label=True).collect()
    assert sorted(one) == sorted(two)
    assert all(not math.isnan(r.avg_review_score) for r in one)


def test_an_order_listed_more_than_once_counts_once(spark):
    orders = [
        order("o1", "a", days_ago(30), arrived=days_ago(20)),
        order("o1", "a", days_ago(40), arrived=days_ago(20)),
        order("o2", "b", days_ago(5)),
        order("o3", "a", SNAP + DAY),
        order("o3", "a", SNAP + DAY),
        order("o3", "a", SNAP + 2 * DAY),
    ]
    t = shop(
        spark,
        orders=orders,
        customers=[("a", "u", "SP", None), ("b", "u", "SP", None)],
        items=[item("o1", price=10.0), item("o2", price=5.0), item("o3")],
    )
    row = snapshot_features(t, CFG, 4.0, with_label=True).first()
    assert (row.frequency_orders, row.target_orders_count) == (2, 1)
    assert row.first_purchase == days_ago(40) and row.delivered_count == 2
    # Amounts count once per listed row, as a join of items and orders gives them.
    assert (row.frequency_items, row.total_spend, row.avg_order_value) == (3, 25.0, 12.5)
