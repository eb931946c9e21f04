from shop import CFG, MICRO, SNAP, TEND, by_key, days_ago, item, order, shop

from tidemark.operators.labels import cohort_labels, label_summary
from tidemark.operators.orders import validated_orders
from tidemark.plans.audits import key_audit


def test_valid_means_delivered_with_items(spark):
    t = shop(
        spark,
        orders=[
            order("o1", "c1", days_ago(5)),
            order("o2", "c1", days_ago(5), status="shipped"),
            order("o3", "c1", days_ago(5)),
            order("o4", "c9", days_ago(5)),
            order("o5", None, days_ago(5), status=None),
        ],
        customers=[("c1", "u1", "SP", "x")],
        items=[item("o1"), item("o1", 2), item("o2"), item("o4"), item("o5")],
    )
    got = by_key(validated_orders(t), "order_id")
    assert len(got) == 5
    assert {k: r.is_valid_delivered for k, r in got.items()} == {
        "o1": True, "o2": False, "o3": False, "o4": True, "o5": False,
    }
    assert not got["o3"].has_items and got["o2"].has_items
    assert got["o4"].customer_unique_id is None and got["o5"].customer_unique_id is None
    assert got["o1"].customer_state == "SP"


def test_window_bounds(spark):
    """History includes the snapshot; the window is open there and closed at its end."""
    cases = {"at_snap": SNAP, "after": SNAP + MICRO, "at_end": TEND, "past_end": TEND + MICRO}
    orders, customers, items = [], [], []
    for name, moment in cases.items():
        customers.append((name, f"u_{name}", None, None))
        orders += [order(f"h_{name}", name, days_ago(9)), order(f"x_{name}", name, moment)]
        items += [item(f"h_{name}"), item(f"x_{name}")]
    t = shop(spark, orders, customers, items)
    got = by_key(cohort_labels(t, CFG))
    assert {k: (r.target_orders_count, r.churn) for k, r in got.items()} == {
        "u_at_snap": (0, 1), "u_after": (1, 0), "u_at_end": (1, 0), "u_past_end": (0, 1),
    }


def test_cohort_needs_history_and_an_owner(spark):
    t = shop(
        spark,
        orders=[
            order("o1", "new", SNAP + MICRO),
            order("o2", "unknown", days_ago(3)),
            order("o3", None, days_ago(3)),
            order("o4", "old", days_ago(3)),
            order("o5", "nameless", days_ago(3)),
            order("o6", "cancelled", days_ago(3), status=None),
        ],
        customers=[
            ("new", "u1", None, None),
            ("old", "u2", None, None),
            ("nameless", None, None, None),
            ("cancelled", "u3", None, None),
        ],
        items=[item(f"o{i}") for i in range(1, 7)],
    )
    cohort = cohort_labels(t, CFG)
    assert [r.customer_unique_id for r in cohort.collect()] == ["u2"]
    assert label_summary(cohort).first().asDict() == {
        "eligible_customers": 1, "churned_customers": 1, "active_customers": 0,
        "churn_rate": 1.0, "active_rate": 0.0,
    }


def test_accounts_of_one_person_are_merged(spark):
    t = shop(
        spark,
        orders=[
            order("o1", "a", days_ago(30)),
            order("o2", "b", SNAP + MICRO),
            order("o3", "b", SNAP + 2 * MICRO),
        ],
        customers=[("a", "u", None, None), ("b", "u", None, None)],
        items=[item("o1"), item("o2"), item("o3")],
    )
    (row,) = cohort_labels(t, CFG).collect()
    assert (row.target_orders_count, row.churn) == (2, 0)


def test_key_audit_finds_repeated_keys(spark):
    t = shop(
        spark,
        orders=[order("o1", "a", days_ago(1)), order("o1", "a", days_ago(2))],
        customers=[("a", "u", None, None), ("a", "v", None, None), ("b", "w", None, None)],
    )
    got = {r.check_name: r.violations for r in key_audit(t).collect()}
    assert got == {"duplicate_order_id": 1, "duplicate_customer_id": 1}
