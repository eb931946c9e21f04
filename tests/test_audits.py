from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F
from shop import CFG, SNAP, days_ago, item, order, shop

from tidemark.operators.features import snapshot_features
from tidemark.operators.labels import cohort_labels
from tidemark.plans.audits import as_of, leakage_audit, target_audit
from tidemark.plans.work import stored, work_folder


def tables(spark):
    later = SNAP + timedelta(days=3)
    return shop(
        spark,
        orders=[
            order("o1", "a", days_ago(9), arrived=later, promised=days_ago(1)),
            order("o2", "b", days_ago(5), arrived=days_ago(2), promised=days_ago(1)),
            order("o3", "a", later),
        ],
        customers=[("a", "u", "SP", "x"), ("b", "v", None, None)],
        items=[item("o1"), item("o2"), item("o3")],
        reviews=[("o1", 1, later), ("o2", 5, days_ago(1))],
    )


def found(df):
    return {r.check_name: r.violations for r in df.collect() if r.violations}


def test_sound_features_break_nothing(spark):
    t = tables(spark)
    assert found(leakage_audit(t, snapshot_features(t, CFG), CFG)) == {}
    assert as_of(t, CFG).orders.count() == 2 and as_of(t, CFG).reviews.count() == 1


def test_tables_as_of_the_snapshot_are_read_once(spark):
    t, folder = tables(spark), work_folder(spark)
    kept = replace(t, reviews=stored(t.reviews, f"{folder}/shop", "reviews"))
    audit = leakage_audit(kept, snapshot_features(t, CFG), CFG, folder=folder)
    read = audit.inputFiles()
    assert read and all(f"{folder}/as_of/feature_base" in f for f in read) and found(audit) == {}


def test_each_leak_is_found(spark):
    t = tables(spark)
    good = snapshot_features(t, CFG)

    def spoilt(column, value):
        one = F.col("customer_unique_id") == "u"
        return good.withColumn(column, F.when(one, value).otherwise(F.col(column)))

    differs = {"differs_from_tables_as_of_snapshot": 1}
    for column, value, names in (
        ("frequency_orders", F.lit(2).cast("long"), {"order_after_snapshot": 1}),
        ("review_count", F.lit(1).cast("long"), {"review_after_snapshot": 1}),
        ("late_delivery_rate", F.lit(1.0), {}),
        ("recency_days", F.lit(-3.0), {"negative_recency": 1}),
        (
            "last_purchase",
            F.lit(SNAP + timedelta(days=3)).cast("timestamp_ntz"),
            {"purchase_after_snapshot": 1},
        ),
    ):
        assert found(leakage_audit(t, spoilt(column, value), CFG)) == names | differs
    assert found(leakage_audit(t, good.where("customer_unique_id = 'v'"), CFG)) == differs


def test_target_audit_sees_both_directions_and_expected_counts(spark):
    t = tables(spark)
    cohort, features = cohort_labels(t, CFG), snapshot_features(t, CFG)
    one = "customer_unique_id = 'u'"
    assert found(target_audit(cohort.where(one), features)) == {"cohort_features_mismatch": 1}
    assert found(target_audit(cohort, features.where(one))) == {"cohort_features_mismatch": 1}
    right = {"eligible_customers": 2, "churned_customers": 1, "active_customers": 1}
    assert found(target_audit(cohort, features, right)) == {}
    wrong = right | {"eligible_customers": 5}
    assert found(target_audit(cohort, features, wrong)) == {"unexpected_eligible_customers": 3}
