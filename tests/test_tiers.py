import numpy as np
import pandas as pd

from tidemark.config import SnapshotConfig
from tidemark.operators.tiers import (
    high_risk_customers,
    risk_percentile,
    risk_tiers,
    scored_customers,
    tier_summary,
)
from tidemark.plans.audits import scoring_audit
from tidemark.plans.reports import (
    calibrated_tier_mix,
    customer_profile,
    explore,
    explorer_count,
    explorer_ids,
    spend_bounds,
    tier_profile,
)

CFG = SnapshotConfig()
SCHEMA = (
    "customer_unique_id string, churn int, operational_score double, calibrated_prob double,"
    " total_spend double, recency_days double, avg_review_score double"
)


def customers(spark, scores, spend=None):
    spend = spend or [100.0] * len(scores)
    rows = [
        (f"Ab{i}", i % 2, s, 0.98, m, 10.0, 4.0) for i, (s, m) in enumerate(zip(scores, spend))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_tiers_use_the_rounded_score(spark):
    cases = {
        0.3: "Medium Risk", 0.29995: "Medium Risk", 0.29994: "Low Risk", 0.7: "Medium Risk",
        0.70004: "Medium Risk", 0.70006: "High Risk", 0.0: "Low Risk", 1.0: "High Risk",
    }
    tiered = risk_tiers(customers(spark, [*cases, float("nan"), None]), CFG).collect()
    got = {r.operational_score: r.business_risk_tier for r in tiered[: len(cases)]}
    assert got == cases
    assert [r.business_risk_tier for r in tiered[len(cases):]] == [None, None]


def test_scores_round_half_to_even(spark):
    values = [0.12345, 0.00005, 0.00015, 0.00025, 0.99995, 0.123449999]
    got = [r.operational_risk_score for r in risk_tiers(customers(spark, values), CFG).collect()]
    assert got == np.round(values, 4).tolist()


def test_percentile_is_the_average_rank(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.random(500), 2).tolist()
    ranked = risk_percentile(risk_tiers(customers(spark, values), CFG)).orderBy("customer_unique_id")
    got = ranked.toPandas()
    expected = np.round(got["operational_risk_score"].rank(pct=True) * 100.0, 1)
    pd.testing.assert_series_equal(got["risk_percentile"], expected, check_names=False)


def test_high_risk_list_is_sorted_and_strict(spark):
    scored = scored_customers(customers(spark, [0.9, 0.70004, 0.95, 0.1, 0.9]), CFG)
    got = [(r.customer_unique_id, r.operational_risk_score) for r in high_risk_customers(scored, CFG).collect()]
    assert got == [("Ab2", 0.95), ("Ab0", 0.9), ("Ab4", 0.9)]
    assert scored.columns[:6] == [
        "customer_unique_id", "business_risk_tier", "operational_risk_score",
        "calibrated_churn_prob", "risk_percentile", "actual_churn",
    ]
    assert "actual_churn" not in scored_customers(customers(spark, [0.9]), CFG, False).columns


def test_an_absent_tier_keeps_its_row(spark):
    scored = risk_tiers(customers(spark, [0.9, 0.8, 0.1, 0.95]), CFG)
    got = [(r.business_risk_tier, r.customer_count, r.percentage) for r in tier_summary(scored).collect()]
    assert got == [("High Risk", 3, 75.0), ("Medium Risk", None, None), ("Low Risk", 1, 25.0)]
    profile = {r.business_risk_tier: r for r in tier_profile(scored).collect()}
    assert profile["Medium Risk"].customers == 0 and profile["Medium Risk"].avg_spend is None
    assert profile["High Risk"].share == 0.75
    mix = {r.business_risk_tier: r.customers for r in calibrated_tier_mix(scored, CFG).collect()}
    assert mix == {"High Risk": 4}


def test_explorer_filters(spark):
    df = customers(spark, [0.9, 0.5, 0.1, 0.9], spend=[0.0, 50.0, 1000.0, 5000.0])
    scored = scored_customers(df, CFG)

    def ids(**options):
        return [r[0] for r in explorer_ids(explore(scored, **options)).collect()]

    assert ids() == ["Ab0", "Ab2"]
    assert ids(tiers=()) == ["Ab0", "Ab1", "Ab2"]
    assert ids(tiers=(), spend=(0.0, 9999.0), id_pattern="aB[13]") == ["Ab1", "Ab3"]
    assert explorer_count(explore(scored, id_pattern="zzz")).first()[0] == 0
    assert tuple(spend_bounds(scored).first()) == (0.0, 2000.0)
    top = customer_profile(scored, "Ab0").first()
    assert top.business_risk_tier == "High Risk" and top.top_percent == 100.0 - 87.5


def test_scoring_audit_counts_what_is_wrong(spark):
    scored = scored_customers(customers(spark, [0.9, 1.2, float("nan")]), CFG)
    wrong = scored.replace("High Risk", "Low Risk", subset=["business_risk_tier"])
    good = {r.check_name: r.violations for r in scoring_audit(scored, high_risk_customers(scored, CFG), CFG).collect()}
    assert good == {
        "operational_out_of_range": 2, "calibrated_out_of_range": 0, "tier_disagrees": 0,
        "export_not_above_threshold": 0, "export_not_high": 0, "export_empty": 0,
    }
    bad = {r.check_name: r.violations for r in scoring_audit(wrong, high_risk_customers(wrong, CFG).limit(0), CFG).collect()}
    assert bad["tier_disagrees"] == 2 and bad["export_empty"] == 1


def test_scores_outside_the_range_have_no_percentile(spark):
    from tidemark.operators.tiers import risk_percentile

    rows = [("a", 0.2), ("b", 1.2), ("c", None), ("d", float("nan")), ("e", 0.4), ("f", -3.0e9)]
    found = risk_percentile(spark.createDataFrame(rows, "customer_unique_id string, operational_risk_score double"))
    assert {r.customer_unique_id: r.risk_percentile for r in found.collect()} == {"a": 50.0, "e": 100.0, "b": None, "c": None, "d": None, "f": None}
