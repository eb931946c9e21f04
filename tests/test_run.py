import pytest
from shop import days_ago, item, order, shop

from tidemark.plans.audits import (
    leakage_audit,
    metric_checks,
    scoring_audit,
    target_audit,
)
from tidemark.plans.run import run
from tidemark.operators.labels import cohort_labels
from tidemark.operators.tiers import high_risk_customers
from tidemark.sources.readers import (
    load_models,
    load_results,
    read_high_risk_csv,
    read_metrics,
    read_scored,
)
from tidemark.sources.star_schema import STAR_CONFIG, star_tables


def test_end_to_end(spark, tmp_path):
    t = star_tables(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "out")
    result = run(spark, t, out, STAR_CONFIG)

    assert result.dataset.count() == 140 and len(result.dataset.columns) == 30
    assert result.metrics == read_metrics(spark, f"{out}/metrics")
    assert result.metrics["test_counts"] == {"total_test": 28, "churn_count": 24, "active_count": 4}

    scored = read_scored(spark, f"{out}/scored_customers")
    assert scored.count() == 140 and len(scored.columns) == 30
    tiers = {r.business_risk_tier: r.customer_count or 0 for r in result.tiers.collect()}
    assert sum(tiers.values()) == 140

    exported = read_high_risk_csv(spark, f"{out}/high_risk_customers", scored)
    assert exported.count() == tiers["High Risk"] > 0
    checks = scoring_audit(scored, exported, STAR_CONFIG).collect()
    checks += leakage_audit(t, result.dataset, STAR_CONFIG).collect()
    checks += target_audit(cohort_labels(t, STAR_CONFIG), result.dataset).collect()
    assert len(checks) == 16 and all(c.violations == 0 for c in checks)
    audited = {c.check_name: c.violations for c in result.audits.collect()}
    assert audited.keys() >= {c.check_name for c in checks}
    # The bounds of the metrics are those of the published data, not of this one.
    assert not any(audited[c.check_name] for c in checks)
    metrics, listed, importance = load_results(spark, out)
    assert metrics == result.metrics and listed.count() == 140 and importance.count() > 21
    assert high_risk_customers(scored, STAR_CONFIG).count() == exported.count()

    loaded = load_models(spark, f"{out}/models")
    assert len(loaded["numerical_features"]) == 21
    assert loaded["importance"].count() == len(loaded["operational"].stages[-1].coefficients)


def test_metric_bounds():
    def doc(auc, brier, lift):
        return {
            "discrimination": {"roc_auc_operational": auc},
            "calibration": {"brier_score_calibrated": brier},
            "dual_pr_auc": {"active_class_0": {"relative_lift_over_baseline": lift}},
        }

    # The published metrics pass.
    assert metric_checks(doc(0.6035187959882972, 0.0115574758252539, 2.6454609433306553)) == []
    assert metric_checks(doc(0.5, 0.05, 1.0)) == [
        "auc_not_above_half", "brier_too_large", "lift_not_above_one",
    ]


def test_repeated_customers_stop_the_run(spark, tmp_path):
    t = shop(
        spark,
        orders=[order("o1", "a", days_ago(3))] * 2,
        customers=[("a", "u", None, None)] * 2,
        items=[item("o1")],
    )
    with pytest.raises(ValueError, match="duplicate_customer_id"):
        run(spark, t, str(tmp_path / "out"))
