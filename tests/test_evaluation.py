import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.operators import calibration as cal
from tidemark.operators import classification as cls
from tidemark.operators import deciles as dec
from tidemark.operators import ranking as rank
from tidemark.plans import evaluation as ev

SCHEMA = "customer_unique_id string, churn int, operational_score double, calibrated_prob double"


def holdout(spark, y, s, p=None):
    p = s if p is None else p
    rows = [(f"id{i:06d}", int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, s, p))]
    return spark.createDataFrame(rows, SCHEMA)


def random_holdout(n, digits, seed=3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.8).astype(int)
    s = np.round(np.clip(0.5 + 0.1 * y + rng.normal(0, 0.15, n), 0, 1), digits)
    return y, s


def pair_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))


def step_precision(y, s):
    total, previous = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        chosen = s >= t
        recall = y[chosen].sum() / y.sum()
        total += (recall - previous) * y[chosen].mean()
        previous = recall
    return total


@pytest.mark.parametrize("digits", [1, 3])
def test_ranking_metrics_by_brute_force(spark, digits):
    y, s = random_holdout(400, digits)
    p = np.round(0.95 + s / 25, digits + 2)
    got = {r.view: r for r in rank.ranking_summary(holdout(spark, y, s, p)).collect()}
    assert got["churn"].roc_auc == pytest.approx(pair_auc(y, s), abs=1e-12)
    assert got["churn_calibrated"].roc_auc == pytest.approx(pair_auc(y, p), abs=1e-12)
    assert got["active"].roc_auc == pytest.approx(got["churn"].roc_auc, abs=1e-12)
    assert got["churn"].average_precision == pytest.approx(step_precision(y, s), abs=1e-12)
    assert got["active"].average_precision == pytest.approx(step_precision(1 - y, 1 - s), abs=1e-12)
    assert got["active"].prevalence == pytest.approx((1 - y).mean(), abs=1e-12)
    lift = got["active"].average_precision / (got["active"].prevalence + 1e-9)
    assert got["active"].relative_lift == lift


def brute_roc(y, s):
    points = [(0.0, 0.0)]
    tp, fp = [], []
    for t in sorted(set(s), reverse=True):
        tp.append(int(y[s >= t].sum()))
        fp.append(int((1 - y)[s >= t].sum()))
    for i in range(len(tp)):
        inner = 0 < i < len(tp) - 1
        straight = inner and all(c[i + 1] - 2 * c[i] + c[i - 1] == 0 for c in (tp, fp))
        if not straight:
            points.append((fp[i] / fp[-1], tp[i] / tp[-1]))
    return points


@pytest.mark.parametrize("n, digits", [(60, 1), (300, 6), (3, 6)])
def test_roc_curve_by_brute_force(spark, n, digits):
    y, s = random_holdout(n, digits)
    y[:2] = [0, 1]
    got = rank.roc_curve(holdout(spark, y, s)).orderBy("point_no").collect()
    assert [(r.x, r.y) for r in got] == brute_roc(y, s)
    assert [r.point_no for r in got] == list(range(len(got)))
    assert {r.n_points for r in got} == {len(got)}


def test_pr_curve_runs_from_prevalence_to_the_end_point(spark):
    y, s = random_holdout(200, 2)
    got = rank.pr_curve(holdout(spark, y, s), "churn").orderBy("point_no").collect()
    expected = [
        (y[s >= t].sum() / y.sum(), y[s >= t].mean()) for t in sorted(set(s))
    ] + [(0.0, 1.0)]
    np.testing.assert_allclose([(r.x, r.y) for r in got], expected, rtol=0, atol=1e-12)
    assert got[0].x == 1.0 and got[0].y == pytest.approx(y.mean())


@pytest.mark.parametrize("n", [2, 149, 150, 151, 152, 299, 300, 1000, 7777])
def test_downsample_indices(spark, n):
    curve = spark.range(n).selectExpr("id AS point_no", "0D AS x", "0D AS y", f"{n}L AS n_points")
    got = sorted(r.point_no for r in rank.downsample(curve).collect())
    if n <= 150:
        assert got == list(range(n))
    else:
        assert got == sorted(set(np.linspace(0, n - 1, 150, dtype=int).tolist()))


def test_published_confusion_counts_give_the_published_report(spark):
    # Published counts and report.
    counts = spark.createDataFrame([(65, 66, 4344, 6630)], "tn long, fp long, fn long, tp long")
    got = {r["class"]: r for r in cls.classification_report(counts).collect()}
    active, churn = got["Active (0)"], got["Churn (1)"]
    assert (active.precision, active.recall, active.f1_score) == pytest.approx(
        (0.014743, 0.496183, 0.028634), abs=1e-6
    )
    assert (churn.precision, churn.recall, churn.f1_score) == pytest.approx(
        (0.990143, 0.604155, 0.750424), abs=1e-6
    )
    assert got["accuracy"].precision == pytest.approx(0.6028815848716794, abs=1e-12)
    assert got["macro avg"].f1_score == pytest.approx(0.389529, abs=1e-6)
    assert got["weighted avg"].f1_score == pytest.approx(0.741910, abs=1e-6)
    assert (active.support, churn.support, got["weighted avg"].support) == (131, 10974, 11105)


def test_report_with_one_predicted_class(spark):
    y, s = np.array([0, 1, 1]), np.array([0.5, 0.5, 0.9])
    matrix = cls.confusion_matrix(holdout(spark, y, s))
    assert matrix.first().asDict() == {"tn": 0, "fp": 1, "fn": 0, "tp": 2}
    got = {r["class"]: r for r in cls.classification_report(matrix).collect()}
    assert (got["Active (0)"].precision, got["Active (0)"].f1_score) == (0.0, 0.0)
    table = cls.confusion_table(matrix).collect()
    assert [tuple(r) for r in table] == [("Active (0)", 0, 1), ("Churn (1)", 0, 2)]


def test_published_decile_pairs_give_the_published_lift(spark):
    # Published decile sizes and actives.
    sizes = [1111, 1110, 1111, 1110, 1111, 1110, 1110, 1111, 1110, 1111]
    actives = [31, 11, 10, 13, 13, 21, 10, 10, 5, 7]
    rows = [(i + 1, n, a) for i, (n, a) in enumerate(zip(sizes, actives))]
    counts = spark.createDataFrame(rows, "decile_no int, customers long, active_count long")
    got = dec.decile_lift(counts).collect()
    first = got[0]
    assert first.decile == "D1" and first.lift == pytest.approx(2.365347, abs=1e-6)
    assert first.cum_active_capture_pct == pytest.approx(23.664, abs=1e-3)
    assert got[-1].cum_active_count == 131 and got[-1].cum_customer_pct == 100.0
    assert got[-1].cum_lift == pytest.approx(1.0, abs=1e-6)


def brute_deciles(y, s, ids, q=10):
    from hashlib import md5

    order = sorted(range(len(y)), key=lambda i: (-(1.0 - s[i]), md5(ids[i].encode()).hexdigest()))
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    bins = pd.qcut(pd.Series(ranks), q=q, labels=range(1, q + 1))
    table = pd.DataFrame({"d": bins.astype(int), "active": 1 - y}).groupby("d")["active"]
    return {int(d): (int(g.count()), int(g.sum())) for d, g in table}


@pytest.mark.parametrize("n, digits", [(1105, 6), (1105, 1), (400, 0), (11, 6)])
def test_deciles_with_ties_of_any_size(spark, n, digits):
    y, s = random_holdout(n, digits)
    df = holdout(spark, y, s)
    ids = [f"id{i:06d}" for i in range(n)]
    got = {r.decile_no: (r.customers, r.active_count) for r in dec.decile_counts(df).collect()}
    assert got == brute_deciles(y, s, ids)


def test_published_decile_sizes(spark):
    df = spark.range(11105).selectExpr(
        "string(id) AS customer_unique_id", "1 AS churn", "id / 20000D AS operational_score"
    )
    got = {r.decile_no: r.customers for r in dec.decile_counts(df).collect()}
    sizes = [1111, 1110, 1111, 1110, 1111, 1110, 1110, 1111, 1110, 1111]
    assert [got[d] for d in range(1, 11)] == sizes


def test_calibration_bins_use_the_float_edges(spark):
    s = np.array([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
    df = holdout(spark, np.ones(11), s)
    expected = np.clip(np.digitize(s, np.linspace(0.0, 1.0, 11)) - 1, 0, 9)
    got = df.select("operational_score", cal.bin_of(df.operational_score).alias("b")).collect()
    assert {r.operational_score: r.b for r in got} == dict(zip(s.tolist(), expected.tolist()))


def test_calibration_by_brute_force(spark):
    y, s = random_holdout(500, 4)
    p = np.clip(s + 0.1, 0, 1)
    df = holdout(spark, y, s, p)
    got = {r.score_name: r for r in cal.calibration(df).collect()}
    alone = {r.score_name: r.ece for r in cal.expected_calibration_error(df).collect()}
    assert alone == pytest.approx({name: r.ece for name, r in got.items()}, abs=1e-12)
    for name, values in (("operational_score", s), ("calibrated_prob", p)):
        bins = np.clip(np.digitize(values, np.linspace(0, 1, 11)) - 1, 0, 9)
        ece = sum(
            (bins == b).mean() * abs(y[bins == b].mean() - values[bins == b].mean())
            for b in set(bins)
        )
        assert got[name].ece == pytest.approx(ece, abs=1e-12)
        assert got[name].brier_score == pytest.approx(np.mean((values - y) ** 2), abs=1e-12)
        assert got[name].mean_score == pytest.approx(values.mean(), abs=1e-12)


def test_metrics_document_has_every_section(spark):
    y, s = random_holdout(120, 3)
    df = holdout(spark, y, s).cache()
    frames = ev.evaluate(df)
    doc = ev.metrics_document(frames)
    assert set(doc) == {
        "discrimination", "calibration", "dual_pr_auc", "classification_report",
        "confusion_matrix", "decile_lift", "test_counts",
    }
    assert doc["test_counts"] == {
        "total_test": 120, "churn_count": int(y.sum()), "active_count": int((1 - y).sum()),
    }
    assert [d["decile"] for d in doc["decile_lift"]] == [f"D{i}" for i in range(1, 11)]
    assert sum(d["customers"] for d in doc["decile_lift"]) == 120
    assert doc["dual_pr_auc"]["churn_class_1"]["pr_curve"]["recall"][0] == 1.0
    assert doc["discrimination"]["roc_curve"]["fpr"][0] == 0.0
    assert not any(math.isnan(r.value) for r in ev.metrics_tidy(frames).collect())
    df.unpersist()


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_ranking_refuses_scores_without_a_place(spark, bad):
    df = spark.createDataFrame([("a", 1, 0.5, 0.5), ("b", 0, bad, 0.5)], "customer_unique_id string, churn int, operational_score double, calibrated_prob double")
    with pytest.raises(Exception, match="null or NaN"):
        rank.ranking_summary(df).collect()


def test_all_curves_come_from_one_pass_over_the_scores(spark, monkeypatch):
    calls = []
    grouped = rank.score_groups
    monkeypatch.setattr(rank, "score_groups", lambda *a: calls.append(1) or grouped(*a))
    df = spark.createDataFrame([(str(k), k % 3 % 2, k / 50, 1 - k / 60) for k in range(50)], "customer_unique_id string, churn int, operational_score double, calibrated_prob double")
    ranked = rank.ranked_scores(df)
    assert {r.view: r.n for r in ranked.groupBy("view").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(rank.VIEWS, 50)
    points = ev.curve_samples(ranked)
    assert set(r.curve for r in points.collect()) == set(ev.CURVES) and len(calls) == 1
    assert "Window" not in points._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bad", [None, float("nan"), 1.2, -0.1])
def test_each_metric_refuses_what_is_no_probability(spark, bad):
    df = spark.createDataFrame([("a", 1, 0.5, 0.5), ("b", 0, bad, 0.5)], SCHEMA)
    for metric in (cls.confusion_matrix, cal.calibration, dec.decile_counts):
        with pytest.raises(Exception, match="null, NaN or outside 0 to 1"):
            metric(df).collect()


def test_each_metric_refuses_unknown_labels(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 0.5), ("b", None, 0.4, 0.5)], SCHEMA)
    for metric in (cls.confusion_matrix, cal.calibration, dec.decile_counts):
        with pytest.raises(Exception, match="neither 0 nor 1"):
            metric(df).collect()
