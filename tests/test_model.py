import threading
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import preprocess
from tidemark.operators.features import NUMERIC_FEATURES
from tidemark.operators.preprocess import (
    class_weights,
    fit_preprocessor,
    one_hot_state,
    scaler_moments,
    state_levels,
)
from tidemark.operators.scorecard import score
from tidemark.plans import training
from tidemark.plans.training import (
    VECTOR,
    by_odds_ratio,
    coefficients,
    feature_importance,
    fitted_moments,
    model_coefficients,
    train_models,
)
from tidemark.sinks.writers import save_models
from tidemark.sources.readers import load_models

STATES = ["MG", "Other", "PR", "SP"]
N = 600


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, len(NUMERIC_FEATURES))) * rng.uniform(0.5, 40, len(NUMERIC_FEATURES))
    x[:, 5] = 3.0  # a constant feature
    state = rng.choice(STATES, N)
    odds = 1.2 + x[:, 0] / x[:, 0].std() - 0.5 * x[:, 1] / x[:, 1].std() + (state == "SP")
    y = (rng.random(N) < 1 / (1 + np.exp(-odds))).astype(int)
    rows = [(f"c{i}", int(y[i]), str(state[i]), *map(float, x[i])) for i in range(N)]
    names = ", ".join(f"{n} double" for n in NUMERIC_FEATURES)
    schema = f"customer_unique_id string, churn int, customer_state string, {names}"
    df = spark.createDataFrame(rows, schema).cache()
    yield df, x, state, y
    df.unpersist()


@pytest.fixture(scope="module")
def models(train):
    return train_models(train[0])


def newton(z, y, w):
    """Minimise sum(w * logloss) + |b|^2 / 2 with a free intercept, exactly."""
    a = np.hstack([np.ones((len(y), 1)), z])
    penalty = np.eye(a.shape[1])
    penalty[0, 0] = 0.0
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        gradient = a.T @ (w * (p - y)) + penalty @ b
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        b -= np.linalg.solve(hessian, gradient)
    return b


def design(x, state):
    sd = x.std(axis=0)
    sd[sd == 0] = 1.0
    dummies = np.stack([(state == s).astype(float) for s in STATES[1:]], axis=1)
    return np.hstack([(x - x.mean(axis=0)) / sd, dummies])


def test_moments_are_population_moments(train):
    df, x, _, _ = train
    got = {r.feature: (r.mean, r.std) for r in scaler_moments(df).collect()}
    assert list(got) == list(NUMERIC_FEATURES)
    for i, name in enumerate(NUMERIC_FEATURES):
        assert got[name] == pytest.approx((x[:, i].mean(), x[:, i].std()), abs=1e-9)


def test_first_state_is_dropped_and_unknown_is_all_zero(spark, train):
    levels = {r.customer_state: r.is_dropped for r in state_levels(train[0]).collect()}
    assert levels == {"MG": True, "Other": False, "PR": False, "SP": False}
    assert fit_preprocessor(train[0]).feature_names[-3:] == [
        "customer_state_Other", "customer_state_PR", "customer_state_SP",
    ]
    df = spark.createDataFrame([("SP",), ("MG",), ("??",), (None,)], "customer_state string")
    got = [tuple(r) for r in df.select(*one_hot_state(df, STATES[1:])).collect()]
    assert got == [(0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_published_class_weights(spark):
    # The published training split and its rounded weights.
    df = spark.range(522).selectExpr("0 AS churn").union(spark.range(43898).selectExpr("1 AS churn"))
    got = {r.churn: r.weight for r in class_weights(df).collect()}
    assert got[0] == pytest.approx(42.5, abs=0.05) and got[1] == pytest.approx(0.506, abs=0.0005)


def test_coefficients_match_an_exact_solver(train, models):
    _, x, state, y = train
    z = design(x, state)
    balanced = np.where(y == 1, N / (2 * y.sum()), N / (2 * (N - y.sum())))
    for model, w in ((models.operational, balanced), (models.calibrated, np.ones(N))):
        exact = newton(z, y, w)
        fitted = model.stages[-1]
        assert fitted.intercept == pytest.approx(exact[0], abs=2e-5)
        np.testing.assert_allclose(fitted.coefficients.toArray(), exact[1:], atol=2e-5)


def test_column_formula_equals_the_model(train, models):
    df = train[0]
    got = score(df, *models.scorecards()).select("operational_score", "calibrated_prob").collect()
    for model, name in ((models.operational, "operational_score"), (models.calibrated, "calibrated_prob")):
        direct = [r.probability[1] for r in model.transform(df).select("probability").collect()]
        np.testing.assert_allclose([r[name] for r in got], direct, atol=1e-12)


def test_importance_is_sorted_by_effect(spark, models):
    got = feature_importance(spark, models.operational, models.preprocessor).collect()
    impacts = [r.abs_impact for r in got]
    assert len(got) == 24 and impacts == sorted(impacts, reverse=True)
    values = dict(coefficients(models.operational, models.preprocessor))
    for r in got:
        assert r.odds_ratio == pytest.approx(np.exp(values[r.feature]))
        assert r.direction == ("protects" if r.coefficient < 0 else "raises")
    assert model_coefficients(spark, models).count() == 2 * 25


def test_importance_by_odds_ratio(spark, models):
    importance = feature_importance(spark, models.operational, models.preprocessor)
    got = [r.odds_ratio for r in by_odds_ratio(importance).collect()]
    assert len(got) == 24 and got == sorted(got)


def test_fits_meet_their_first_order_conditions(train, models):
    df, x, state, y = train
    z = np.hstack([np.ones((N, 1)), design(x, state)])
    rows = fitted_moments(df, models).collect()
    for kind, w in (("operational", np.where(y == 1, N / (2 * y.sum()), N / (2 * (N - y.sum())))),
                    ("calibrated", np.ones(N))):
        got = [r for r in rows if r.model == kind]
        np.testing.assert_allclose([r.labelled for r in got], z.T @ (w * y) / N, atol=1e-9)
        np.testing.assert_allclose([r.fitted for r in got], z.T @ (w * y) / N, atol=1e-5)
    # The wrong model does not meet them.
    swapped = replace(models, operational=models.calibrated, calibrated=models.operational)
    off = [abs(r.fitted - r.labelled) for r in fitted_moments(df, swapped).collect()]
    assert max(off) > 0.01


def test_a_null_feature_counts_as_the_training_mean(train):
    df = train[0]
    gap = F.when(F.hash("customer_unique_id") % 7 != 0, F.col("avg_item_price"))
    holed = df.withColumn("avg_item_price", gap)
    fitted = train_models(holed)
    mean = F.lit(fitted.preprocessor.means["avg_item_price"])
    filled = holed.withColumn("avg_item_price", F.coalesce("avg_item_price", mean))
    columns = ["customer_unique_id", "operational_score", "calibrated_prob"]
    card = [score(d, *fitted.scorecards()).select(columns).orderBy("customer_unique_id").collect()
            for d in (holed, filled)]
    assert card[0] == card[1] and all(None not in r for r in card[0])
    direct = fitted.operational.transform(holed).orderBy("customer_unique_id").select("probability").collect()
    np.testing.assert_allclose([r.operational_score for r in card[0]], [r.probability[1] for r in direct], atol=1e-12)


def test_saved_models_score_the_same(spark, train, models, tmp_path):
    df = train[0]
    importance = feature_importance(spark, models.operational, models.preprocessor)
    path = str(tmp_path / "models")
    save_models(spark, models, importance, path)
    loaded = load_models(spark, path)
    assert {"operational", "calibrated", "importance"} <= set(loaded)
    assert loaded["numerical_features"] == list(NUMERIC_FEATURES)
    assert loaded["importance"].count() == 24
    for name in ("operational", "calibrated"):
        before = getattr(models, name).transform(df).select("probability").collect()
        assert loaded[name].transform(df).select("probability").collect() == before
    assert VECTOR in loaded["operational"].transform(df).columns


def test_one_pass_gives_all_that_precedes_the_fits(spark, monkeypatch):
    rows = [(k % 2, ["SP", "RJ", "MG"][k % 3], 1e9 + k, None if k % 5 else float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "churn int, customer_state string, total_spend double, recency_days double")
    summary = preprocess.fit_summary(df.repartition(5))
    spend = np.array([r[2] for r in rows])
    recency = np.array([r[3] for r in rows if r[3] is not None])
    for name, values in (("total_spend", spend), ("recency_days", recency)):
        moments = summary.moments()[name]
        assert moments.n == len(values) and abs(moments.mean - values.mean()) < 1e-6
        assert abs(moments.squares / moments.n - values.var()) < 1e-6
    assert summary.levels() == {"MG": 20, "RJ": 20, "SP": 20} and summary.classes() == {0: 30, 1: 30}
    assert summary.weights() == {0: 1.0, 1: 1.0}
    monkeypatch.setattr(preprocess, "MAX_CELLS", 5)
    with pytest.raises(ValueError, match="not a category"):
        preprocess.fit_summary(df)
    empty = preprocess.fit_summary(df.where("false"))
    assert empty.weights() == {} and preprocess.preprocessor_of(empty).state_levels == ()


@pytest.mark.parametrize(("rows", "partitions"), [(100_000, 1), (100, 6)])
def test_fits_run_side_by_side_over_partitions_that_follow_the_rows(train, models, monkeypatch, rows, partitions):
    seen, both, real = [], threading.Barrier(2, timeout=120), training._logistic

    class Watched:
        def __init__(self, *args):
            self.estimator = real(*args)

        def fit(self, frame):
            seen.append(frame.rdd.getNumPartitions())
            both.wait()
            return self.estimator.fit(frame)

    monkeypatch.setattr(training, "FIT_ROWS", rows, raising=False)
    monkeypatch.setattr(training, "_logistic", Watched)
    again = train_models(train[0].repartition(8))
    assert seen == [partitions] * 2
    for name in ("operational", "calibrated"):
        was, now = (getattr(m, name).stages[-1].coefficients.toArray() for m in (models, again))
        np.testing.assert_allclose(now, was, atol=2e-5)
