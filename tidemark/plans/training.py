"""Fit the operational (class-balanced) and calibrated (base-rate) models."""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import NUMERIC_FEATURES
from tidemark.operators.preprocess import (
    STATE,
    Preprocessor,
    fit_summary,
    preprocessor_of,
)
from tidemark.operators.scorecard import NumericTerm, Scorecard, score

INVERSE_PENALTY = 1.0  # the C of the usual "C * loss + |b|^2 / 2" objective
MAX_ITERATIONS = 1000
TOLERANCE = 1e-8
VECTOR = "model_vector"
FIT_ROWS = 100_000  # of a task of the fits, about 20 MB of vectors


@dataclass(frozen=True)
class TrainedModels:
    operational: PipelineModel
    calibrated: PipelineModel
    preprocessor: Preprocessor

    def scorecards(self) -> tuple[Scorecard, Scorecard]:
        """Both fitted models as plain column formulas, for wide scoring jobs."""
        return (
            as_scorecard(self.operational, self.preprocessor),
            as_scorecard(self.calibrated, self.preprocessor),
        )


def train_models(train: DataFrame) -> TrainedModels:
    """Fit both models on a labelled feature frame.

    One pass over the rows gives all that precedes the fits. These share one cached frame of vectors. It is cached, not
    checkpointed: a lost block is recomputed from the stored features. The fits run side by side: each is a chain of
    short jobs, and the cores that one leaves idle between its jobs serve the other. Every iteration is a job over all
    partitions, so that their number follows the rows, not the files.
    """
    summary = fit_summary(train)
    prep, weights = preprocessor_of(summary), summary.weights()
    weight = F.when(F.col("churn") == 1, F.lit(weights.get(1))).otherwise(F.lit(weights.get(0)))
    stages = preprocessing_stages(prep)
    frame = PipelineModel(stages).transform(train)
    rows = sum(summary.classes().values())
    frame = (
        frame.select(F.col("churn").cast("double").alias("label"), weight.alias("weight"), VECTOR)
        .coalesce(max(1, math.ceil(rows / FIT_ROWS)))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        # Balanced weights add up to the row count, so both penalties are 1 / (C * n).
        penalty = 1.0 / (INVERSE_PENALTY * rows)
        fit = inheritable_thread_target(train.sparkSession)(lambda weighted: _logistic(penalty, weighted).fit(frame))
        with ThreadPool(2) as pool:
            fits = pool.map(fit, (True, False), chunksize=1)
    finally:
        frame.unpersist()
    operational, calibrated = (PipelineModel([*stages, fit]) for fit in fits)
    return TrainedModels(operational, calibrated, prep)


def preprocessing_stages(prep: Preprocessor) -> list:
    """Standardise and encode in one SQL projection, then assemble the vector.

    A null feature (a customer without a countable item has no item price) counts as the
    training mean, which is 0 on the model's scale.
    """
    scaled = []
    for name in NUMERIC_FEATURES:
        scale = prep.deviations[name] or 1.0
        z = f"(CAST({name} AS DOUBLE) - {prep.means[name]!r}D) / {scale!r}D"
        scaled.append(f"COALESCE({z}, 0D) AS z_{name}")
    dummies = []
    for i, level in enumerate(prep.state_levels):
        text = level.replace("\\", "\\\\").replace("'", "\\'")
        dummies.append(f"CAST(COALESCE({STATE} = '{text}', false) AS DOUBLE) AS z_state_{i}")
    projection = SQLTransformer(statement=f"SELECT *, {', '.join(scaled + dummies)} FROM __THIS__")
    return [projection, VectorAssembler(inputCols=_vector_inputs(prep), outputCol=VECTOR)]


def _vector_inputs(prep: Preprocessor) -> list[str]:
    states = range(len(prep.state_levels))
    return [f"z_{n}" for n in NUMERIC_FEATURES] + [f"z_state_{i}" for i in states]


def coefficients(model: PipelineModel, prep: Preprocessor) -> list[tuple[str, float]]:
    """(feature, coefficient) in model order."""
    return list(zip(prep.feature_names, model.stages[-1].coefficients.toArray().tolist()))


def model_coefficients(spark, models: TrainedModels) -> DataFrame:
    """Both models' intercepts and coefficients (a few dozen rows)."""
    rows = []
    for kind, model in (("operational", models.operational), ("calibrated", models.calibrated)):
        rows.append((kind, "(intercept)", float(model.stages[-1].intercept)))
        rows += [(kind, f, c) for f, c in coefficients(model, models.preprocessor)]
    return spark.createDataFrame(rows, "model string, feature string, coefficient double")


def feature_importance(spark, model: PipelineModel, prep: Preprocessor) -> DataFrame:
    """Features by absolute coefficient, with odds ratios and their direction."""
    rows = [
        (f, c, math.exp(c), abs(c), "raises" if math.exp(c) >= 1.0 else "protects")
        for f, c in coefficients(model, prep)
    ]
    return spark.createDataFrame(
        rows,
        "feature string, coefficient double, odds_ratio double, abs_impact double, direction string",
    ).orderBy(F.col("abs_impact").desc(), "feature")


def by_odds_ratio(importance: DataFrame) -> DataFrame:
    """The importance table from the most protective feature to the one that raises churn most."""
    return importance.orderBy("odds_ratio", "feature")


def fitted_moments(train: DataFrame, models: TrainedModels) -> DataFrame:
    """(model, feature, fitted, labelled): weighted sums that a right fit makes equal.

    The loss is strictly convex, so a fit is right exactly if for every feature z of weight b
    ``sum(w * p * z) + b / C`` equals ``sum(w * y * z)``, and ``sum(w * p)`` equals ``sum(w * y)``.
    Both sides come out over the number of rows. Two passes over ``train``, which should be stored.
    """
    prep = models.preprocessor
    weights = fit_summary(train.select("churn")).weights()
    balanced = F.when(F.col("churn") == 1, F.lit(weights.get(1))).otherwise(F.lit(weights.get(0)))
    projection = preprocessing_stages(prep)[0]
    scored = score(projection.transform(train), *models.scorecards())
    inputs = _vector_inputs(prep)
    kinds = {
        "operational": (models.operational, F.col("operational_score"), balanced),
        "calibrated": (models.calibrated, F.col("calibrated_prob"), F.lit(1.0)),
    }
    cells = []
    for kind, (model, probability, weight) in kinds.items():
        betas = model.stages[-1].coefficients.toArray().tolist()
        terms = [("(intercept)", F.lit(1.0), 0.0)]
        terms += [(f, F.col(z), beta) for f, z, beta in zip(prep.feature_names, inputs, betas)]
        for name, z, beta in terms:
            fitted = F.sum(weight * probability * z) + F.lit(beta / INVERSE_PENALTY)
            cells.append(
                F.struct(
                    F.lit(kind).alias("model"),
                    F.lit(name).alias("feature"),
                    (fitted / F.count("*")).alias("fitted"),
                    (F.sum(weight * F.col("churn") * z) / F.count("*")).alias("labelled"),
                )
            )
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def as_scorecard(model: PipelineModel, prep: Preprocessor) -> Scorecard:
    """A fitted model as a formula over the raw features."""
    values = dict(coefficients(model, prep))
    return Scorecard(
        intercept=float(model.stages[-1].intercept),
        terms=tuple(
            NumericTerm(n, prep.means[n], prep.deviations[n] or 1.0, values[n])
            for n in NUMERIC_FEATURES
        ),
        state_effects=tuple((s, values[f"{STATE}_{s}"]) for s in prep.state_levels),
    )


def _logistic(penalty: float, weighted: bool) -> LogisticRegression:
    estimator = LogisticRegression(
        featuresCol=VECTOR,
        labelCol="label",
        probabilityCol="probability",
        regParam=penalty,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MAX_ITERATIONS,
        tol=TOLERANCE,
    )
    return estimator.setWeightCol("weight") if weighted else estimator
