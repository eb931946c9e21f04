"""Calibration metrics: Brier score, expected calibration error, mean scores.

Scores that are no probabilities and unknown labels end in an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.score_check import checked_label, checked_score

SCORES = ("calibrated_prob", "operational_score")


def bin_edges(n_bins: int = 10) -> list[float]:
    """n_bins + 1 evenly spaced doubles from 0 to 1, rounded as step * i rounds."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_of(score: Column, n_bins: int = 10) -> Column:
    """Index of the half-open bin [edge, next edge); out of range goes to the end bins.

    The score is compared with the edges themselves: floor(score * n_bins) would
    put 0.3, 0.6 and 0.7 one bin too high.
    """
    inner = bin_edges(n_bins)[1:-1]
    return reduce(lambda n, edge: n + (score >= F.lit(edge)).cast("int"), inner, F.lit(0))


def calibration_bins(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Per score and occupied bin: rows, mean label, mean score."""
    return _binned(df, n_bins).select(
        "score_name",
        "bin",
        "rows",
        F.expr("labels / rows AS mean_label"),
        F.expr("scores / rows AS mean_score"),
    )


def expected_calibration_error(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Row-weighted gap between mean label and mean score, per score."""
    return calibration(df, n_bins).select("score_name", "ece")


def calibration(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Per score: Brier score, calibration error and mean, from one scan."""
    gap = "rows * abs(labels / rows - scores / rows)"
    return (
        _binned(df, n_bins)
        .groupBy("score_name")
        .agg(
            F.expr("sum(squares) / sum(rows) AS brier_score"),
            F.expr(f"sum({gap}) / sum(rows) AS ece"),
            F.expr("sum(scores) / sum(rows) AS mean_score"),
        )
    )


def _binned(df: DataFrame, n_bins: int) -> DataFrame:
    """Sums per score and bin; at most ``n_bins`` rows per score."""
    known = df.select(checked_label().alias("churn"), *[checked_score(s).alias(s) for s in SCORES])
    both = ", ".join(f"named_struct('score_name', '{s}', 'score', {s})" for s in SCORES)
    long = known.select("churn", F.expr(f"inline(array({both}))"))
    return long.groupBy("score_name", bin_of(F.col("score"), n_bins).alias("bin")).agg(
        F.expr("count(*) AS rows"),
        F.expr("sum(churn) AS labels"),
        F.expr("sum(score) AS scores"),
        F.expr("sum((score - churn) * (score - churn)) AS squares"),
    )
