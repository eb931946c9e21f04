"""Threshold metrics of a labelled, scored frame (columns churn, operational_score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.score_check import checked_label, checked_score

# Report row names, in report order.
ACTIVE_CLASS = "Active (0)"
CHURN_CLASS = "Churn (1)"


def confusion_matrix(df: DataFrame, threshold: float = 0.50) -> DataFrame:
    """One row tn, fp, fn, tp; a score equal to the threshold predicts churn.

    Every row counts in one cell: scores that are no probabilities and unknown labels end in an error.
    """
    predicted = checked_score("operational_score") >= F.lit(threshold)
    actual = checked_label() == 1
    return df.agg(
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    )


def confusion_table(matrix: DataFrame) -> DataFrame:
    """The matrix as a 2x2 table, one row per actual class."""
    rows = F.array(
        F.struct(
            F.lit(ACTIVE_CLASS).alias("actual"),
            F.col("tn").alias("predicted_active"),
            F.col("fp").alias("predicted_churn"),
        ),
        F.struct(
            F.lit(CHURN_CLASS).alias("actual"),
            F.col("fn").alias("predicted_active"),
            F.col("tp").alias("predicted_churn"),
        ),
    )
    return matrix.select(F.inline(rows))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Five report rows from the four counts; an empty ratio counts as 0.

    The accuracy row repeats the accuracy in every column.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    ratios = matrix.select(
        *_class_scores("a", tn, tn + fn, tn + fp),
        *_class_scores("c", tp, tp + fp, tp + fn),
        _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
    )

    def averaged(kind: str, a_weight: Column, c_weight: Column) -> Column:
        means = [
            (F.col(f"a_{m}") * a_weight + F.col(f"c_{m}") * c_weight).alias(m)
            for m in ("precision", "recall", "f1_score")
        ]
        support = (F.col("a_support") + F.col("c_support")).alias("support")
        return F.struct(F.lit(kind).alias("class"), *means, support)

    def single(kind: str, tag: str) -> Column:
        names = ("precision", "recall", "f1_score", "support")
        return F.struct(F.lit(kind).alias("class"), *[F.col(f"{tag}_{m}").alias(m) for m in names])

    total = F.col("a_support") + F.col("c_support")
    accuracy = F.struct(
        F.lit("accuracy").alias("class"),
        *[F.col("accuracy").alias(m) for m in ("precision", "recall", "f1_score", "support")],
    )
    rows = F.array(
        single(ACTIVE_CLASS, "a"),
        single(CHURN_CLASS, "c"),
        accuracy,
        averaged("macro avg", F.lit(0.5), F.lit(0.5)),
        averaged("weighted avg", _ratio(F.col("a_support"), total), _ratio(F.col("c_support"), total)),
    )
    return ratios.select(F.inline(rows))


def eval_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_test"),
        F.count_if(F.col("churn") == 1).alias("churn_count"),
        F.count_if(F.col("churn") == 0).alias("active_count"),
    )


def _class_scores(tag: str, hit: Column, predicted: Column, actual: Column) -> list[Column]:
    # F1 straight from the counts: 2 * hit / (predicted + actual).
    return [
        _ratio(hit, predicted).alias(f"{tag}_precision"),
        _ratio(hit, actual).alias(f"{tag}_recall"),
        _ratio(hit * 2.0, predicted + actual).alias(f"{tag}_f1_score"),
        actual.alias(f"{tag}_support"),
    ]


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
