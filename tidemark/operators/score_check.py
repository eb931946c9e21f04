"""The contract of scores: known, and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("operational_score", "calibrated_prob")


def bad_scores(df: DataFrame, names: Sequence[str] = SCORES) -> dict[str, int]:
    """Rows per column whose score is null, NaN or outside 0 to 1. One pass, one row."""
    bad = [
        F.count_if(~F.coalesce(F.col(n).between(0, 1) & ~F.isnan(n), F.lit(False))).alias(n)
        for n in names
    ]
    return df.agg(*bad).first().asDict()


def require_scores(df: DataFrame, names: Sequence[str] = SCORES) -> None:
    """Refuse a frame with such rows: a metric over the others would be of fewer customers."""
    found = {name: count for name, count in bad_scores(df, names).items() if count}
    if found:
        raise ValueError(f"scores that are null, NaN or outside 0 to 1: {found}")


def checked_score(name: str) -> Column:
    """The score; one that is null, NaN or outside 0 to 1 ends the query, without a pass of its own."""
    return F.expr(f"if({name} >= 0 AND {name} <= 1, {name}, raise_error('a {name} is null, NaN or outside 0 to 1'))")


def checked_label(name: str = "churn") -> Column:
    """The label; one that is neither 0 nor 1 ends the query."""
    return F.expr(f"if({name} IN (0, 1), {name}, raise_error('a {name} is neither 0 nor 1'))")
