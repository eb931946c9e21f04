"""Exact ranking metrics: ROC-AUC, average precision, ROC and PR curves.

A frame of scores is seen through one or more views. A view names the score that
ranks and the label that counts as positive. All metrics and curves come from one
stored table, ``ranked_scores``: one row per view and distinct score, so a score shared
by very many customers is one row, with the totals of all lower scores beside it. All
views go through the same ordered prefix together, and each metric is then a
filter, a projection or a small aggregate of that table.

Scores may lie in any range; a null or NaN score, or a null label, ends in an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.prefix import CELL, in_cells, prefix_totals, previous_fields
from tidemark.plans.work import stored, work_folder

CURVE_POINTS = 150
LIFT_EPSILON = "1e-9D"

# view -> (ranking score, positive label). The active class is ranked by 1 - score.
VIEWS = {
    "churn": ("operational_score", "churn"),
    "churn_calibrated": ("calibrated_prob", "churn"),
    "active": ("1D - operational_score", "1 - churn"),
}
MEASURES = ("pos", "neg", "one", "corner")


def score_groups(df: DataFrame, views: Sequence[str]) -> DataFrame:
    """One row per view and distinct score: positives ``pos`` and negatives ``neg``."""

    def usable(value: str, what: str) -> str:
        return f"if(nanvl({value}, NULL) IS NULL, raise_error('a {what} is null or NaN'), {value})"

    seen = ", ".join(
        f"named_struct('view', '{v}', 'score', {usable(f'double({VIEWS[v][0]})', 'score')},"
        f" 'y', bigint({usable(f'double({VIEWS[v][1]})', 'label')}))"
        for v in views
    )
    return (
        df.select(F.expr(f"inline(array({seen}))"))
        .groupBy("view", "score")
        .agg(F.expr("sum(y) AS pos"), F.expr("sum(1 - y) AS neg"))
    )


def ranked_scores(
    df: DataFrame, views: Sequence[str] = tuple(VIEWS), folder: str | None = None
) -> DataFrame:
    """Per view and distinct score its counts and the totals of lower scores, stored in ``folder``.

    Measures are pos, neg, one (distinct scores) and corner: 1 unless the score's step on the
    ROC curve equals the next lower one's. ``df`` is read once. ``folder`` is a new work folder by default.
    """
    folder = folder or work_folder(df.sparkSession)
    groups = stored(score_groups(df, views), folder, "score-groups")
    placed = in_cells(groups, "score", ["view"])
    steps = previous_fields(placed, "score", ["neg", "pos"], ["view"])
    # One row per view.
    tops = F.broadcast(groups.groupBy("view").agg(F.max("score").alias("_top")))
    bend = "previous_neg IS NULL OR previous_neg <> neg OR previous_pos <> pos OR score = _top"
    marked = steps.join(tops, "view").select(
        *placed.columns, F.expr("1L AS one"), F.expr(f"bigint({bend}) AS corner")
    )
    totals = prefix_totals(marked, "score", MEASURES, ["view"]).drop(CELL)
    return stored(totals, folder, "ranked-scores")


def ranking_summary(df: DataFrame, views: Sequence[str] = tuple(VIEWS)) -> DataFrame:
    """``summary_of`` for a frame of scores."""
    return summary_of(ranked_scores(df, views))


def summary_of(ranked: DataFrame) -> DataFrame:
    """Per view: roc_auc, average_precision, prevalence, relative_lift.

    ROC-AUC is the share of (positive, negative) pairs in the right order, ties
    counting half. Average precision sums, over thresholds, the recall gained
    times the precision there (steps, not trapezoids).
    """
    won = "sum(double(pos) * (neg_before + neg / 2D))"
    pairs = "double(max(pos_total)) * max(neg_total)"
    at_least = "double(pos_total - pos_before)"
    rows = "(pos_total - pos_before + neg_total - neg_before)"
    summary = ranked.groupBy("view").agg(
        F.expr(f"try_divide({won}, {pairs}) AS roc_auc"),
        F.expr(
            f"try_divide(sum(double(pos) * {at_least} / {rows}), max(pos_total))"
            " AS average_precision"
        ),
        F.expr(
            "try_divide(double(max(pos_total)), max(pos_total) + max(neg_total)) AS prevalence"
        ),
    )
    return summary.withColumn(
        "relative_lift", F.expr(f"average_precision / (prevalence + {LIFT_EPSILON})")
    )


def roc_points(ranked: DataFrame, view: str = "churn") -> DataFrame:
    """Points (point_no, x = fpr, y = tpr), from (0, 0) to (1, 1).

    A threshold on a straight stretch, whose step equals the next lower one, is
    left out; the highest and lowest threshold always stay.
    """
    corners = ranked.where(f"view = '{view}' AND corner = 1")
    # Counting from the top; the first corner also brings the origin along.
    point = _point(
        "corner_total - corner_before",
        "(neg_total - neg_before) / neg_total",
        "(pos_total - pos_before) / pos_total",
        "corner_total + 1",
    )
    origin = _point("0L", "0D", "0D", "corner_total + 1")
    is_first = "corner_before = corner_total - 1"
    return corners.select(
        F.expr(f"inline(if({is_first}, array({origin}, {point}), array({point})))")
    )


def pr_points(ranked: DataFrame, view: str) -> DataFrame:
    """Points (point_no, x = recall, y = precision), from recall 1 to the end point.

    One point per distinct score in ascending order, then (0, 1).
    """
    tp, fp = "(pos_total - pos_before)", "(neg_total - neg_before)"
    point = _point("one_before", f"{tp} / pos_total", f"{tp} / ({tp} + {fp})", "one_total + 1")
    end = _point("one_total", "0D", "1D", "one_total + 1")
    is_last = "one_before = one_total - 1"
    return ranked.where(f"view = '{view}'").select(
        F.expr(f"inline(if({is_last}, array({point}, {end}), array({point})))")
    )


def roc_curve(df: DataFrame, view: str = "churn") -> DataFrame:
    return roc_points(ranked_scores(df, [view]), view)


def pr_curve(df: DataFrame, view: str) -> DataFrame:
    return pr_points(ranked_scores(df, [view]), view)


def downsample(curve: DataFrame, max_points: int = CURVE_POINTS) -> DataFrame:
    """At most ``max_points`` evenly spaced points, both ends included.

    Point k stays when k = i * (n - 1) div (max_points - 1) for some whole i.
    The only candidate is the smallest i that reaches k, so this is a filter.
    """
    steps = max_points - 1
    reach = f"((point_no * {steps} + n_points - 2) div (n_points - 1))"
    return curve.where(
        f"n_points <= {max_points} OR ({reach} * (n_points - 1)) div {steps} = point_no"
    )


def _point(number: str, x: str, y: str, size: str) -> str:
    return f"named_struct('point_no', {number}, 'x', {x}, 'y', {y}, 'n_points', {size})"
