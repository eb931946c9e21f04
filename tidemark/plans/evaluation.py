"""The evaluation suite of one scored hold-out set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import calibration as cal
from tidemark.operators import classification as cls
from tidemark.operators import deciles as dec
from tidemark.operators import ranking as rank
from tidemark.operators.score_check import require_scores

# curve -> the view whose scores it runs through
CURVES = {"roc": "churn", "pr_churn": "churn", "pr_active": "active"}


def evaluate(df: DataFrame, threshold: float = 0.50, n_deciles: int = 10) -> dict[str, DataFrame]:
    """Every metric family as its own frame.

    ``df`` has customer_unique_id, churn, operational_score, calibrated_prob and
    is read several times: pass a stored or cached table. Scores that are null, NaN
    or outside 0 to 1 are refused with their count.
    """
    require_scores(df)
    ranked = rank.ranked_scores(df)
    matrix = cls.confusion_matrix(df, threshold)
    return {
        "confusion_matrix": matrix,
        "classification_report": cls.classification_report(matrix),
        "test_counts": cls.eval_counts(df),
        "ranking": rank.summary_of(ranked),
        "calibration": cal.calibration(df),
        "calibration_bins": cal.calibration_bins(df),
        "decile_lift": dec.decile_lift(dec.decile_counts(df, n_deciles=n_deciles)),
        "curves": curve_samples(ranked),
    }


def roc_auc(df: DataFrame) -> DataFrame:
    """ROC-AUC of the operational and the calibrated score, one row each."""
    summary = rank.ranking_summary(df, ["churn", "churn_calibrated"])
    return summary.select(
        F.expr("if(view = 'churn', 'operational_score', 'calibrated_prob') AS score_name"),
        "roc_auc",
    )


def dual_average_precision(df: DataFrame) -> DataFrame:
    """Average precision, prevalence and lift of the churn and the active class."""
    summary = rank.ranking_summary(df, ["churn", "active"])
    return summary.select(
        F.col("view").alias("class"), "average_precision", "prevalence", "relative_lift"
    )


def full_curve(df: DataFrame, curve: str) -> DataFrame:
    return curve_points(rank.ranked_scores(df, [CURVES[curve]]), curve)


def curve_points(ranked: DataFrame, curve: str) -> DataFrame:
    build = rank.roc_points if curve == "roc" else rank.pr_points
    return build(ranked, CURVES[curve])


def downsampled_curves(df: DataFrame, max_points: int = rank.CURVE_POINTS) -> DataFrame:
    """All three curves of a frame of scores, each cut to at most ``max_points`` points."""
    return curve_samples(rank.ranked_scores(df, sorted(set(CURVES.values()))), max_points)


def curve_samples(ranked: DataFrame, max_points: int = rank.CURVE_POINTS) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            rank.downsample(curve_points(ranked, c), max_points).select(
                F.lit(c).alias("curve"), "point_no", "x", "y"
            )
            for c in CURVES
        ],
    )


def metrics_tidy(frames: dict[str, DataFrame]) -> DataFrame:
    """The scalar metrics as one (section, metric, value) table."""

    def melt(section: str, frame: DataFrame, prefix: Column | None, names: list[str]) -> DataFrame:
        cells = F.array(
            *[
                F.struct(
                    (F.concat(prefix, F.lit(f".{n}")) if prefix is not None else F.lit(n)).alias(
                        "metric"
                    ),
                    F.col(n).cast("double").alias("value"),
                )
                for n in names
            ]
        )
        return frame.select(F.lit(section).alias("section"), F.inline(cells))

    parts = [
        melt("confusion_matrix", frames["confusion_matrix"], None, ["tn", "fp", "fn", "tp"]),
        melt(
            "test_counts",
            frames["test_counts"],
            None,
            ["total_test", "churn_count", "active_count"],
        ),
        melt(
            "ranking",
            frames["ranking"],
            F.col("view"),
            ["roc_auc", "average_precision", "prevalence", "relative_lift"],
        ),
        melt(
            "calibration",
            frames["calibration"],
            F.col("score_name"),
            ["brier_score", "ece", "mean_score"],
        ),
        melt(
            "classification_report",
            frames["classification_report"],
            F.col("class"),
            ["precision", "recall", "f1_score", "support"],
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def metrics_document(frames: dict[str, DataFrame]) -> dict:
    """The nested metrics payload. Collects a few hundred rows at most.

    Its keys are fixed values: those of the published document.
    """
    views = {r["view"]: r for r in frames["ranking"].collect()}
    cal_rows = {r["score_name"]: r for r in frames["calibration"].collect()}
    curves: dict[str, tuple[list, list]] = {c: ([], []) for c in CURVES}
    for r in frames["curves"].orderBy("curve", "point_no").collect():
        curves[r["curve"]][0].append(r["x"])
        curves[r["curve"]][1].append(r["y"])
    report = {}
    for r in frames["classification_report"].collect():
        if r["class"] == "accuracy":
            report["accuracy"] = r["f1_score"]
        else:
            report[r["class"]] = {
                "precision": r["precision"],
                "recall": r["recall"],
                "f1-score": r["f1_score"],
                "support": r["support"],
            }

    def pr_section(name: str, curve: str) -> dict:
        return {
            "pr_auc": views[name]["average_precision"],
            "baseline_prevalence": views[name]["prevalence"],
            "pr_curve": {"recall": curves[curve][0], "precision": curves[curve][1]},
        }

    calibrated, operational = cal_rows["calibrated_prob"], cal_rows["operational_score"]
    return {
        "discrimination": {
            "roc_auc_operational": views["churn"]["roc_auc"],
            "roc_auc_calibrated": views["churn_calibrated"]["roc_auc"],
            "roc_curve": {"fpr": curves["roc"][0], "tpr": curves["roc"][1]},
        },
        "calibration": {
            "brier_score_calibrated": calibrated["brier_score"],
            "brier_score_operational": operational["brier_score"],
            "ece_calibrated": calibrated["ece"],
            "ece_operational": operational["ece"],
            "mean_calibrated_prob": calibrated["mean_score"],
            "mean_operational_score": operational["mean_score"],
        },
        "dual_pr_auc": {
            "churn_class_1": pr_section("churn", "pr_churn"),
            "active_class_0": {
                **pr_section("active", "pr_active"),
                "relative_lift_over_baseline": views["active"]["relative_lift"],
            },
        },
        "classification_report": report,
        "confusion_matrix": frames["confusion_matrix"].first().asDict(),
        "decile_lift": [
            r.asDict() for r in frames["decile_lift"].orderBy("cum_customer_pct").collect()
        ],
        "test_counts": frames["test_counts"].first().asDict(),
    }
