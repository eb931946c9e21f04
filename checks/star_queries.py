"""One callable per operator: (spark, sf_dir) -> DataFrame over the whole tables.

Frames that a query reads more than once are stored first in the shared work
folder; everything else is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.scorecards import CALIBRATED, OPERATIONAL, SCORE_DIGITS
from tidemark.functions.columns import round_half_even
from tidemark.operators import calibration, classification, deciles, features, labels
from tidemark.operators import preprocess, tiers
from tidemark.operators.orders import validated_orders
from tidemark.operators.scorecard import score
from tidemark.operators.split import class_quotas, stratified_split
from tidemark.plans import audits, evaluation, reports, training
from tidemark.plans.run import run
from tidemark.plans.work import stored, work_folder
from tidemark.sinks import writers
from tidemark.sources.positions import POSITION, with_position
from tidemark.sources.readers import load_models, load_tables, read_high_risk_csv, read_metrics, read_scored
from tidemark.sources.rejects import Intake, by_table, load_sound
from tidemark.sources.schemas import TABLE_COLUMNS
from tidemark.sources.star_schema import STAR_CONFIG as CFG
from tidemark.sources.star_schema import star_tables
from tidemark.sources.tables import Tables

KEY = "customer_unique_id"
# Float sums depend on order in the last bits, so reports are rounded: ratios to
# nine digits, means of large amounts to four.
REPORT_DIGITS = 9
AMOUNT_DIGITS = 4
MOMENT_TOLERANCE = 1e-5
REPEATED_COLUMNS = (KEY, "target_orders_count", "churn", "frequency_orders", "frequency_items", "distinct_categories", "review_count", "delivered_count")

# Where records of the CSV shop are made unsound, and by what text.
UNSOUND = {
    ("orders", "order_purchase_timestamp"): ("order_id % 13 = 0", "some day"),
    ("order_items", "price"): ("order_id % 17 = 0 AND order_item_id = 2", "12,50 or so"),
    ("payments", "payment_value"): ("order_id % 19 = 0 AND payment_installments = 1", 'about "9"'),
    ("reviews", "review_score"): ("order_id % 23 = 0", "five\nof five"),
}

RUN_CHECKS = (
    "negative_recency",
    "tenure_below_recency",
    "purchase_after_snapshot",
    "order_after_snapshot",
    "review_after_snapshot",
    "differs_from_tables_as_of_snapshot",
    "label_not_binary",
    "label_disagrees_with_count",
    "duplicate_customer",
    "cohort_features_mismatch",
    "operational_out_of_range",
    "calibrated_out_of_range",
    "tier_disagrees",
    "export_not_above_threshold",
    "export_not_high",
)

Query = Callable[[SparkSession, str], DataFrame]


# ---- shared inputs ---------------------------------------------------------


def base(spark: SparkSession, sf: str, with_label: bool = True) -> DataFrame:
    """Per-customer totals, stored once: the features and their median both read them."""
    totals = features.feature_base(star_tables(spark, sf), CFG, with_label)
    return stored(totals, work_folder(spark), "base")


def csv_folder(spark: SparkSession, sf: str, unsound: Mapping[tuple[str, str], tuple[str, str]] = {}) -> str:
    """The whole shop written as CSV files; parts and suppliers as side tables.

    ``unsound`` maps (table, column) to a condition and the text that stands there instead.
    """
    shop, folder = star_tables(spark, sf), work_folder(spark)
    sides = {"products": "part", "sellers": "supplier"}
    for table, columns in TABLE_COLUMNS.items():
        if table in sides:
            frame = spark.read.parquet(f"{sf}/{sides[table]}.parquet")
        else:
            frame = getattr(shop, table)
        if frame is None:
            continue
        unknown = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in frame.columns}
        frame = frame.withColumns(unknown) if unknown else frame
        for (spoilt, column), (where, text) in unsound.items():
            if spoilt == table:
                frame = frame.withColumn(column, F.when(F.expr(where), text).otherwise(F.col(column).cast("string")))
        frame.write.option("header", True).csv(f"{folder}/{table}.csv")
    return folder


def csv_tables(spark: SparkSession, sf: str) -> Tables:
    return load_tables(spark, csv_folder(spark, sf), "csv")


def unsound_intake(spark: SparkSession, sf: str) -> Intake:
    """The shop as CSV files with planted records that do not parse, taken in."""
    return load_sound(spark, csv_folder(spark, sf, UNSOUND), work_folder(spark))


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled feature table."""
    return features.finish_features(base(spark, sf), CFG)


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return labels.cohort_labels(star_tables(spark, sf), CFG)


def split_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled feature table with is_test."""
    totals = base(spark, sf)
    labelled = features.finish_features(totals, CFG)
    return stratified_split(labelled, totals.select(KEY, "churn"), CFG)


def split_cohort(spark: SparkSession, sf: str) -> DataFrame:
    labelled = stored(cohort(spark, sf).select(KEY, "churn"), work_folder(spark), "cohort")
    return stratified_split(labelled, labelled, CFG)


def train_set(spark: SparkSession, sf: str) -> DataFrame:
    return split_dataset(spark, sf).where(~F.col("is_test"))


def with_scores(df: DataFrame) -> DataFrame:
    raw = score(df, OPERATIONAL, CALIBRATED)
    return raw.withColumns(
        {
            c: round_half_even(F.col(c), SCORE_DIGITS)
            for c in ("operational_score", "calibrated_prob")
        }
    )


def scored_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return with_scores(dataset(spark, sf))


def scores_with_split(spark: SparkSession, sf: str) -> DataFrame:
    """Label, both scores and is_test of every customer."""
    scored = with_scores(split_dataset(spark, sf))
    return scored.select(KEY, "churn", "operational_score", "calibrated_prob", "is_test")


def test_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Label and both scores of the hold-out."""
    return scores_with_split(spark, sf).where("is_test").drop("is_test")


def stored_test_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The hold-out as a stored table, for metrics that read it several times."""
    return stored(test_scores(spark, sf), work_folder(spark), "test_scores")


def stored_split(spark: SparkSession, sf: str) -> DataFrame:
    return stored(split_dataset(spark, sf), work_folder(spark), "split")


def scored_table(spark: SparkSession, sf: str) -> DataFrame:
    """The published table. The rank table re-derives the scores from the stored totals."""
    return tiers.scored_customers(scored_dataset(spark, sf), CFG)


def rounded(df: DataFrame, *names: str, digits: int = REPORT_DIGITS) -> DataFrame:
    return df.withColumns({n: round_half_even(F.col(n), digits) for n in names})


def on_tables(operator: Callable, *args) -> Query:
    return lambda spark, sf: operator(star_tables(spark, sf), *args)


# ---- queries that need more than one line ----------------------------------


def q_scaler_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(preprocess.scaler_moments(train_set(spark, sf)), "mean", "std", digits=AMOUNT_DIGITS)


def q_state_levels(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.state_levels(stored_split(spark, sf).where(~F.col("is_test")))


def q_one_hot_state(spark: SparkSession, sf: str) -> DataFrame:
    """Dummies of the levels that the training split shows."""
    df = stored_split(spark, sf)
    prep = preprocess.fit_preprocessor(df.where(~F.col("is_test")))
    return df.select(KEY, "customer_state", *preprocess.one_hot_state(df, prep.state_levels))


def q_standardized(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset's model inputs on the scale of the training split."""
    df = stored_split(spark, sf)
    moments = preprocess.scaler_moments(df.where(~F.col("is_test"))).collect()  # 21 rows
    scaled = [
        round_half_even((F.col(m["feature"]) - m["mean"]) / (m["std"] or 1.0), 6).alias(m["feature"])
        for m in moments
    ]
    return df.select(KEY, *scaled)


def q_fixed_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored_dataset(spark, sf).select(
        KEY, "churn", "operational_score", "calibrated_prob"
    )


def q_model_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    train = stored_split(spark, sf).where(~F.col("is_test"))
    return training.model_coefficients(spark, training.train_models(train))


def q_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    train = stored_split(spark, sf).where(~F.col("is_test"))
    models = training.train_models(train)
    return training.feature_importance(spark, models.operational, models.preprocessor)


def q_model_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The labels' sums per model and feature, and whether the fit meets them.

    A solver stops near the solution, so its side is held to a tolerance, not rounded.
    """
    train = stored_split(spark, sf).where(~F.col("is_test"))
    moments = training.fitted_moments(train, training.train_models(train))
    met = F.abs(F.col("fitted") - F.col("labelled")) <= MOMENT_TOLERANCE
    return rounded(moments, "labelled", digits=6).withColumn("met", met).drop("fitted")


def q_odds_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """The importance table in the order of the odds-ratio chart."""
    return training.by_odds_ratio(q_feature_importance(spark, sf))


def q_trained_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer scored by both fitted models."""
    split = stored_split(spark, sf)
    models = training.train_models(split.where(~F.col("is_test")))
    return score(split, *models.scorecards()).select(
        KEY, "churn", "is_test", "operational_score", "calibrated_prob"
    )


def q_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = evaluation.full_curve(stored_test_scores(spark, sf), "roc")
    return curve.select("point_no", F.col("x").alias("fpr"), F.col("y").alias("tpr"))


def pr_query(curve: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        points = evaluation.full_curve(stored_test_scores(spark, sf), curve)
        return points.select("point_no", F.col("x").alias("recall"), F.col("y").alias("precision"))

    return query


def q_decile_lift(spark: SparkSession, sf: str) -> DataFrame:
    return deciles.decile_lift(deciles.decile_counts(stored_test_scores(spark, sf)))


def q_decile_lift_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of one digit, so that borders cut ties: these follow the customers' place in their file."""
    placed = with_position(spark.read.parquet(f"{sf}/customer.parquet"))
    test = test_scores(spark, sf).join(placed.select(F.col("c_name").alias(KEY), POSITION), KEY)
    coarse = test.withColumn("operational_score", round_half_even(F.col("operational_score"), 1))
    counts = deciles.decile_counts(stored(coarse, work_folder(spark), "placed_scores"), tie_order=POSITION)
    return deciles.decile_lift(counts)


def q_decile_table(spark: SparkSession, sf: str) -> DataFrame:
    return deciles.decile_table(q_decile_lift(spark, sf))


def q_metrics_tidy(spark: SparkSession, sf: str) -> DataFrame:
    frames = evaluation.evaluate(stored_test_scores(spark, sf))
    return rounded(evaluation.metrics_tidy(frames), "value")


def q_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    both = evaluation.dual_average_precision(stored_test_scores(spark, sf))
    return rounded(both, "average_precision", "prevalence", "relative_lift")


def q_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        calibration.calibration(test_scores(spark, sf)), "brier_score", "ece", "mean_score"
    )


def q_calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        calibration.calibration_bins(test_scores(spark, sf)), "mean_label", "mean_score"
    )


def q_risk_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.risk_tiers(scored_dataset(spark, sf), CFG).select(
        KEY, "operational_risk_score", "calibrated_churn_prob", "business_risk_tier"
    )


def q_risk_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return scored_table(spark, sf).select(KEY, "operational_risk_score", "risk_percentile")


def q_high_risk_files(spark: SparkSession, sf: str) -> DataFrame:
    """The export as it reads from its CSV files, made from the written scored table."""
    folder = work_folder(spark)
    writers.write_table(scored_table(spark, sf), f"{folder}/scored_customers")
    scored = read_scored(spark, f"{folder}/scored_customers")
    writers.write_high_risk_csv(tiers.high_risk_customers(scored, CFG), f"{folder}/high_risk")
    return read_high_risk_csv(spark, f"{folder}/high_risk", scored)


def q_tier_summary(spark: SparkSession, sf: str) -> DataFrame:
    tiered = tiers.risk_tiers(scored_dataset(spark, sf), CFG)
    return rounded(
        tiers.tier_summary(tiered),
        "avg_risk_score",
        "avg_calibrated_prob",
        "avg_spend",
        "avg_recency",
        "percentage",
        digits=AMOUNT_DIGITS,
    ).drop("tier_no")


def q_tier_profile(spark: SparkSession, sf: str) -> DataFrame:
    tiered = tiers.risk_tiers(scored_dataset(spark, sf), CFG)
    return rounded(
        reports.tier_profile(tiered),
        "share",
        "avg_recency",
        "avg_spend",
        "avg_review",
        digits=AMOUNT_DIGITS,
    )


def q_kpi_overview(spark: SparkSession, sf: str) -> DataFrame:
    raw = stored(scores_with_split(spark, sf), work_folder(spark), "scores")
    scored = raw.withColumn("actual_churn", F.col("churn"))
    return rounded(
        reports.kpi_overview(scored, raw.where("is_test")),
        "churn_rate",
        "active_rate",
        "roc_auc",
        "active_lift",
    )


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return reports.explore(scored_table(spark, sf), spend=(0.0, 500000.0), id_pattern="customer#0")


def q_explorer_count(spark: SparkSession, sf: str) -> DataFrame:
    tiered = tiers.risk_tiers(scored_dataset(spark, sf), CFG)
    found = reports.explore(tiered, spend=(0.0, 500000.0), id_pattern="customer#0")
    return reports.explorer_count(found)


def q_customer_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of the customer with the smallest id among the matches' tiers."""
    scored = stored(scored_table(spark, sf), work_folder(spark), "published")
    first = reports.explore(scored, spend=(0.0, 500000.0)).agg(F.min(KEY))
    profile = reports.customer_profile(scored, first)
    return rounded(profile, "top_percent")


def q_repeated_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and totals where every seventh order is listed twice: it still counts as one order."""
    shop = star_tables(spark, sf)
    again = shop.orders.where("order_id % 7 = 0")
    repeated = replace(shop, orders=shop.orders.unionByName(again))
    made = features.snapshot_features(repeated, CFG, CFG.review_fallback, with_label=True)
    return made.select(*REPEATED_COLUMNS)


def q_run_audits(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run into the work folder; its own audits, and checks of every file read back."""
    out = work_folder(spark)
    result = run(spark, star_tables(spark, sf), out, CFG)
    audits_back = spark.read.parquet(f"{out}/audits")
    document = read_metrics(spark, f"{out}/metrics")
    models = load_models(spark, f"{out}/models")
    scored = read_scored(spark, f"{out}/scored_customers")
    exported = read_high_risk_csv(spark, f"{out}/high_risk_customers", scored)
    dataset_back = spark.read.parquet(f"{out}/dataset")
    features = models["operational"].stages[-1].coefficients.size
    exported_rows = scored.where(F.col("operational_risk_score") > CFG.high_threshold).count()
    found = {
        "metrics_differ_from_run": int(document != result.metrics),
        "importance_without_a_feature": abs(models["importance"].count() - features),
        "models_differ_in_size": abs(models["calibrated"].stages[-1].coefficients.size - features),
        "listed_numeric_features": len(models["numerical_features"]),
        "dataset_and_scored_differ": abs(dataset_back.count() - scored.count()),
        "export_rows_missing": abs(exported.count() - exported_rows),
        "dataset_rows": dataset_back.count(),
        "dataset_churned": dataset_back.where("churn = 1").count(),
    }
    found |= {f"metrics_{k}": int(v) for k, v in document["test_counts"].items()}
    # Bounds on the metrics themselves belong to the shop's data and are left to the tests.
    own = audits_back.where(F.col("check_name").isin(*RUN_CHECKS))
    return own.unionByName(spark.createDataFrame(list(found.items()), audits_back.schema)).select(
        "check_name", F.col("violations").cast("long").alias("value")
    )


def q_leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    t = star_tables(spark, sf)
    made = stored(features.finish_features(base(spark, sf, False), CFG), work_folder(spark), "made")
    return audits.leakage_audit(t, made, CFG, folder=work_folder(spark))


def q_target_audit(spark: SparkSession, sf: str) -> DataFrame:
    t = star_tables(spark, sf)
    labelled = stored(labels.cohort_labels(t, CFG), work_folder(spark), "cohort")
    return audits.target_audit(labelled, features.logistics_features(t, CFG))


def q_scoring_audit(spark: SparkSession, sf: str) -> DataFrame:
    scored = stored(scored_table(spark, sf), work_folder(spark), "published")
    return audits.scoring_audit(scored, tiers.high_risk_customers(scored, CFG), CFG)


QUERIES: dict[str, Query] = {
    # preparation, cohort, label
    "validated_orders": on_tables(validated_orders),
    "cohort_labels": cohort,
    "label_summary": lambda s, d: labels.label_summary(cohort(s, d)),
    # features
    "rfm_features": on_tables(features.rfm_features, CFG),
    "item_features": on_tables(features.item_features, CFG),
    "review_features": on_tables(features.review_features, CFG),
    "logistics_features": on_tables(features.logistics_features, CFG),
    "payment_features": on_tables(features.payment_features, CFG),
    "snapshot_features": lambda s, d: features.finish_features(base(s, d, False), CFG),
    "snapshot_features_csv": lambda s, d: features.snapshot_features(csv_tables(s, d), CFG, folder=work_folder(s)),
    "intake_counts": lambda s, d: by_table(unsound_intake(s, d).counts),
    "intake_records": lambda s, d: unsound_intake(s, d).rejected.groupBy("table_name").agg(
        F.count("*").alias("records"),
        F.count_if(F.expr("record RLIKE 'some day|12,50 or so|about|(?s)five.of five'")).alias("whole_records"),
    ),
    "snapshot_features_sound": lambda s, d: features.snapshot_features(
        unsound_intake(s, d).tables, CFG, folder=work_folder(s)
    ),
    # dataset, split, preprocessing
    "modeling_dataset": dataset,
    "split_quotas": lambda s, d: class_quotas(cohort(s, d), CFG),
    "stratified_split": lambda s, d: split_cohort(s, d).select(KEY, "churn", "is_test"),
    "class_weights": lambda s, d: preprocess.class_weights(
        split_cohort(s, d).where(~F.col("is_test"))
    ),
    "scaler_moments": q_scaler_moments,
    "standardized_features": q_standardized,
    "state_levels": q_state_levels,
    "one_hot_state": q_one_hot_state,
    # models and scores
    "fixed_scores": q_fixed_scores,
    "model_coefficients": q_model_coefficients,
    "feature_importance": q_feature_importance,
    "trained_scores": q_trained_scores,
    "model_moments": q_model_moments,
    "odds_ratios": q_odds_ratios,
    # evaluation of the fixed scores on the hold-out
    "eval_counts": lambda s, d: classification.eval_counts(test_scores(s, d)),
    "confusion_matrix": lambda s, d: classification.confusion_matrix(test_scores(s, d)),
    "confusion_table": lambda s, d: classification.confusion_table(
        classification.confusion_matrix(test_scores(s, d))
    ),
    "classification_report": lambda s, d: rounded(
        classification.classification_report(classification.confusion_matrix(test_scores(s, d))),
        "precision",
        "recall",
        "f1_score",
        "support",
    ),
    "roc_auc": lambda s, d: rounded(
        evaluation.roc_auc(stored_test_scores(s, d)), "roc_auc"
    ),
    "average_precision": q_average_precision,
    "calibration": q_calibration,
    "calibration_bins": q_calibration_bins,
    "roc_curve": q_roc_curve,
    "pr_curve_churn": pr_query("pr_churn"),
    "pr_curve_active": pr_query("pr_active"),
    "curve_downsample": lambda s, d: evaluation.downsampled_curves(stored_test_scores(s, d)),
    "decile_lift": q_decile_lift,
    "decile_lift_in_order": q_decile_lift_in_order,
    "decile_table": q_decile_table,
    "metrics_tidy": q_metrics_tidy,
    # risk scoring
    "risk_tiers": q_risk_tiers,
    "risk_percentile": q_risk_percentile,
    "scored_customers": scored_table,
    "high_risk_files": q_high_risk_files,
    "high_risk_customers": lambda s, d: tiers.high_risk_customers(scored_table(s, d), CFG),
    "tier_summary": q_tier_summary,
    # reports
    "tier_profile": q_tier_profile,
    "kpi_overview": q_kpi_overview,
    "customer_explorer": lambda s, d: reports.explorer_page(matches(s, d)),
    "explorer_count": q_explorer_count,
    "explorer_ids": lambda s, d: reports.explorer_ids(matches(s, d)),
    "spend_bounds": lambda s, d: reports.spend_bounds(
        features.snapshot_features(star_tables(s, d), CFG, review_median=CFG.review_fallback)
    ),
    "customer_profile": q_customer_profile,
    "population_profile": on_tables(reports.population_profile, CFG),
    "late_review_audit": on_tables(reports.late_review_audit, CFG),
    "calibrated_tier_mix": lambda s, d: reports.calibrated_tier_mix(
        tiers.risk_tiers(scored_dataset(s, d), CFG), CFG
    ),
    # audits
    "repeated_orders": q_repeated_orders,
    "run_audits": q_run_audits,
    "key_audit": on_tables(audits.key_audit),
    "leakage_audit": q_leakage_audit,
    "target_audit": q_target_audit,
    "scoring_audit": q_scoring_audit,
}
