"""The end-to-end run: tables in, dataset, models, metrics and scored customers out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SnapshotConfig
from tidemark.operators.features import feature_base, finish_features
from tidemark.operators.scorecard import score
from tidemark.operators.score_check import require_scores
from tidemark.operators.split import stratified_split
from tidemark.operators.tiers import high_risk_customers, scored_customers, tier_summary
from tidemark.operators.labels import cohort_labels
from tidemark.plans.audits import (
    key_audit,
    leakage_audit,
    metric_checks,
    scoring_audit,
    target_audit,
)
from tidemark.plans.evaluation import evaluate, metrics_document, metrics_tidy
from tidemark.plans.training import feature_importance, train_models
from tidemark.plans.work import stored, temporary_folder
from tidemark.sinks import writers
from tidemark.sources.tables import Tables

KEY = "customer_unique_id"


@dataclass(frozen=True)
class RunResult:
    dataset: DataFrame
    scored: DataFrame
    tiers: DataFrame
    metrics: dict
    audits: DataFrame | None = None


def run(
    spark: SparkSession,
    tables: Tables,
    out_dir: str,
    cfg: SnapshotConfig | None = None,
    check_keys: bool = True,
    audit: bool = True,
) -> RunResult:
    """Run everything and write the results under ``out_dir``.

    ``audit`` adds a table of all checks, (check_name, violations), under ``audits``. It builds
    the features a second time, from the tables as of the snapshot.

    Each stage reads a stored table of the one before, so a lost executor costs
    the tasks it held and never a long lineage. The work tables are removed at the end.
    """
    with temporary_folder(spark) as folder:
        return _run(spark, tables, out_dir, cfg or SnapshotConfig(), check_keys, audit, folder)


def _run(
    spark: SparkSession,
    tables: Tables,
    out_dir: str,
    cfg: SnapshotConfig,
    check_keys: bool,
    audit: bool,
    folder: str,
) -> RunResult:
    if check_keys:
        # Orders that repeat count once; only repeated customers would make totals wrong.
        broken = key_audit(tables).where("violations > 0 AND check_name = 'duplicate_customer_id'").collect()
        if broken:
            raise ValueError(f"input keys repeat: {[r['check_name'] for r in broken]}")

    base = stored(feature_base(tables, cfg, with_label=True), folder, "base")
    dataset_path = f"{out_dir}/dataset"
    writers.write_table(finish_features(base, cfg), dataset_path)
    dataset = spark.read.parquet(dataset_path)

    split = stored(
        stratified_split(dataset, dataset.select(KEY, "churn"), cfg), folder, "split"
    )
    models = train_models(split.where(~F.col("is_test")))
    importance = feature_importance(spark, models.operational, models.preprocessor)
    writers.save_models(spark, models, importance, f"{out_dir}/models")

    scored_raw = stored(score(split, *models.scorecards()), folder, "scored")
    require_scores(scored_raw)
    test = scored_raw.where("is_test").select(KEY, "churn", "operational_score", "calibrated_prob")
    test = test.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Small frames, computed once: the document and the tidy table both read them.
        frames = {
            name: stored(frame, folder, f"metric-{name}")
            for name, frame in evaluate(test, cfg.decision_threshold).items()
        }
        document = metrics_document(frames)
        writers.write_metrics_document(spark, document, f"{out_dir}/metrics")
        writers.write_metrics_table(metrics_tidy(frames), f"{out_dir}/metrics_tidy")
    finally:
        test.unpersist()

    scored_path = f"{out_dir}/scored_customers"
    writers.write_lookup_table(scored_customers(scored_raw, cfg), scored_path, KEY)
    scored = spark.read.parquet(scored_path)
    high_risk = high_risk_customers(scored, cfg)
    writers.write_high_risk_csv(high_risk, f"{out_dir}/high_risk_customers")
    audits = _audits(spark, tables, dataset, scored, high_risk, document, out_dir, cfg, folder) if audit else None
    return RunResult(dataset, scored, tier_summary(scored), document, audits)


def _audits(
    spark: SparkSession,
    tables: Tables,
    dataset: DataFrame,
    scored: DataFrame,
    high_risk: DataFrame,
    document: dict,
    out_dir: str,
    cfg: SnapshotConfig,
    folder: str,
) -> DataFrame:
    """Every check of the run's own results, written and read back."""
    broken = [(name, 1) for name in metric_checks(document)]
    checks = (
        leakage_audit(tables, dataset, cfg, folder=folder)
        .unionByName(target_audit(cohort_labels(tables, cfg), dataset))
        .unionByName(scoring_audit(scored, high_risk, cfg))
        .unionByName(spark.createDataFrame(broken, "check_name string, violations long"))
    )
    writers.write_table(checks, f"{out_dir}/audits")
    return spark.read.parquet(f"{out_dir}/audits")
