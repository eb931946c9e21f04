"""From raw documents to token ids: five stages, each by one operator of tidemark.llm.

Each stage takes the stored result of the one before as its documents. All but the last
return the columns of documents. Repeated rows of the third stage's result can only come
from the mix, which repeats documents of sources below their budget.

Defined results are those of the operators: null and empty texts pass every stage and end
as no ids; an empty table ends as an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dedup, pieces, pii, quality
from tidemark.llm.common import read_table, stored, text_of, work_folder

TOKENIZERS = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
SIMILAR = near_dedup.Threshold(80, 100)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learnt outside the held-out fold."""
    learnable = docs.where(~quality.held_out(F.col("doc_id")))
    model = quality.fit_quality(learnable, read_table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(docs, model) >= quality.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.drop_near_duplicates(docs, SIMILAR)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    # Bounds what a batch of texts takes in the JVM and in Python; results do not depend on it.
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    encoded = docs.select(
        "doc_id", "lang", "source", pieces.encode_checked(text_of("text"), model).alias("encoded")
    )
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("encoded.ids").cast("long").alias("n_tokens"),
        "encoded.ids",
        "encoded.round_trip",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_copies),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("encode", encode),
]

# Classifier, sketches and merges have no SQL form; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stored before the next."""
    folder = work_folder(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
