"""Expressions and plan helpers that several operators share."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.work import stored, work_folder

__all__ = ["WORD", "packed", "read_table", "stored", "text_of", "tokenizer_file", "work_folder"]

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The column's text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(df: DataFrame) -> Column:
    """The whole input row as one struct, so that no column of it can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def tokenizer_file(name: str) -> str:
    """Place of a tokenizer's file, in TOKENIZER_FOLDER where that is set, else in the installed package."""
    folder = os.environ.get("TOKENIZER_FOLDER")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)
