"""An exact stratified hold-out split that never sorts the whole table.

Within each class the rows with the smallest ``md5(id || seed)`` form the test
set, as many as the class quota says. The hash of the last test row is found
from prefix counts; applying it is then a plain predicate, so the split itself
moves no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SnapshotConfig

PREFIX_HEX = 4  # 65,536 hash prefixes: the most rows per class any window orders


def stratified_split(df: DataFrame, labels: DataFrame, cfg: SnapshotConfig) -> DataFrame:
    """Add ``is_test`` to ``df``. ``labels`` holds the same ids with their ``churn``."""
    cuts = F.broadcast(split_cuts(labels, cfg))  # one row per class
    order = F.struct(_hash(cfg).alias("h"), F.col("customer_unique_id").alias("id"))
    return (
        df.join(cuts, "churn", "left")
        .withColumn("is_test", F.coalesce(order <= F.col("_cut"), F.lit(False)))
        .drop("_cut")
    )


def class_quotas(labels: DataFrame, cfg: SnapshotConfig) -> DataFrame:
    """Per class: its size ``n`` and the number of test rows ``n_test``.

    Train rows are dealt out by largest remainder and the test set is the rest.
    """
    everything = Window.partitionBy()  # over one row per class
    counts = labels.groupBy("churn").agg(F.count("*").alias("n"))
    total = F.sum("n").over(everything)
    train_total = total - F.ceil(total * F.lit(cfg.test_fraction))
    exact = F.col("n") * train_total / total
    shared = counts.withColumn("_whole", F.floor(exact)).withColumn(
        "_rest", exact - F.floor(exact)
    ).withColumn("_train_total", train_total)
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col("churn")))
    spare = F.col("_train_total") - F.sum("_whole").over(everything)
    train = F.col("_whole") + (rank <= spare).cast("long")
    return shared.select("churn", "n", (F.col("n") - train).alias("n_test"))


def split_cuts(labels: DataFrame, cfg: SnapshotConfig) -> DataFrame:
    """Per class the largest (hash, id) that still belongs to the test set."""
    hashed = labels.select(
        "churn", "customer_unique_id", _hash(cfg).alias("_h")
    ).withColumn("_p", F.substring("_h", 1, PREFIX_HEX))
    quotas = class_quotas(labels, cfg)
    by_prefix = hashed.groupBy("churn", "_p").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("churn").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cut_prefix = (
        by_prefix.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .join(F.broadcast(quotas), "churn")
        .where(
            (F.col("_before") < F.col("n_test"))
            & (F.col("_before") + F.col("_n") >= F.col("n_test"))
        )
        .select("churn", "_p", (F.col("n_test") - F.col("_before")).alias("_wanted"))
    )
    place = F.row_number().over(
        Window.partitionBy("churn", "_p").orderBy("_h", "customer_unique_id")
    )
    return (
        hashed.join(F.broadcast(cut_prefix), ["churn", "_p"])  # one prefix per class
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_wanted"))
        .select("churn", F.struct(F.col("_h").alias("h"), F.col("customer_unique_id").alias("id")).alias("_cut"))
    )


def _hash(cfg: SnapshotConfig) -> Column:
    return F.md5(F.concat(F.col("customer_unique_id").cast("string"), F.lit(str(cfg.seed))))
