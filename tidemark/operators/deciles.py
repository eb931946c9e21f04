"""Decile lift of the active class, exact for ties of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prefix import ordered_prefix
from tidemark.operators.score_check import checked_label, checked_score

EPSILON = 1e-9
# The columns of the report's decile table, in their published order.
REPORT_COLUMNS = (
    "decile",
    "customers",
    "active_count",
    "active_rate",
    "cum_active_capture_pct",
    "lift",
    "cum_lift",
)
TIE_HEX = 3  # a tie is split in up to 4,096 parts by the hash of the id


def decile_counts(
    df: DataFrame,
    score: str = "operational_score",
    n_deciles: int = 10,
    tie_order: str | None = None,
) -> DataFrame:
    """Customers and active customers per decile; decile 1 is the most active-looking.

    Distinct scores are placed by prefix totals. A tie that lies within one
    decile is counted as a whole. Only ties cut by a decile border, at most
    ``n_deciles - 1`` of them, are ordered row by row: by ``tie_order``, a numeric column with
    another value in every row, such as a position in the input, or else by md5 of the id.
    """
    rows = df.select(
        F.col("customer_unique_id") if tie_order is None else F.col(tie_order).alias("_place"),
        (F.lit(1.0) - checked_score(score)).alias("propensity"),
        (1 - checked_label()).cast("long").alias("active"),
    )
    ties = rows.groupBy("propensity").agg(
        F.count("*").alias("customers"), F.sum("active").alias("active_count")
    )
    # Ranks count from the highest propensity down.
    placed = ordered_prefix(ties, "propensity", ["customers"]).withColumn(
        "ahead", F.expr("customers_total - customers_before - customers")
    )
    total = F.col("customers_total")
    placed = placed.withColumns(
        {
            "first_decile": _decile(F.col("ahead") + 1, total, n_deciles),
            "last_decile": _decile(F.col("ahead") + F.col("customers"), total, n_deciles),
        }
    )
    cut = F.col("first_decile") < F.col("last_decile")
    whole = placed.where(~cut).select(
        F.col("first_decile").alias("decile_no"), "customers", "active_count"
    )
    splitter = _split_ties if tie_order is None else _split_ties_in_order
    split = splitter(rows, placed.where(cut), n_deciles)
    return (
        whole.unionByName(split)
        .groupBy("decile_no")
        .agg(F.sum("customers").alias("customers"), F.sum("active_count").alias("active_count"))
    )


def decile_lift(counts: DataFrame) -> DataFrame:
    """The lift table of ``decile_no, customers, active_count`` rows (one per decile)."""
    upto = Window.orderBy("decile_no").rowsBetween(Window.unboundedPreceding, 0)
    everyone = Window.partitionBy()
    all_active = F.sum("active_count").over(everyone)
    all_customers = F.sum("customers").over(everyone)
    baseline = all_active / all_customers + F.lit(EPSILON)
    cum_active = F.sum("active_count").over(upto)
    cum_customers = F.sum("customers").over(upto)
    active_rate = F.col("active_count") / F.col("customers")
    return counts.select(
        F.concat(F.lit("D"), F.col("decile_no").cast("string")).alias("decile"),
        "customers",
        "active_count",
        active_rate.alias("active_rate"),
        cum_active.alias("cum_active_count"),
        (cum_active / (all_active + F.lit(EPSILON)) * 100.0).alias("cum_active_capture_pct"),
        (cum_customers / all_customers * 100.0).alias("cum_customer_pct"),
        (active_rate / baseline).alias("lift"),
        (cum_active / cum_customers / baseline).alias("cum_lift"),
    )


def decile_table(lift: DataFrame) -> DataFrame:
    """The columns of ``decile_lift`` that the report shows."""
    return lift.select(*REPORT_COLUMNS)


def _decile(rank: Column, total: Column, n_deciles: int) -> Column:
    """Bin of a rank when 1..total is cut at evenly spaced quantiles, in integers."""
    span = F.greatest(total - 1, F.lit(1))
    reached = F.ceil((rank - 1) * F.lit(n_deciles) / span)
    return F.greatest(reached, F.lit(1)).cast("int")


def _split_ties(rows: DataFrame, cut: DataFrame, n_deciles: int) -> DataFrame:
    """Decile counts of the ties that a border cuts, ordered by (md5, id)."""
    few = cut.select("propensity", "ahead", "customers_total")
    hashed = (
        # At most n_deciles - 1 ties contain a border.
        rows.join(F.broadcast(few), "propensity")
        .withColumn("_h", F.md5(F.col("customer_unique_id").cast("string")))
        .withColumn("_part", F.substring("_h", 1, TIE_HEX))
    )
    ahead = (
        Window.partitionBy("propensity").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = (
        hashed.groupBy("propensity", "_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_skip", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .select("propensity", "_part", "_skip")
    )
    place = F.row_number().over(
        Window.partitionBy("propensity", "_part").orderBy("_h", "customer_unique_id")
    )
    ranked = (
        hashed.withColumn("_place", place)
        .join(F.broadcast(parts), ["propensity", "_part"])  # <= ties * 4,096 rows
        .withColumn("_rank", F.col("ahead") + F.col("_skip") + F.col("_place"))
    )
    return (
        ranked.groupBy(_decile(F.col("_rank"), F.col("customers_total"), n_deciles).alias("decile_no"))
        .agg(F.count("*").alias("customers"), F.sum("active").alias("active_count"))
    )


def _split_ties_in_order(rows: DataFrame, cut: DataFrame, n_deciles: int) -> DataFrame:
    """Decile counts of the ties that a border cuts, ordered by ``_place``.

    Places run through prefix totals, one order per tie, so a tie of any size is spread.
    """
    few = cut.select("propensity", "ahead", "customers_total")
    # At most n_deciles - 1 ties contain a border.
    tied = rows.join(F.broadcast(few), "propensity").withColumn("_one", F.lit(1).cast("long"))
    within = ordered_prefix(tied, "_place", ["_one"], by=["propensity"])
    rank = F.col("ahead") + F.col("_one_before") + 1
    return within.groupBy(_decile(rank, F.col("customers_total"), n_deciles).alias("decile_no")).agg(
        F.count("*").alias("customers"), F.sum("active").alias("active_count")
    )
