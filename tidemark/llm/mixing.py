"""Mix sources to target weights by budgets over a hash order.

Every document gets a hash-random key. Within its source, the documents stand
in key order; a running total of their sizes over that order is cut at the
source's budget. A budget above the source's size first takes whole epochs.

The running total is taken in two steps: the leading digits of the key make
``CELLS`` even cells per source, cell totals are summed over the cells, and the
rows over their own cell. A source with a third of all rows is spread over all
its cells; no window holds a whole source.

Defined results: a null text has size 0; null sources form one source, ordered
last; rows that repeat are separate rows; documents with equal keys follow their
id and size; an empty table gives no rows. A source without words has budget 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, packed, stored, work_folder

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 1
CELL_DIGITS = 3  # hexadecimal digits of the key: 4,096 cells per source
PLAN = ("size", "source_size", "target", "taken", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id and the columns of ``PLAN``.

    ``taken`` is exact: the document at the cut gives only the words up to it.
    ``copies`` counts whole documents: the one at the cut is taken whole.
    """
    narrow = docs.select(
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"),
    )
    narrow = stored(narrow, work_folder(docs.sparkSession), "sizes")
    planned = _planned(_keyed(narrow, seed), weights, max_repeat)
    return planned.select(F.col("_id").alias("doc_id"), *PLAN)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: int = SEED,
) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    Documents without words add nothing to any budget and stay once.
    """
    rows = docs.select(
        packed(docs),
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"),
    )
    planned = _planned(_keyed(rows, seed), weights, max_repeat)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    repeated = planned.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return repeated.select("_row.*")


def source_budgets(sized: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """One row per source: ``_skey``, source_size and target.

    ``sized`` has one row per source or more, with ``_skey``, ``_source``, ``_size``.
    All sources share the total size by weight. A source stops at ``max_repeat``
    times its size; what it leaves is shared by the others, by weight. In order of
    limit per weight, a source stops exactly if the level at which all before it
    have stopped lies above its limit. Windows here span one row per source.
    """
    everything = Window.partitionBy()
    by_source = everything.orderBy(F.col("_source").asc_nulls_last())
    by_limit = everything.orderBy("_ratio", "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per_source = sized.groupBy("_skey", "_source").agg(F.sum("_size").alias("source_size"))
    ranked = per_source.withColumn("_rank", F.row_number().over(by_source))
    listed = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    weighed = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("_total"),
        F.element_at(listed, (F.col("_rank") - 1) % len(weights) + 1).alias("_weight"),
        (F.col("source_size") * max_repeat).alias("_limit"),
    ).withColumn("_ratio", F.expr("CAST(_limit AS DOUBLE) / CAST(_weight AS DOUBLE)"))
    levels = weighed.select(
        "*",
        F.coalesce(F.sum("_limit").over(before), F.lit(0)).alias("_gone"),
        F.sum("_weight").over(onward).alias("_left"),
    ).withColumn("_stops", F.expr("(_total - _gone) * _weight > _limit * _left"))
    return levels.select(
        "*",
        F.sum(F.expr("IF(_stops, _limit, 0)")).over(everything).alias("_stopped"),
        F.sum(F.expr("IF(_stops, 0, _weight)")).over(everything).alias("_open"),
    ).select(
        "_skey",
        "source_size",
        F.expr(
            "IF(_stops, CAST(_limit AS DOUBLE), CAST((_total - _stopped) * _weight AS DOUBLE)"
            " / CAST(_open AS DOUBLE))"
        ).alias("target"),
    )


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(str(seed))))
    named = F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("n"))
    return rows.select("*", named.alias("_skey"), key.alias("_key")).withColumn(
        "_cell", F.substring("_key", 1, CELL_DIGITS)
    )


def _planned(keyed: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    cells = keyed.groupBy("_skey", "_source", "_cell").agg(F.sum("_size").alias("_size"))
    ahead = (
        Window.partitionBy("_skey").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = cells.select(
        "_skey", "_cell", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset")
    ).join(source_budgets(cells, weights, max_repeat), "_skey")
    within = (
        Window.partitionBy("_skey", "_cell")
        .orderBy("_key", "_id", "_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = keyed.withColumn("_local", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    placed = local.join(offsets, ["_skey", "_cell"]).select(
        "*",
        F.expr("_local + _offset").alias("_before"),
        F.expr("IF(source_size > 0, CAST(floor(target / source_size) AS BIGINT), 0)").alias("_epochs"),
    )
    rest = placed.withColumn("_rest", F.expr("CAST(floor(target) AS BIGINT) - _epochs * source_size"))
    return rest.select(
        "*",
        F.col("_size").alias("size"),
        F.expr("_epochs * _size + greatest(0L, least(_size, _rest - _before))").alias("taken"),
        F.expr("_epochs + IF(_before < _rest, 1L, 0L)").alias("copies"),
    )
