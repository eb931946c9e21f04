"""Running totals over a global order without a global window.

A window that orders a whole table and has no partition key moves every row to
one task. Here a value's place in the order is split in two: its cell, and its place
within the cell. Totals are prefix-summed per level, so no step sorts more than that:

* cells:  at most ``CELLS`` rows per order, the only input to a window without a key;
* values: windowed by cell, spread over all tasks.

Cells are nearly equi-depth: ``COARSE`` quantiles of the values, from Spark's
mergeable quantile sketch, each cut into ``FINE`` even cells. Values may lie in any
range, however narrow, and spread alike. The bounds enter the plan as literals, so the
cell of a value is a pure function of that value: recomputing a lost partition always
reproduces the same cells.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

COARSE = 256
FINE = 256
CELLS = (COARSE + 2) * FINE
ACCURACY = 4 * COARSE  # of the quantiles: a coarse cell holds at most about half as many values again as the average
MAX_ORDERS = 100  # orders side by side, each with its own bounds in the plan
CELL = "_cell"

# Bounds of the coarse cells by the key of each order; () where there is one order.
Splits = Mapping[tuple, Sequence[float]]


def equi_depth_splits(groups: DataFrame, value: str, by: Sequence[str] = ()) -> Splits:
    """Quantiles of the values of each order: one job, one small row per order.

    Infinite values and NaN have no place between bounds; they fall in the end cells.
    """
    shares = [k / COARSE for k in range(COARSE + 1)]
    finite = F.when(F.abs(F.col(value)) < float("inf"), F.col(value).cast("double"))
    sketch = F.percentile_approx(finite, shares, ACCURACY).alias("_bounds")
    rows = groups.groupBy(*by).agg(sketch).limit(MAX_ORDERS + 1).collect()
    if len(rows) > MAX_ORDERS:
        raise ValueError(f"over {MAX_ORDERS} orders side by side in {list(by)}")
    return {tuple(r[c] for c in by): sorted(set(r["_bounds"] or ())) for r in rows}


def even_splits(low: float, high: float) -> Splits:
    """One coarse cell of even fine cells, for one order whose range is known and has few distinct values."""
    return {(): [low, high]}


def ordered_prefix(
    groups: DataFrame,
    value: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    splits: Splits | None = None,
) -> DataFrame:
    """Add, per measure ``m``, its total over smaller values and over all values.

    ``groups`` holds one row per distinct, non-null ``value`` (aggregate first:
    that folds any heavily repeated value into a single row). Adds ``m_before``
    and ``m_total``. ``by`` runs separate orders side by side; it must have few
    distinct values. Without ``splits`` the groups are read once more to find them:
    pass stored groups, or splits, where that is dear.
    """
    placed = in_cells(groups, value, by, splits)
    return prefix_totals(placed, value, measures, by).drop(CELL)


def in_cells(
    groups: DataFrame,
    value: str,
    by: Sequence[str] = (),
    splits: Splits | None = None,
) -> DataFrame:
    """Place every value in its cell and bring each cell together.

    ``splits`` (default: equi-depth ones) only spread the cells; any splits give exact results.
    """
    splits = equi_depth_splits(groups, value, by) if splits is None else splits
    placed = groups.withColumn(CELL, F.lit(0))
    for key, bounds in splits.items():
        own = None
        for c, k in zip(by, key):
            own = F.col(c).eqNullSafe(k) if own is None else own & F.col(c).eqNullSafe(k)
        placed = _with_cell(placed, value, bounds, own)
    # coalesce marks the cells as never null: joins on them then add no filter of
    # their own, and every branch over the same groups can reuse one exchange.
    return placed.withColumn(CELL, F.coalesce(CELL, F.lit(0))).repartition(*by, CELL)


def _with_cell(df: DataFrame, value: str, bounds: Sequence[float], own: Column | None) -> DataFrame:
    """Set the cell of the rows that ``own`` holds for (all if None)."""
    if not bounds:
        return df
    number = F.col(value).cast("double")
    edges = [-math.inf, *bounds, math.inf]
    # Per coarse cell its lower edge and how many cells a unit of value crosses; the end ones are one cell each.
    scales = [FINE / (b - a) if 0 < b - a < math.inf else 0.0 for a, b in zip(edges, edges[1:])]
    scales = [s if s < math.inf else 0.0 for s in scales]
    lows = [b if math.isfinite(b) else 0.0 for b in edges[:-1]]
    bucketizer = Bucketizer(splits=edges, inputCol="_number", outputCol="_bucket", handleInvalid="keep")
    found = bucketizer.transform(df.withColumn("_number", number))
    # NaN has the bucket behind the last one.
    bucket = F.least(F.col("_bucket").cast("int"), F.lit(len(scales) - 1))

    def of_bucket(values: list[float]) -> Column:
        # A text that folds into one literal; hundreds of literals would slow every planning step.
        text = ",".join(map(repr, values))
        return F.element_at(F.expr(f"CAST(split('{text}', ',') AS ARRAY<DOUBLE>)"), bucket + 1)

    within = F.floor((F.col("_number") - of_bucket(lows)) * of_bucket(scales))
    cell = bucket * FINE + F.greatest(F.least(within, F.lit(FINE - 1)), F.lit(0)).cast("int")
    chosen = cell if own is None else F.when(own, cell).otherwise(F.col(CELL))
    return found.withColumn(CELL, chosen).drop("_number", "_bucket")


def prefix_totals(
    placed: DataFrame, value: str, measures: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``ordered_prefix`` over rows that ``in_cells`` has placed."""
    offsets = _cell_offsets(placed, measures, by)
    ahead = _ahead(Window.partitionBy(*by, CELL).orderBy(value))
    local = placed.select("*", *[_sum(m, ahead).alias(f"_local_{m}") for m in measures])
    kept = [c for c in placed.columns if c not in by and c != CELL]
    # At most CELLS rows per order are broadcast, whatever the size of the input.
    return local.join(F.broadcast(offsets), [*by, CELL]).select(
        *by,
        CELL,
        *kept,
        *[F.expr(f"_local_{m} + _offset_{m} AS {m}_before") for m in measures],
        *[F.col(f"_total_{m}").alias(f"{m}_total") for m in measures],
    )


def previous_fields(
    placed: DataFrame, value: str, fields: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``previous_<f>``: the fields of the next smaller value, null for the smallest.

    The first value of a cell looks at the last value of the occupied cell before it.
    """
    record = F.struct(*fields)
    tails = placed.groupBy(*by, CELL).agg(F.max_by(record, F.col(value)).alias("_tail"))
    back = tails.select(*by, CELL, F.lag("_tail").over(Window.partitionBy(*by).orderBy(CELL)).alias("_back"))
    local = placed.withColumn(
        "_lag", F.lag(record).over(Window.partitionBy(*by, CELL).orderBy(value))
    )
    kept = [c for c in placed.columns if c not in by and c != CELL]
    # At most CELLS rows per order are broadcast.
    return local.join(F.broadcast(back), [*by, CELL]).select(
        *by,
        CELL,
        *kept,
        *[F.expr(f"coalesce(_lag, _back).{f} AS previous_{f}") for f in fields],
    )


def exact_median(df: DataFrame, value: str, splits: Splits | None = None) -> DataFrame:
    """One row, one column ``median``: the exact median of a column, null if empty.

    Repeated values fold into (value, count); the one or two middle values are
    then found by their running counts, so no task holds all distinct values.
    """
    folded = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.expr("count(*) AS n"))
    placed = ordered_prefix(folded, value, ["n"], splits=splits)
    lower, upper = "(n_total + 1) div 2", "n_total div 2 + 1"
    middle = placed.where(
        f"({lower} > n_before AND {lower} <= n_before + n)"
        f" OR ({upper} > n_before AND {upper} <= n_before + n)"
    )
    return middle.agg(F.expr(f"(min({value}) + max({value})) / 2 AS median"))


def _ahead(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def _sum(measure: str, window: WindowSpec):
    return F.coalesce(F.sum(measure).over(window), F.lit(0))


def _cell_offsets(placed: DataFrame, measures: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per occupied cell: total ahead of it, and the grand total."""
    cells = placed.groupBy(*by, CELL).agg(*[F.sum(m).alias(m) for m in measures])
    everything = Window.partitionBy(*by)
    ahead = _ahead(everything.orderBy(CELL))
    return cells.select(
        *by,
        CELL,
        *[_sum(m, ahead).alias(f"_offset_{m}") for m in measures],
        *[F.sum(m).over(everything).alias(f"_total_{m}") for m in measures],
    )
