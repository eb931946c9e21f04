"""Standardisation moments, state dummies and class weights, fitted on a frame."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators.features import NUMERIC_FEATURES

STATE = "customer_state"
MAX_CELLS = 10_000


@dataclass(frozen=True)
class Preprocessor:
    """Fitted means and deviations per numeric feature, and the kept state levels."""

    means: dict[str, float]
    deviations: dict[str, float]
    state_levels: tuple[str, ...]

    @property
    def feature_names(self) -> list[str]:
        return list(NUMERIC_FEATURES) + [f"{STATE}_{s}" for s in self.state_levels]


@dataclass(frozen=True)
class Moments:
    """Number, mean and sum of squared deviations of some values; two of them merge exactly."""

    n: int = 0
    mean: float = 0.0
    squares: float = 0.0

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not other.n or not self.n:
            return other if other.n else self
        gap = other.mean - self.mean
        mean = self.mean + gap * other.n / n
        return Moments(n, mean, self.squares + other.squares + gap * gap * self.n * other.n / n)


@dataclass(frozen=True)
class FitSummary:
    """All that the fits need of their rows: one small cell per (state, class), from one pass."""

    features: tuple[str, ...]
    cells: tuple[tuple[str | None, int | None, int, tuple[Moments, ...]], ...]

    def moments(self) -> dict[str, Moments]:
        """Of each feature over all rows; null values do not count."""
        total = [Moments()] * len(self.features)
        for *_, cell in self.cells:
            total = [a.merged(b) for a, b in zip(total, cell)]
        return dict(zip(self.features, total))

    def levels(self) -> dict[str | None, int]:
        """Rows per state, in order of the state."""
        return self._rows(0)

    def classes(self) -> dict[int | None, int]:
        return self._rows(1)

    def _rows(self, at: int) -> dict:
        counts: dict = {}
        for cell in self.cells:
            counts[cell[at]] = counts.get(cell[at], 0) + cell[2]
        return dict(sorted(counts.items(), key=lambda kv: (kv[0] is None, kv[0])))

    def weights(self) -> dict[int | None, float]:
        """Balanced weight n / (classes * n_c) per class."""
        counts = self.classes()
        total = sum(counts.values())
        return {k: total / (len(counts) * n) for k, n in counts.items()}


def fit_summary(df: DataFrame) -> FitSummary:
    """One aggregate over ``df``: row counts and moments by (state, class), merged across partitions.

    States and classes are few; beyond ``MAX_CELLS`` pairs the column is no category, and an error says so.
    Columns that ``df`` lacks are left out.
    """
    features = tuple(n for n in NUMERIC_FEATURES if n in df.columns)
    state = F.col(STATE) if STATE in df.columns else F.lit(None).cast("string")
    label = F.col("churn") if "churn" in df.columns else F.lit(None).cast("int")
    sums = [F.count("*").alias("_n")]
    for k, name in enumerate(features):
        value = F.col(name).cast("double")
        sums += [F.count(value).alias(f"_c{k}"), F.avg(value).alias(f"_m{k}"), F.var_pop(value).alias(f"_v{k}")]
    rows = df.groupBy(state.alias("_state"), label.alias("_label")).agg(*sums).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} pairs of {STATE} and churn: not a category")

    def cell(r: Row, k: int) -> Moments:
        n = r[f"_c{k}"]
        return Moments(n, r[f"_m{k}"], r[f"_v{k}"] * n) if n else Moments()

    rows.sort(key=lambda r: repr((r["_state"], r["_label"])))  # merged in the same order every time
    return FitSummary(
        features,
        tuple((r["_state"], r["_label"], r["_n"], tuple(cell(r, k) for k in range(len(features)))) for r in rows),
    )


def scaler_moments(df: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each numeric feature, one row each."""
    found = fit_summary(df).moments()
    rows = [(f, m.mean if m.n else None, math.sqrt(m.squares / m.n) if m.n else None) for f, m in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, std double")


def state_levels(df: DataFrame) -> DataFrame:
    """The states seen, in order, with the first one marked as the dropped level."""
    found = fit_summary(df).levels()
    rows = [(state, n, k == 0) for k, (state, n) in enumerate(found.items())]
    return df.sparkSession.createDataFrame(rows, f"{STATE} string, customers long, is_dropped boolean")


def one_hot_state(df: DataFrame, levels: Sequence[str]) -> list[Column]:
    """0/1 columns for the kept levels; any other state is all zeros."""
    return [
        F.coalesce((F.col(STATE) == level).cast("double"), F.lit(0.0)).alias(f"{STATE}_{level}")
        for level in levels
    ]


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight n / (classes * n_c) per class."""
    found = fit_summary(df.select("churn"))
    weights = found.weights()
    rows = [(k, n, weights[k]) for k, n in found.classes().items()]
    return df.sparkSession.createDataFrame(rows, "churn int, n long, weight double")


def fit_preprocessor(df: DataFrame) -> Preprocessor:
    """Means, deviations and kept levels of ``df``."""
    return preprocessor_of(fit_summary(df))


def preprocessor_of(summary: FitSummary) -> Preprocessor:
    moments = summary.moments()
    levels = [s for s in summary.levels() if s is not None]
    # A feature that no row has would have no moments; it then carries no information.
    known = {n: moments.get(n, Moments()) for n in NUMERIC_FEATURES}
    return Preprocessor(
        means={n: m.mean for n, m in known.items()},
        deviations={n: math.sqrt(m.squares / m.n) if m.n else 0.0 for n, m in known.items()},
        state_levels=tuple(levels[1:]),
    )
