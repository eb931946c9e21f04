"""Score customers with a logistic formula written as plain columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "customer_state"


@dataclass(frozen=True)
class NumericTerm:
    feature: str
    center: float
    scale: float
    coefficient: float


@dataclass(frozen=True)
class Scorecard:
    """intercept + sum of coefficient * (x - center) / scale + one state effect.

    A null x counts as its center.
    """

    intercept: float
    terms: tuple[NumericTerm, ...]
    state_effects: tuple[tuple[str, float], ...] = ()

    def probability(self) -> Column:
        """P(churn = 1). Stays in generated code: no vectors, no Python."""
        log_odds = reduce(lambda a, b: a + b, self._parts(), F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))

    def _parts(self) -> list[Column]:
        parts = []
        for term in self.terms:
            centred = F.col(term.feature).cast("double") - F.lit(term.center)
            # A constant feature has no scale and carries no information.
            unit = centred / F.lit(term.scale) if term.scale else centred
            parts.append(F.coalesce(unit, F.lit(0.0)) * F.lit(term.coefficient))
        if self.state_effects:
            effect = F
            for state, value in self.state_effects:
                effect = effect.when(F.col(STATE) == state, F.lit(value))
            parts.append(effect.otherwise(F.lit(0.0)))
        return parts


def score(df: DataFrame, operational: Scorecard, calibrated: Scorecard) -> DataFrame:
    """Add operational_score and calibrated_prob."""
    return df.withColumns(
        {
            "operational_score": operational.probability(),
            "calibrated_prob": calibrated.probability(),
        }
    )
