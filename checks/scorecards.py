"""Fixed logistic formulas, so that every scoring and evaluation query has exact SQL.

Centres and scales are round figures near the star schema's feature moments; the
calibrated formula differs by its intercept only.
"""

from __future__ import annotations

from dataclasses import replace

from tidemark.operators.scorecard import NumericTerm, Scorecard

OPERATIONAL = Scorecard(
    intercept=0.1,
    terms=(
        NumericTerm("recency_days", 552.0, 453.0, 0.75),
        NumericTerm("tenure_days", 1244.0, 462.0, -0.35),
        NumericTerm("frequency_orders", 2.7, 1.5, -0.45),
        NumericTerm("total_spend", 583000.0, 380000.0, -0.2),
        NumericTerm("avg_review_score", 3.0, 0.95, -0.25),
        NumericTerm("credit_card_share", 0.33, 0.2, 0.1),
    ),
    state_effects=(("Other", 0.2), ("NATION_2", -0.15)),
)
CALIBRATED = replace(OPERATIONAL, intercept=1.27)
SCORE_DIGITS = 6
