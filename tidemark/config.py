"""Settings of one snapshot run. Every cut-off, threshold and quota lives here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

# Defaults that published results were produced with.
DEFAULT_SNAPSHOT = datetime(2018, 2, 28, 23, 59, 59)
DEFAULT_TOP_STATES = ("SP", "RJ", "MG", "RS", "PR")
HIGH_RISK = "High Risk"
MEDIUM_RISK = "Medium Risk"
LOW_RISK = "Low Risk"
OTHER_STATE = "Other"


@dataclass(frozen=True)
class SnapshotConfig:
    """What "as of" means for a run, and how its scores are cut."""

    snapshot: datetime = DEFAULT_SNAPSHOT
    horizon_days: int = 180
    top_states: tuple[str, ...] = DEFAULT_TOP_STATES
    high_threshold: float = 0.70
    low_threshold: float = 0.30
    decision_threshold: float = 0.50
    test_fraction: float = 0.20
    seed: int = 42
    review_fallback: float = 4.0
    # A numeric column of orders, such as positions.with_position adds: "first" state and city then follow it.
    order_position: str | None = None

    @property
    def target_end(self) -> datetime:
        """Last instant of the label window (inclusive)."""
        return self.snapshot + timedelta(days=self.horizon_days)
