"""tidemark: point-in-time customer retention analytics on Spark DataFrames."""

from tidemark.config import SnapshotConfig
from tidemark.sources.tables import Tables

__all__ = ["SnapshotConfig", "Tables"]
