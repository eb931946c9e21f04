"""Session settings the plans count on, sized from the data."""

from __future__ import annotations

SHUFFLE_TASK_BYTES = 256 * 1024 * 1024
SCAN_TASK_BYTES = 256 * 1024 * 1024
MIN_PARTITIONS = 200


def cluster_settings(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Spark options for a run whose widest shuffle moves ``shuffled_bytes``.

    Partitions are sized to fit a task's memory and are never fewer than the
    cores; adaptive execution merges the small ones and splits the skewed ones.
    """
    by_size = -(-shuffled_bytes // SHUFFLE_TASK_BYTES)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_TASK_BYTES),
        "spark.sql.shuffle.partitions": str(max(MIN_PARTITIONS, cores, by_size)),
        "spark.sql.files.maxPartitionBytes": str(SCAN_TASK_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }
