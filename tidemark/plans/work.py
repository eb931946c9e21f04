"""Store an intermediate table where every executor can read it again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """One temporary folder per process, removed at its end."""
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_folder(spark: SparkSession) -> str:
    """A new folder name below the one the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset, as in local tests, a temporary folder is used; the
    setting itself is never changed.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        folder = _local_folder()
    return f"{folder}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table once and read it back: short lineage, columnar, prunable."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def temporary_folder(spark: SparkSession) -> Iterator[str]:
    """A work folder that is removed when its results are written, also after a failure."""
    folder = work_folder(spark)
    try:
        yield folder
    finally:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
