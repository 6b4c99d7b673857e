"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from skein.sources.shared import Scratch, delete, freed_shuffles, settings, shared_dir, work_path, written

__all__ = ["Scratch", "bounded_batches", "delete", "free_name", "freed_shuffles", "shared_dir", "small_batches", "work_path", "written"]


#: Rows and bytes of an Arrow batch: texts are long, and a batch is held several times over on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, "2m"


def bounded_batches(spark: SparkSession) -> None:
    """Sets how much goes to a Python worker at once, so that its memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bounded_batches for what runs within the block only."""
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS), spark__sql__execution__arrow__maxBytesPerBatch=BATCH_BYTES):
        yield


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores before it, such that df has no column of that name (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base
