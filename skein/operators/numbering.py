"""Consecutive numbers for the rows of a table, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from skein.sources.shared import written

PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """df with a column name: start + 1, start + 2, .. in that order. Rows are dealt to ranges of the order; a range's
    numbers begin after the counts of those before it. One row a range goes to one task."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, "numbered")
    part = F.shiftright("_at", PLACE_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(counts), part == F.col("_part"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn(name, F.lit(start + 1) + F.col("_before") + place).select(*(c for c in df.columns if c != name), name)
