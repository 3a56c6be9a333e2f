"""Dense numbers in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def dense_ids(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df with record_id, dense from 0 in the given order: ranges are sorted and written, then numbered from the counts of
    the ranges before, of which there are as many as tasks."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    base, bases = 0, []
    for number, n in sorted(placed.groupBy(part.alias("part")).count().collect()):
        bases.append((number, base))
        base += n
    offsets = df.sparkSession.createDataFrame(bases, "part bigint, base bigint")
    return placed.join(F.broadcast(offsets), part == F.col("part")).withColumn("record_id", F.col("base") + at).drop("part", "base", "__at")


def in_coordinate_order(alignments: DataFrame) -> DataFrame:
    """alignments numbered anew by reference and position, unplaced ones last, ties in the order they came."""
    moved = alignments.withColumnRenamed("record_id", "__came")
    order = [F.col("ref_id").asc_nulls_last(), F.col("pos").asc_nulls_last(), F.col("__came").asc()]
    return dense_ids(moved, order).select(*alignments.columns)
