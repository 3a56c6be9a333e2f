"""Pair groups as a one-pass reader closes them.

Such a reader resolves a group once its position (ref_hi, pos_hi) has been passed by a completed pair, inclusive, and
right after adding it. In set terms: of a key's pairs in order of completion, those whose later mate starts before pos_hi
share segment 0. A pair that starts at pos_hi or after closes its own group; the first such one joins segment 0 only if no
pair of any key completed before it on that reference at pos_hi or after; each further one is alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pairs are counted by blocks of completion order, so that no window spans a whole reference.
BLOCK = 1 << 14


def with_segments(pairs: DataFrame, key: list[str]) -> DataFrame:
    """pairs with their segment, part of the key when groups close as in a stream."""
    # Latest completion so far on a reference: reads arrive in order of position, so the running maximum of later_pos is
    # that of the latest completed pair. Block maxima first, then inside blocks.
    blocks = pairs.withColumn("block", F.floor(F.col("id2") / BLOCK))
    tops = blocks.groupBy("later_ref", "block").agg(F.max("later_pos").alias("top"))
    over_blocks = Window.partitionBy("later_ref").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.withColumn("earlier", F.max("top").over(over_blocks)).drop("top")
    within = Window.partitionBy("later_ref", "block").orderBy("id2").rowsBetween(Window.unboundedPreceding, -1)
    seen = blocks.withColumn("inside", F.max("later_pos").over(within)).join(earlier, ["later_ref", "block"])
    passed = seen.withColumn("passed", F.coalesce(F.greatest("inside", "earlier"), F.lit(-1 << 62)))
    closing = passed.withColumn("closes", (F.col("later_pos") >= F.col("pos_hi")) & (F.col("later_ref") == F.col("ref_hi")))
    first = closing.where("closes").groupBy(*key).agg(F.min("id2").alias("first_close"))
    joined = closing.join(first, key, "left")
    joins = ~F.col("closes") | ((F.col("id2") == F.col("first_close")) & (F.col("passed") < F.col("pos_hi")))
    return joined.withColumn("segment", F.when(joins, F.lit(0)).otherwise(F.col("id2") + 1)).select(*pairs.columns, "segment")
