"""Fragment groups over a growing table of reads, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.marking import FRAGMENT_KEY, fragment_groups


def follow_fragment_groups(spark: SparkSession, reads: str, schema, checkpoint: str, out: str) -> DataFrame:
    """Adds what is new in a folder of reads (operators.marking.keyed_reads, as Parquet) to the groups' state, which outlives
    restarts, and writes the groups that changed under out, a folder a batch. Gives the latest row of each group."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = fragment_groups(spark.readStream.schema(schema).parquet(reads))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    changed = spark.read.parquet(out)
    rest = [x for x in changed.columns if x not in (*FRAGMENT_KEY, "batch")]
    return changed.groupBy(*FRAGMENT_KEY).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*FRAGMENT_KEY, "last.*")
