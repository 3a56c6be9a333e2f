"""Exact deduplication by a stateful stream.

A streaming aggregation keyed by the digest of the normalised text keeps, on disk (RocksDB) and without expiry, the
stable identifier and the content's locator (file and row) of the best copy so far, and the number of copies. It takes
its input from a table of digests in the shared folder, as files arrive, and resumes from its checkpoint. Partial
aggregation comes before its shuffle, so a group of copies of any size sends one row a task.

Every hit is then checked on full bytes: texts of digests seen more than once are read at their locators and grouped
by (digest, text), with equal ones merged before the shuffle. A digest with several texts (a collision) falls apart into
a group for each.

Defined results: texts are equal when equal without white space (the six characters of [\\x20\\x09-\\x0D]); a null text
counts as empty. Of equal texts the one with the most code points stays, then the smallest id, null ids last, then the
first locator; rows repeated with the same id are rows of their own, of which one at most stays. An empty table gives an
empty table; extra columns, whatever their names, are carried by `deduplicate` and ignored by `exact_groups`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, temporary

#: State on disk, with logs of changes for checkpoints, and no more open at once than there are tasks.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark in WHITE:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def has_files(df: DataFrame) -> bool:
    """Whether df's rows can be located in files."""
    try:
        df.select(*places(df)).schema
    except AnalysisException:
        return False
    return True


def places(df: DataFrame) -> list[Column]:
    """The locator (file, row) of each row of df, which has files. Columns of df, whatever their names, do not hide it."""
    found = df.metadataColumn("_metadata")
    return [found["file_path"].alias("file"), found["row_index"].alias("row")]


def without(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of df, which has files, whose locators are not among the dropped (file, row)."""
    whole = df.select(F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("whole"), *places(df))
    return whole.join(dropped, ["file", "row"], "left_anti").select("whole.*")


def stream_groups(spark: SparkSession, digests: str, schema: str, checkpoint: str, out: str, files_per_batch: int | None = None) -> DataFrame:
    """Feed what is new in the folder of digests to the stream, and give each digest's state: (digest, best, copies)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rank = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")
    state = reader.parquet(digests).groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("copies"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    changes = spark.read.schema("digest string, best struct<size:bigint, unnamed:boolean, doc_id:bigint, file:string, row:bigint>, copies bigint, batch bigint").parquet(out)
    if len({x.batch for x in changes.select("batch").distinct().collect()}) <= 1:  # one row a batch
        return changes.drop("batch")
    return changes.groupBy("digest").agg(F.max_by(F.struct("best", "copies"), "batch").alias("last")).select("digest", "last.best", "last.copies")


def exact_groups(df: DataFrame, text: str = "text", key: str = "doc_id", digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """A row for each row of df: (doc_id, keep_id, group_size, kept, text_sha256, file, row)."""
    spark = df.sparkSession
    source = df if has_files(df) else materialize(df.select(key, text), "dedup-content")
    located = source.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *places(source))
    body = normalised(F.col("text"))
    schema = "doc_id bigint, size bigint, digest string, sha string, file string, row bigint"
    digests = scratch(spark, "dedup-digests")
    rows = located.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("size"), digest(body).alias("digest"), sha256(body).alias("sha"), "file", "row")
    if digest is sha256:
        rows, schema = rows.drop("sha"), schema.replace("sha string, ", "")
    rows.write.option("compression", "zstd").parquet(digests)
    rows = spark.read.schema(schema).parquet(digests)
    if digest is sha256:
        rows = rows.withColumn("sha", F.col("digest"))
    groups = materialize(stream_groups(spark, digests, schema, scratch(spark, "dedup-stream"), scratch(spark, "dedup-state"), files_per_batch), "dedup-groups")

    # The check of full bytes: one row for each text of each digest that was hit.
    hits = rows.join(groups.where("copies > 1").select("digest"), "digest", "left_semi").select("file", "row", "digest")
    hits = materialize(hits, "dedup-hits")
    # By sorting and merging at every size: hits grow with the table.
    contents = located.select("file", "row", body.alias("body")).join(hits.hint("merge"), ["file", "row"]).groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    collided = materialize(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-collisions")
    if not collided.isEmpty():
        again = located.select("file", "row", body.alias("body"))
        texts = again.join(hits.join(collided, "digest", "left_semi"), ["file", "row"]).select("file", "row", F.concat("digest", F.lit("/"), F.col("body")).alias("split"))
        rows = materialize(rows.join(texts, ["file", "row"], "left").withColumn("digest", F.coalesce("split", "digest")).drop("split"), "dedup-split")
        rank = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")
        groups = groups.join(collided, "digest", "left_anti").unionByName(rows.where(F.contains("digest", F.lit("/"))).groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("copies")))

    # Digests of one copy need no partner; the others may be hot, and their rows are narrow: joined, never gathered.
    best = groups.where("copies > 1").select("digest", "best", "copies")
    found = rows.join(best, "digest", "left")
    kept = F.col("best").isNull() | ((F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row")))
    return found.select("doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "file", "row")


def dedup_report(df: DataFrame) -> DataFrame:
    return exact_groups(df).drop("file", "row")


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df, all columns, that stay."""
    source = df if has_files(df) else materialize(df, "dedup-input")
    path = scratch(df.sparkSession, "dedup-dropped")
    with temporary(df.sparkSession):
        dropped = materialize(exact_groups(source, text, key).where(~F.col("kept")).select("file", "row"), "dedup-dropped", path)
    return without(source, dropped)
