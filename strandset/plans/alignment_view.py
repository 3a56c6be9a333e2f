"""Alignments derived from the lineitem table, for queries over tables that hold none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.sorting import dense_ids
from ..storage import exists, scratch

ORDER = ["ref_id", "pos", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
READ_GROUPS = [("A", "lib1", 0), ("N", "lib1", 0), ("R", None, 1), ("S", "lib2", 2)]
CONTIGS = [(0, "chr1"), (1, "chr2")]
# Fixed values of the view: CIGARs by discount, in hundredths, and barcodes by quantity.
CIGARS = {0: "2S98M", 1: "98M2S", 2: "50M100N50M", 3: "3H5S92M", 4: "50M2I48M", 5: "50M5D50M"}
BARCODES = {1: "AAAAAA", 2: "CCCCCC", 3: "aaaaaa", 4: "AC-GT"}
_made: dict[tuple[str, str], str] = {}


def lookup(key: Column, values: dict, other: str | None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in values.items():
        out = out.when(key == k, v)
    return out.otherwise(other)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, made once a session for each folder and then read: record_id, qname, ref_id, pos, cigar, qual, rx, rg, flags."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _made or not exists(spark, _made[known]):
        path = scratch(spark, "alignments")
        build(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).write.parquet(path)
        _made[known] = path
    return spark.read.parquet(_made[known])


def build(lineitem: DataFrame) -> DataFrame:
    d, t = (F.round(F.col(x) * 100).cast("int") for x in ("l_discount", "l_tax"))
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    seven = line == 7
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    flags = (
        bit(~seven, S.PAIRED)
        + F.when(seven, 0).when(line % 2 == 1, S.FIRST).otherwise(S.SECOND)
        + bit(F.col("l_suppkey") % 4 >= 2, S.REVERSE)
        + bit((d == 10) & (t == 8), S.UNMAPPED)
        + bit((d == 8) & (t == 8) & (line < 7), S.MATE_UNMAPPED)
        + bit((d == 9) & (t == 0), S.SECONDARY)
        + bit((d == 9) & (t == 1), S.SUPPLEMENTARY)
        + bit((d == 3) & (t == 2), S.DUPLICATE)
    )
    rows = lineitem.select(
        *ORDER[2:],
        F.col("l_orderkey").cast("string").alias("qname"),
        (F.col("l_suppkey") % 2).cast("int").alias("ref_id"),
        (F.col("l_partkey") % 20 * 50 + 1000).cast("bigint").alias("pos"),
        lookup(d, CIGARS, "100M").alias("cigar"),
        F.array(quantity, F.lit(14), F.lit(15), line * 5).alias("qual"),
        lookup(quantity % 5, BARCODES, None).alias("rx"),
        F.when(seven & (F.col("l_linestatus") == "O"), "S").otherwise(F.col("l_returnflag")).alias("rg"),
        flags.alias("flags"),
    )
    return dense_ids(rows, ORDER).select("record_id", "qname", "flags", "ref_id", "pos", "cigar", "qual", "rx", "rg")


def libraries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(rg, i) for rg, _, i in READ_GROUPS], "rg string, library_idx int")


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTIGS, "ref_id int, name string")
