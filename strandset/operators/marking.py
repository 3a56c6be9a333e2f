"""Operators of duplicate marking: from alignments to the ids of duplicates.

Winners are chosen by partial aggregation (the largest score, then the smallest id) and joined back, so a position that
many reads share sends one row a task to its group and is joined in parts, and never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import alignment as A
from ..options import Options
from ..storage import materialize
from ..streaming.closing import with_segments

PAIR_KEY = ["library_idx", "barcode", "read1_hash", "read2_hash", "ref_lo", "pos_lo", "rev_lo", "ref_hi", "pos_hi", "rev_hi"]
FRAGMENT_KEY = ["library_idx", "barcode", "ref_id", "uc5", "reverse"]


def tag_value(df: DataFrame, tag: str | None) -> Column:
    """A tag's value: the column of that (lower-case) name, else the entry of tags; null where it is absent. A value that
    is no string is an error."""
    if tag is None:
        return F.lit(None).cast("string")
    if tag.lower() in df.columns:
        return F.col(tag.lower())
    entry = F.get(F.filter("tags", lambda t: t["tag"] == tag), F.lit(0)) if "tags" in df.columns else F.lit(None)
    if "tags" not in df.columns:
        return F.lit(None).cast("string")
    wrong = F.raise_error(F.concat(F.lit(f"tag {tag} is no string: "), entry["value"])).cast("string")
    return F.when(entry.isNull() | (entry["type"] == "Z"), entry["value"]).otherwise(wrong)


def keyed_reads(alignments: DataFrame, libraries: DataFrame, options: Options = Options()) -> DataFrame:
    """Primary mapped reads with all that their keys and scores need. libraries: (rg, library_idx), one row a read group."""
    flags = F.col("flags")
    reverse = A.has(flags, S.REVERSE)
    kind = A.read_class(flags)
    barcode = F.lit(0)
    if options.barcode_tag:
        barcode = A.barcode_hash(A.checked_umi(tag_value(alignments, options.barcode_tag)))
    mate = F.lit(0)
    if options.read_one_tag or options.read_two_tag:
        one, two = (A.mate_barcode_hash(tag_value(alignments, x)) if x else F.lit(0) for x in (options.read_one_tag, options.read_two_tag))
        mate = F.when(A.has(flags, S.FIRST), one).otherwise(two)
    reads = alignments.withColumn("rg", tag_value(alignments, "RG")).where(kind.isin("fragment", "paired")).select(
        "record_id",
        F.coalesce("qname", F.lit("")).alias("qname"),
        F.coalesce("rg", F.lit("")).alias("read_group"),
        F.coalesce("ref_id", F.lit(-1)).alias("ref_id"),
        F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"),
        A.unclipped_5prime(F.coalesce("pos", F.lit(-1)).cast("bigint"), F.col("cigar"), reverse).alias("uc5"),
        reverse.alias("reverse"),
        A.has(flags, S.FIRST).alias("first_of_pair"),
        (kind == "paired").alias("paired"),
        A.quality_sum(F.col("qual")).alias("score"),
        barcode.alias("barcode"),
        mate.alias("mate_hash"),
    )
    # As many rows as read groups, from the file's header.
    named = libraries.select(F.col("rg").alias("read_group"), "library_idx")
    return reads.join(F.broadcast(named), "read_group", "left").withColumn("library_idx", F.coalesce("library_idx", F.lit(0)))


def mates(reads: DataFrame) -> DataFrame:
    """Paired reads with the number of their meeting: of a read group and name, the first and second arrival meet, the
    third and fourth, and so on. later is the second's struct, null for second arrivals and orphans."""
    columns = ["record_id", "ref_id", "pos", "uc5", "reverse", "first_of_pair", "score", "barcode", "mate_hash", "library_idx"]
    order = Window.partitionBy("read_group", "qname").orderBy("record_id")
    numbered = reads.where("paired").withColumn("arrival", F.row_number().over(order)).withColumn("next", F.lead(F.struct(*columns)).over(order))
    odd = F.col("arrival") % 2 == 1
    return numbered.withColumn("meeting", F.floor((F.col("arrival") - 1) / 2)).withColumn("later", F.when(odd, F.col("next"))).withColumn("orphan", odd & F.col("next").isNull()).drop("next")


def orphans(reads: DataFrame) -> DataFrame:
    return mates(reads).where("orphan").select("record_id", "read_group", "qname")


def pairs(reads: DataFrame) -> DataFrame:
    """One row a pair: its key, score, ids in order of arrival, and where the later mate stands."""
    met = mates(reads).where("later is not null")
    early, late = (F.struct(*[F.col(p + x).alias(x) for x in ("ref_id", "uc5", "reverse")]) for p in ("", "later."))
    spot = lambda side: F.struct(side["ref_id"], side["uc5"])
    early_low = spot(early) < spot(late)  # on a tie the later one is the lower
    low, high = F.when(early_low, early).otherwise(late), F.when(early_low, late).otherwise(early)
    outward = (spot(early) == spot(late)) & low["reverse"] & ~high["reverse"]  # taken as inward at one position
    first_late = F.col("later.first_of_pair")
    return met.select(
        F.col("later.library_idx").alias("library_idx"),
        F.col("later.barcode").alias("barcode"),
        F.when(first_late, F.col("later.mate_hash")).otherwise(F.col("mate_hash")).alias("read1_hash"),
        F.when(first_late, F.col("mate_hash")).otherwise(F.col("later.mate_hash")).alias("read2_hash"),
        low["ref_id"].alias("ref_lo"),
        low["uc5"].alias("pos_lo"),
        (low["reverse"] & ~outward).alias("rev_lo"),
        high["ref_id"].alias("ref_hi"),
        high["uc5"].alias("pos_hi"),
        (high["reverse"] | outward).alias("rev_hi"),
        (F.col("score") + F.col("later.score")).alias("score"),
        F.col("record_id").alias("id1"),
        F.col("later.record_id").alias("id2"),
        F.col("later.ref_id").alias("later_ref"),
        F.col("later.pos").alias("later_pos"),
    )


def pair_key(options: Options) -> list[str]:
    return PAIR_KEY + ["segment"] * (options.closing == "stream")


def keyed_pairs(reads: DataFrame, options: Options = Options()) -> DataFrame:
    found = pairs(reads)
    return with_segments(found, PAIR_KEY) if options.closing == "stream" else found


def pair_groups(keyed: DataFrame, options: Options = Options()) -> DataFrame:
    """A row a key: the number of pairs and the winner's first id, by score and then file order."""
    best = F.max(F.struct("score", (-F.col("id1")).alias("early")))
    return keyed.groupBy(*pair_key(options)).agg(F.count(F.lit(1)).alias("size"), best.alias("best")).withColumn("winner", -F.col("best.early")).drop("best")


def pair_duplicates(keyed: DataFrame, options: Options = Options()) -> DataFrame:
    """(id1, id2) of pairs that lose."""
    keyed = materialize(keyed, "pairs")  # groups and members both take them
    lost = pair_groups(keyed, options).where("size > 1").drop("size")
    return keyed.join(lost, pair_key(options)).where("id1 <> winner").select("id1", "id2")


def fragment_groups(reads: DataFrame) -> DataFrame:
    """A row a key that has fragments: their number, whether paired reads mark the place, and the best fragment."""
    alone = ~F.col("paired")
    return (
        reads.groupBy(*FRAGMENT_KEY)
        .agg(F.count_if(alone).alias("size"), F.bool_or("paired").alias("marked"), F.max(F.when(alone, F.struct("score", (-F.col("record_id")).alias("early")))).alias("best"))
        .where("size > 0")
        .withColumn("winner", -F.col("best.early"))
        .drop("best")
    )


def fragment_duplicates(reads: DataFrame) -> DataFrame:
    """(record_id, by_marker) of fragments that lose: all where a paired read stands, else all but the best."""
    lost = fragment_groups(reads).where("marked or size > 1").drop("size")
    return reads.where("not paired").join(lost, FRAGMENT_KEY).where("marked or record_id <> winner").select("record_id", F.col("marked").alias("by_marker"))


def prepared(reads: DataFrame) -> DataFrame:
    """reads, written once: pairs, fragments and counters each take them, and CIGARs and qualities are decoded one time."""
    return materialize(reads, "reads")


def duplicate_ids(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """record_id of all duplicates, each once."""
    twice = pair_duplicates(keyed_pairs(reads, options), options).select(F.explode(F.array("id1", "id2")).alias("record_id"))
    return twice.unionByName(fragment_duplicates(reads).select("record_id"))


def flag_duplicates(alignments: DataFrame, duplicates: DataFrame, remove: bool = False) -> DataFrame:
    """alignments with the duplicate bit set on duplicates and cleared on all others; remove leaves duplicates out."""
    if remove:
        kept = alignments.join(duplicates, "record_id", "left_anti")
        return kept.withColumn("flags", F.col("flags").bitwiseAND(F.lit(~S.DUPLICATE))).select(*alignments.columns)
    marked = alignments.join(duplicates.withColumn("is_duplicate", F.lit(True)), "record_id", "left")
    flags = F.when(F.col("is_duplicate"), F.col("flags").bitwiseOR(F.lit(S.DUPLICATE))).otherwise(F.col("flags").bitwiseAND(F.lit(~S.DUPLICATE)))
    return marked.withColumn("flags", flags).select(*alignments.columns)


def group_sizes(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """(bin, sets): how many pair and fragment groups have each size."""
    sizes = pair_groups(keyed_pairs(reads, options), options).select("size").unionAll(fragment_groups(reads).select("size"))
    return sizes.groupBy(F.col("size").alias("bin")).agg(F.count(F.lit(1)).alias("sets"))
