"""Sort order, tags, comparison of tables and pile-up figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import alignment as A

#: Records for each chunk of the sort check.
CHUNK = 1 << 16


def sort_violations(alignments: DataFrame) -> DataFrame:
    """(record_id) of reads on a reference that come before an earlier read's place, or after the unplaced tail began.

    One unplaced record at the very start is no tail. The order is checked inside chunks of records and then at the
    chunks' ends, which are as many rows as there are chunks.
    """
    rows = alignments.select("record_id", "ref_id", F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"), F.floor(F.col("record_id") / CHUNK).alias("chunk"))
    here = F.struct("ref_id", "pos")
    ends = rows.groupBy("chunk").agg(F.max_by(here, "record_id").alias("last"), F.bool_or(F.col("ref_id").isNull() & (F.col("record_id") >= 1)).alias("tail"))
    over = Window.orderBy("chunk")  # one row a chunk
    before = ends.select("chunk", F.lag("last").over(over).alias("last_before"), F.max(F.col("tail").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("tail_before"))
    order = Window.partitionBy("chunk").orderBy("record_id")
    seen = rows.withColumn("inside", F.lag(here).over(order)).withColumn("tail_inside", F.max((F.col("ref_id").isNull() & (F.col("record_id") >= 1)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))).join(before, "chunk")
    last = F.coalesce("inside", "last_before")
    back = last["ref_id"].isNotNull() & (last > here)
    tail = (F.coalesce("tail_inside", F.lit(0)) + F.coalesce("tail_before", F.lit(0))) > 0
    return seen.where(F.col("ref_id").isNotNull() & (back | tail)).select("record_id")


def require_sorted(alignments: DataFrame) -> None:
    first = sort_violations(alignments).agg(F.min("record_id")).first()[0]
    if first is not None:
        raise ValueError(f"records are not in order of coordinates: record {first}")


def molecular_ids(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(record_id, mi) of alignments (record_id, flags, ref_id, pos, mate_pos): the record's own contig, and the own start
    of a reverse read or the mate's of a forward one. contigs: (ref_id, name), a row for each of the header's references."""
    pos = F.when(A.has(F.col("flags"), S.REVERSE), F.col("pos")).otherwise(F.col("mate_pos"))
    named = reads.join(F.broadcast(contigs), "ref_id", "left")
    return named.select("record_id", A.molecular_id(F.col("name"), F.coalesce(pos, F.lit(-1)) + 1).alias("mi"))


def replace_tags(tags: Column, drop: list[str], add: list[tuple[str, str, Column]]) -> Column:
    """tags without those of drop and add, then the new ones, in order."""
    gone = [*drop, *[x for x, _, _ in add]]
    kept = F.filter(F.coalesce(tags, F.array().cast("array<struct<tag: string, type: string, value: string>>")), lambda t: ~t["tag"].isin(gone))
    return F.concat(kept, F.array(*[F.struct(F.lit(x).alias("tag"), F.lit(kind).alias("type"), value.cast("string").alias("value")) for x, kind, value in add]))


FIELDS = ["qname", "flags", "ref_id", "pos", "mapq", "cigar", "mate_ref_id", "mate_pos", "tlen", "seq", "qual", "tags"]


def compare_alignments(expected: DataFrame, actual: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(record_id, field, expected, actual) of every record that differs, by its first differing field; record_count where
    one table has no such record."""
    fields = [x for x in (fields or FIELDS) if x in expected.columns and x in actual.columns]
    a = expected.select("record_id", F.struct(*fields).alias("e"))
    b = actual.select("record_id", F.struct(*fields).alias("a"))
    both = a.join(b, "record_id", "full_outer")
    missing = F.col("e").isNull() | F.col("a").isNull()
    field = F.when(missing, "record_count")
    for x in fields:
        field = field.when(~F.col(f"e.{x}").eqNullSafe(F.col(f"a.{x}")), x)
    shown = lambda side: F.when(missing, F.when(F.col(side).isNotNull(), "present")).otherwise(F.element_at(F.create_map(*[y for x in fields for y in (F.lit(x), F.col(f"{side}.{x}").cast("string"))]), F.col("field")))
    return both.withColumn("field", field).where("field is not null").select("record_id", "field", shown("e").alias("expected"), shown("a").alias("actual"))


def flag_set_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(qname, is_duplicate, side) of names and duplicate bits that one table has more often."""
    view = lambda df: df.select("qname", A.has(F.col("flags"), S.DUPLICATE).alias("is_duplicate"))
    a, b = view(expected), view(actual)
    return a.exceptAll(b).withColumn("side", F.lit("expected")).unionAll(b.exceptAll(a).withColumn("side", F.lit("actual")))


def compare_texts(expected: str, actual: str, kind: str = "metrics_text") -> dict | None:
    """The first line in which two texts differ."""
    a, b = expected.split("\n"), actual.split("\n")
    for i in range(max(len(a), len(b))):
        x, y = (t[i] if i < len(t) else None for t in (a, b))
        if x != y:
            return {"class": kind, "line": i + 1, "expected": x, "actual": y}
    return None


def metrics_lines(text: str) -> list[str]:
    """A report's lines but its comments."""
    return [x for x in text.split("\n") if not x.startswith("#")]


def compare_metrics(expected: str, actual: str) -> dict | None:
    """The first line, comments not counted, in which two reports differ."""
    return compare_texts("\n".join(metrics_lines(expected)), "\n".join(metrics_lines(actual)), "metrics_data")


def peak_pending(mates: DataFrame) -> DataFrame:
    """(peak), one row: the most reads that wait for their mate at once, in file order; orphans wait to the end. mates:
    operators.marking.mates. Steps add up within bins of 65,536 records, on top of what the bins before leave open."""
    steps = mates.select("record_id", F.when(F.col("arrival") % 2 == 1, 1).otherwise(-1).alias("step"), F.floor(F.col("record_id") / 65536).alias("bin"))
    bins = steps.groupBy("bin").agg(F.sum("step").alias("total"))
    open_before = bins.select("bin", F.coalesce(F.sum("total").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    highest = steps.withColumn("inside", F.sum("step").over(Window.partitionBy("bin").orderBy("record_id"))).groupBy("bin").agg(F.max("inside").alias("inside"))
    return highest.join(open_before, "bin").agg(F.coalesce(F.max(F.col("inside") + F.col("before")), F.lit(0)).alias("peak"))


def five_prime_buckets(alignments: DataFrame) -> DataFrame:
    """(ref_id, uc5, reverse, reads) of placed primary and supplementary reads. Soft clips count, hard ones do not; places
    are 1-based and the reverse end inclusive."""
    rows = alignments.where((F.col("flags").bitwiseAND(F.lit(S.UNMAPPED | S.SECONDARY)) == 0) & F.col("ref_id").isNotNull())
    reverse = A.has(F.col("flags"), S.REVERSE)
    soft = F.regexp_replace("cigar", "[0-9]+H", "")
    start = F.col("pos") + 1
    uc5 = F.when(reverse, start + A.reference_span(soft) - 1 + A.trailing_clip(soft)).otherwise(start - A.leading_clip(soft))
    return rows.groupBy("ref_id", uc5.alias("uc5"), reverse.alias("reverse")).agg(F.count(F.lit(1)).alias("reads"))


def base_depths(alignments: DataFrame) -> DataFrame:
    """(ref_id, pos, depth) where the depth of placed primary reads changes: ends of aligned blocks, added up.

    Gaps N and D cover nothing. Depth adds up within bins of 65,536 bases, on top of what the bins before leave open.
    """
    rows = alignments.where((F.col("flags").bitwiseAND(F.lit(S.UNMAPPED | S.SECONDARY | 0x200 | S.DUPLICATE)) == 0) & F.col("ref_id").isNotNull())
    steps = F.regexp_extract_all("cigar", F.lit("([0-9]+[MIDN=X])"), F.lit(1))
    size = lambda op: F.regexp_extract(op, "^([0-9]+)", 1).cast("bigint")
    begin = F.struct(F.col("pos").alias("at"), F.array().cast("array<struct<pos: bigint, step: int>>").alias("found"))

    def walk(state: Column, op: Column) -> Column:
        end = state["at"] + size(op)
        covered = F.array(F.struct(state["at"].alias("pos"), F.lit(1).alias("step")), F.struct(end.alias("pos"), F.lit(-1).alias("step")))
        return F.when(op.rlike("[M=X]$"), F.struct(end.alias("at"), F.concat(state["found"], covered).alias("found"))).when(op.rlike("[DN]$"), F.struct(end.alias("at"), state["found"].alias("found"))).otherwise(state)

    events = rows.select("ref_id", F.explode(F.aggregate(steps, begin, walk, lambda s: s["found"])).alias("e")).groupBy("ref_id", F.col("e.pos").alias("pos")).agg(F.sum("e.step").alias("step"))
    events = events.withColumn("bin", F.floor(F.col("pos") / 65536))
    bins = events.groupBy("ref_id", "bin").agg(F.sum("step").alias("total"))
    open_before = bins.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy("ref_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inside = F.sum("step").over(Window.partitionBy("ref_id", "bin").orderBy("pos"))
    return events.withColumn("inside", inside).join(open_before, ["ref_id", "bin"]).select("ref_id", "pos", (F.col("inside") + F.col("before")).alias("depth"))


def largest(df: DataFrame, by: str, ties: list[str]) -> DataFrame:
    """The row of the largest `by`, ties by the smallest of ties."""
    return df.orderBy(F.desc(by), *ties).limit(1)
