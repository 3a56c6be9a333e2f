"""Counts of duplicate marking and the report made of them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import numbers as N
from ..options import Options
from . import marking as M

UNKNOWN_LIBRARY = "Unknown Library"
COUNTERS = ["unpaired_examined", "pairs_examined", "secondary_or_supplementary", "unmapped", "unpaired_dups", "pair_dups"]
# The report's columns.
COLUMNS = [
    "LIBRARY",
    "UNPAIRED_READS_EXAMINED",
    "READ_PAIRS_EXAMINED",
    "SECONDARY_OR_SUPPLEMENTARY_RDS",
    "UNMAPPED_READS",
    "UNPAIRED_READ_DUPLICATES",
    "READ_PAIR_DUPLICATES",
    "READ_PAIR_OPTICAL_DUPLICATES",
    "PERCENT_DUPLICATION",
    "ESTIMATED_LIBRARY_SIZE",
]


def counters(alignments: DataFrame, reads: DataFrame, options: Options = Options()) -> DataFrame:
    """One row of COUNTERS. Unpaired reads examined are fragments and orphans; orphans are never duplicates."""
    kind = A.read_class(F.col("flags"))
    classes = alignments.agg(F.count_if(kind.isin("secondary", "supplementary")).alias("secondary_or_supplementary"), F.count_if(kind == "unmapped").alias("unmapped"), F.count_if(kind == "fragment").alias("fragments"), F.count_if(kind == "paired").alias("paired"))
    groups = M.pair_groups(M.keyed_pairs(reads, options), options).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("pairs_examined"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("pair_dups"))
    lone = M.fragment_groups(reads).agg(F.coalesce(F.sum(F.when(F.col("marked"), F.col("size")).otherwise(F.col("size") - 1)), F.lit(0)).alias("unpaired_dups"))
    return classes.crossJoin(groups).crossJoin(lone).select((F.col("fragments") + F.col("paired") - 2 * F.col("pairs_examined")).alias("unpaired_examined"), *COUNTERS[1:])  # three rows of one each


def library_counters(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """(library_idx, unpaired_examined, pairs_examined, unpaired_dups, pair_dups) by library."""
    met = M.mates(reads)
    lone = reads.where("not paired").select("library_idx").unionAll(met.where("orphan").select("library_idx"))
    pairs = M.pair_groups(M.keyed_pairs(reads, options), options).groupBy("library_idx").agg(F.sum("size").alias("pairs_examined"), F.sum(F.col("size") - 1).alias("pair_dups"))
    unpaired = lone.groupBy("library_idx").agg(F.count(F.lit(1)).alias("unpaired_examined"))
    dups = M.fragment_groups(reads).groupBy("library_idx").agg(F.sum(F.when(F.col("marked"), F.col("size")).otherwise(F.col("size") - 1)).alias("unpaired_dups"))
    joined = pairs.join(unpaired, "library_idx", "full_outer").join(dups, "library_idx", "full_outer")
    return joined.select("library_idx", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("unpaired_examined", "pairs_examined", "unpaired_dups", "pair_dups")])


def with_rates(counts: DataFrame) -> DataFrame:
    c = F.col
    return counts.withColumn("percent_duplication", N.percent_duplication(c("unpaired_examined"), c("pairs_examined"), c("unpaired_dups"), c("pair_dups"))).withColumn("library_size", N.library_size(c("pairs_examined"), c("pair_dups")))


def roi_histogram(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bin, coverage_mult, all_sets, non_optical_sets); no rows where the library size is undefined."""
    one = with_rates(counts).where("library_size is not null").select("library_size", "pairs_examined", (F.col("pairs_examined") - F.col("pair_dups")).alias("unique"))
    cover = N.coverage_multiple(F.col("library_size").cast("double"), F.col("pairs_examined").cast("double"), F.col("unique").cast("double"), F.col("bin").cast("double"))
    return sizes.join(F.broadcast(one)).select("bin", cover.alias("coverage_mult"), F.col("sets").alias("all_sets"), F.col("sets").alias("non_optical_sets"))  # one row


def report_library(labels: Iterable[str | None]) -> str:
    """The report's label: of the first read group that names a library."""
    return next((x for x in labels if x is not None), UNKNOWN_LIBRARY)


def report_text(counts: dict, sizes: Iterable[tuple[int, int]], library: str, command: str, when: datetime | None = None) -> str:
    """The report. counts: COUNTERS; sizes: (bin, sets)."""
    n, dups = counts["pairs_examined"], counts["pair_dups"]
    size = N.library_size_of(n, dups)
    percent = N.percent_of(counts["unpaired_examined"], n, counts["unpaired_dups"], dups)
    values = [library, *[counts[x] for x in COUNTERS], 0, N.trimmed(percent), "" if size is None else size]
    lines = [
        "## htsjdk.samtools.metrics.StringHeader",
        f"# {command}",
        "## htsjdk.samtools.metrics.StringHeader",
        f"# Started on: {N.report_date(when)}",
        "",
        "## METRICS CLASS\tpicard.sam.DuplicationMetrics",
        "\t".join(COLUMNS),
        "\t".join(map(str, values)),
        "",
    ]
    if size is not None:
        import math

        lines += ["## HISTOGRAM\tjava.lang.Double", "BIN\tCoverageMult\tall_sets\tnon_optical_sets"]
        for bin_, sets in sorted(sizes):
            if bin_ >= 1 and sets:
                cover = size * (1 - math.exp(-bin_ * n / size)) / (n - dups) if bin_ <= N.LAST_BIN and size else 0.0
                lines.append(f"{bin_:.1f}\t{N.trimmed(cover)}\t{sets}\t{sets}")
    return "\n".join([*lines, ""]) + "\n"


def parse_report(text: str) -> dict:
    """The metrics row by column name; ESTIMATED_LIBRARY_SIZE is None where it is empty."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if x.startswith("## METRICS CLASS")), None)
    if at is None or len(lines) < at + 3:
        raise ValueError("no metrics in this report")
    names, values = lines[at + 1].split("\t"), lines[at + 2].split("\t")
    found: dict = dict(zip(names, values, strict=True))
    for name in names[1:8]:
        found[name] = int(found[name])
    found["PERCENT_DUPLICATION"] = float(found["PERCENT_DUPLICATION"])
    found["ESTIMATED_LIBRARY_SIZE"] = int(found["ESTIMATED_LIBRARY_SIZE"]) if found["ESTIMATED_LIBRARY_SIZE"] else None
    return found
