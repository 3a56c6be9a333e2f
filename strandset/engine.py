"""Duplicate marking from a table and its header to flagged rows, ids of duplicates and the report's figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema as S
from .functions import alignment as A
from .operators import checks as C
from .operators import marking as M
from .operators import metrics as R
from .options import Options
from .sources.header import Header

# Fixed value: the furthest a forward read's clip may reach when groups close as in a stream.
STREAM_CLIP = 1024


@dataclass
class Result:
    flagged: DataFrame
    duplicates: DataFrame
    counters: DataFrame
    sizes: DataFrame
    library: str

    def report(self, command: str) -> str:
        """The text of the metrics report."""
        return R.report_text(self.counters.first().asDict(), [tuple(x) for x in self.sizes.collect()], self.library, command)


def mark_duplicates(alignments: DataFrame, header: Header, options: Options = Options()) -> Result:
    """Checks the order and writes keyed reads and pairs to the shared folder; the rest is lazy. alignments: the columns of
    schema.ALIGNMENTS."""
    spark = alignments.sparkSession
    header.check_sort_order(options.assume_sort_order)
    C.require_sorted(alignments)
    libraries = spark.createDataFrame(header.libraries(R.UNKNOWN_LIBRARY), "rg string, library_idx int")
    reads = M.keyed_reads(alignments, libraries, options)
    if options.closing == "stream":
        clip = F.when(~F.col("reverse"), F.col("pos") - F.col("uc5"))
        reads = reads.withColumn("uc5", F.when(F.coalesce(clip, F.lit(0)) > STREAM_CLIP, F.raise_error(F.lit(f"a clip of more than {STREAM_CLIP}")).cast("bigint")).otherwise(F.col("uc5")))
    reads = M.prepared(reads)
    duplicates = M.duplicate_ids(reads, options)
    drop, add = ["DT"], [("PG", "Z", F.lit("MarkDuplicates"))]
    rows = alignments
    if options.molecular_id_tag:
        contigs = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(header.references)], "ref_id int, contig string")
        rows = rows.join(F.broadcast(contigs), "ref_id", "left")  # one row a reference
        place = F.when(A.has(F.col("flags"), S.REVERSE), F.col("pos")).otherwise(F.col("mate_pos"))
        add.insert(0, (options.molecular_id_tag, "Z", A.molecular_id(F.col("contig"), F.coalesce(place, F.lit(-1)) + 1)))
    rows = rows.withColumn("tags", C.replace_tags(F.col("tags"), drop, add)).select(*alignments.columns)
    flagged = M.flag_duplicates(rows, duplicates, options.remove_duplicates)
    return Result(flagged, duplicates, R.counters(alignments, reads, options), M.group_sizes(reads, options), R.report_library(header.library_names()))
