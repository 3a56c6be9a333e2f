"""Command line: own options, or Picard-style --KEY VALUE after the word MarkDuplicates."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from .engine import mark_duplicates
from .operators import checks as C
from .operators.sorting import in_coordinate_order
from .options import Options, check_tag
from .sources.bam import read_bam, read_sam, write_bam

VERSION = "0.1.0"
#: Options of the other style: those with a counterpart here, and those that need none.
KEYS = {"INPUT": "input", "I": "input", "OUTPUT": "output", "O": "output", "METRICS_FILE": "metrics", "M": "metrics", "BARCODE_TAG": "barcode_tag", "READ_ONE_BARCODE_TAG": "read_one", "READ_TWO_BARCODE_TAG": "read_two", "REMOVE_DUPLICATES": "remove", "ASSUME_SORT_ORDER": "assume", "REFERENCE_SEQUENCE": "reference", "R": "reference"}
# Options without effect on duplicates by coordinate.
IGNORED = frozenset(
    """
    ADD_PG_TAG_TO_READS ASSUME_SORTED CLEAR_DT COMMENT COMPRESSION_LEVEL CREATE_INDEX CREATE_MD5_FILE DUPLEX_UMI
    DUPLICATE_SCORING_STRATEGY MAX_FILE_HANDLES_FOR_READ_ENDS_MAP MAX_OPTICAL_DUPLICATE_SET_SIZE MAX_RECORDS_IN_RAM
    MAX_SEQUENCES_FOR_DISK_READ_ENDS_MAP MOLECULAR_IDENTIFIER_TAG OPTICAL_DUPLICATE_PIXEL_DISTANCE
    PROGRAM_GROUP_COMMAND_LINE PROGRAM_GROUP_NAME PROGRAM_GROUP_VERSION PROGRAM_RECORD_ID QUIET READ_NAME_REGEX
    REMOVE_SEQUENCING_DUPLICATES SORTING_COLLECTION_SIZE_RATIO TAGGING_POLICY TAG_DUPLICATE_SET_MEMBERS TMP_DIR
    USE_JDK_DEFLATER USE_JDK_INFLATER VALIDATION_STRINGENCY VERBOSITY arguments_file help showHidden
    """.split()
)
# What the report's command line names behind the files, in its order. {remove} is the option given.
DEFAULTS = """
--MAX_SEQUENCES_FOR_DISK_READ_ENDS_MAP 50000 --MAX_FILE_HANDLES_FOR_READ_ENDS_MAP 8000
--SORTING_COLLECTION_SIZE_RATIO 0.25 --TAG_DUPLICATE_SET_MEMBERS false --REMOVE_SEQUENCING_DUPLICATES false
--TAGGING_POLICY DontTag --CLEAR_DT true --DUPLEX_UMI false --FLOW_MODE false
--FLOW_DUP_STRATEGY FLOW_QUALITY_SUM_STRATEGY --FLOW_USE_END_IN_UNPAIRED_READS false
--FLOW_USE_UNPAIRED_CLIPPED_END false --FLOW_UNPAIRED_END_UNCERTAINTY 0 --FLOW_UNPAIRED_START_UNCERTAINTY 0
--FLOW_SKIP_FIRST_N_FLOWS 0 --FLOW_Q_IS_KNOWN_END false --FLOW_EFFECTIVE_QUALITY_THRESHOLD 15
--ADD_PG_TAG_TO_READS true --REMOVE_DUPLICATES {remove} --ASSUME_SORTED false
--DUPLICATE_SCORING_STRATEGY SUM_OF_BASE_QUALITIES --PROGRAM_RECORD_ID MarkDuplicates
--PROGRAM_GROUP_NAME MarkDuplicates
--READ_NAME_REGEX <optimized capture of last three ':' separated fields as numeric values>
--OPTICAL_DUPLICATE_PIXEL_DISTANCE 100 --MAX_OPTICAL_DUPLICATE_SET_SIZE 300000 --VERBOSITY INFO --QUIET false
--VALIDATION_STRINGENCY STRICT --COMPRESSION_LEVEL 5 --MAX_RECORDS_IN_RAM 500000 --CREATE_INDEX false
--CREATE_MD5_FILE false --help false --version false --showHidden false --USE_JDK_DEFLATER false
--USE_JDK_INFLATER false
"""


def picard_arguments(words: list[str]) -> dict:
    """Values by our names from --KEY VALUE or KEY=VALUE words. An option without effect takes the next word as its value
    unless that begins with --."""
    found: dict = {}
    left = list(reversed(words))
    while left:
        key, equals, value = left.pop().partition("=")
        key = key.removeprefix("-").removeprefix("-")
        if key in KEYS:
            if not equals and not left:
                raise ValueError(f"{key} has no value")
            found[KEYS[key]] = value if equals else left.pop()
        elif key in IGNORED or key.startswith("FLOW_"):
            if not equals and left and not left[-1].startswith("--"):
                left.pop()
        else:
            raise ValueError(f"unknown option {key}")
    missing = {"input", "output", "metrics"} - found.keys()
    if missing:
        raise ValueError(f"no {', '.join(sorted(missing))}")
    order = found.get("assume", "queryname")
    if order not in ("coordinate", "queryname", "unsorted"):
        raise ValueError(f"unknown sort order {order}")
    found["remove"] = found.get("remove", "false").lower() == "true"
    found["line"] = expanded_command(found)
    if order != "coordinate":
        found.pop("assume", None)  # the header says whether to sort
    found["sort"] = True  # this style takes files in any order
    return found


def expanded_command(given: dict) -> str:
    """The report's command line: the given files by their base names, the sort order, and all other options' defaults."""
    name = {x: os.path.basename(given[x]) for x in ("input", "output", "metrics", "reference") if given.get(x)}
    head = f"MarkDuplicates --INPUT {name['input']} --OUTPUT {name['output']} --METRICS_FILE {name['metrics']} --ASSUME_SORT_ORDER {given.get('assume', 'queryname')}"
    reference = f" --REFERENCE_SEQUENCE {name['reference']}" if "reference" in name else ""
    return f"{head}{reference} " + " ".join(DEFAULTS.split()).replace("{remove}", str(given["remove"]).lower())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandset", description="Mark duplicates in a coordinate-sorted BAM or SAM file.")
    p.add_argument("input", help="file, or - for standard input")
    p.add_argument("-o", "--output", help="BAM file; standard output by default")
    p.add_argument("-M", "--metrics", help="report")
    p.add_argument("-@", "--threads", type=int, default=1, help="cores of a local session")
    p.add_argument("--remove-duplicates", dest="remove", action="store_true")
    p.add_argument("--assume-sort-order", dest="assume")
    p.add_argument("--barcode-tag", type=check_tag)
    p.add_argument("--read-one-barcode-tag", dest="read_one", type=check_tag)
    p.add_argument("--read-two-barcode-tag", dest="read_two", type=check_tag)
    p.add_argument("--molecular-identifier-tag", dest="molecular", type=check_tag)
    p.add_argument("--closing", choices=["set", "stream"], default="set")
    return p


def spooled(path: str) -> tuple[str, bool]:
    """The input's path; standard input goes to a temporary file first, since it is read more than once."""
    if path != "-":
        return path, False
    print("reading standard input into a temporary file", file=sys.stderr)
    with tempfile.NamedTemporaryFile(suffix=".bam", delete=False) as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    return f.name, True


def run(spark: SparkSession, given: dict, command: str = "strandset") -> None:
    source, output = given["input"], given.get("output")
    if output and source != "-" and os.path.abspath(source) == os.path.abspath(output):
        raise ValueError("input and output are the same file")
    options = Options(given.get("barcode_tag"), given.get("read_one"), given.get("read_two"), given.get("molecular"), bool(given.get("remove")), given.get("assume"), given.get("closing") or "set")
    path, temporary = spooled(source)
    try:
        header, alignments = (read_sam if path.endswith(".sam") else read_bam)(spark, path)
        if given.get("sort") and header.sort_order != "coordinate":
            alignments = in_coordinate_order(alignments)
            header = header.sorted_by("coordinate")
        result = mark_duplicates(alignments, header, options)
        if given.get("metrics"):
            with open(given["metrics"], "w") as f:
                f.write(result.report(given.get("line") or f"strandset {VERSION} INPUT={source} OUTPUT={output or 'stdout'}"))
        marked = header.marked(VERSION, command)
        if output:
            write_bam(result.flagged, marked, output)
        else:
            with tempfile.NamedTemporaryFile(suffix=".bam") as f:
                write_bam(result.flagged, marked, f.name)
                with open(f.name, "rb") as done:
                    shutil.copyfileobj(done, sys.stdout.buffer)
    finally:
        if temporary:
            os.unlink(path)


def compare(spark: SparkSession, expected: str, actual: str, expected_metrics: str | None = None, actual_metrics: str | None = None, sample: str = "", data_only: bool = False) -> dict:
    """The first difference of two BAM files and their reports: header text, then records, then the reports (with data_only
    without their comment lines, so the tool's name and the date do not matter)."""
    (a, left), (b, right) = read_bam(spark, expected), read_bam(spark, actual)
    out: dict = {"sample_id": sample, "passed": False, "comparator": f"strandset compare {VERSION}", "expected_bam": expected, "actual_bam": actual, "expected_metrics": expected_metrics, "actual_metrics": actual_metrics, "records_compared": 0, "mismatch": None}
    if a.render() != b.render():
        return out | {"mismatch": {"class": "header_text"}}
    first = C.compare_alignments(left, right).orderBy("record_id").limit(1).collect()
    if first:
        row = first[0]
        kind = row.field if row.field == "record_count" else "record_field"
        return out | {"records_compared": row.record_id, "mismatch": {"class": kind, "record_index": row.record_id, "field": row.field, "expected": row.expected, "actual": row.actual}}
    out["records_compared"] = left.count()
    if expected_metrics and actual_metrics:
        with open(expected_metrics) as x, open(actual_metrics) as y:
            if found := (C.compare_metrics if data_only else C.compare_texts)(x.read(), y.read()):
                return out | {"mismatch": found}
    return out | {"passed": True}


def compare_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandset compare", description="Compare two BAM files and their reports.")
    p.add_argument("files", nargs="*", help="expected and actual BAM file, expected and actual report; or the options below")
    p.add_argument("--sample-id", default="")
    for name in ("expected-bam", "actual-bam", "expected-metrics", "actual-metrics"):
        p.add_argument(f"--{name}")
    p.add_argument("--output-json", help="file for the result, which is printed too")
    p.add_argument("--metrics-data", action="store_true", help="leave out the reports' comment lines")
    return p


def compared(words: list[str]) -> int:
    p = compare_parser()
    given = p.parse_args(words)
    paths = [given.expected_bam, given.actual_bam, given.expected_metrics, given.actual_metrics]
    if len(given.files) > 4 or given.files and any(paths):
        p.error("files are given either in order or by options")
    paths = [*given.files, None, None, None, None][:4] if given.files else paths
    if None in paths[:2]:
        p.error("two BAM files are needed")
    found = compare(SparkSession.builder.getOrCreate(), *paths, given.sample_id, given.metrics_data)
    text = json.dumps(found, indent=2)
    if given.output_json:
        with open(given.output_json, "w") as f:
            f.write(text)
    print(text)
    return int(not found["passed"])


def main(words: list[str] | None = None) -> int:
    words = list(sys.argv[1:] if words is None else words)
    words = [x for x in words if not x.startswith("-Xm")]
    if words[:1] == ["compare"]:
        return compared(words[1:])
    if words[:1] == ["MarkDuplicates"]:
        if "--version" in words:
            print("Version:3.4.0", file=sys.stderr)
            return 0
        given, cores = picard_arguments(words[1:]), 1
    else:
        given = vars(parser().parse_args(words))
        cores = max(1, given["threads"])
    spark = SparkSession.builder.master(os.environ.get("MASTER", f"local[{cores}]")).config("spark.ui.enabled", "false").getOrCreate()
    run(spark, given, "strandset " + " ".join(words))
    return 0


if __name__ == "__main__":
    sys.exit(main())
