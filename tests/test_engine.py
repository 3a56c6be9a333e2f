import pytest

from strandset.engine import mark_duplicates
from strandset.operators import metrics as R
from strandset.options import Options

from .helpers import header, pair, read, table


def run(spark, records, head=None, sort=True, **options):
    result = mark_duplicates(table(spark, records, sort), head or header(), Options(**options))
    rows = result.flagged.orderBy("record_id").collect()
    return result, rows, {r.qname for r in rows if r.flags & 0x400}


def counts(result):
    return result.counters.first()


def test_inward_and_outward_pair_at_one_place(spark):
    _, _, dups = run(spark, [*pair("fr", 100, 100, "RF", cigar1="1M", cigar2="1M"), *pair("rf", 100, 100, "FR", cigar1="1M", cigar2="1M")])
    assert len(dups) == 1


def test_fragments_lose_to_pairs_and_orphans(spark):
    _, _, dups = run(spark, [read("frag", 0, 0, 100, qual=60), *pair("pair", 100, 300, qual=20)])
    assert dups == {"frag"}
    _, _, dups = run(spark, [read("frag", 0, 0, 100, qual=60), read("orph", 0x41, 0, 100, qual=20)])
    assert dups == {"frag"}


def test_cross_chromosome_pairs(spark):
    _, _, dups = run(spark, [*pair("a", 100, 500, ref2=1), *pair("b", 100, 500, ref2=1)])
    assert len(dups) == 1


def test_introns_count_on_the_reverse_strand_only(spark):
    _, _, dups = run(spark, [*pair("a", 100, 1000, "RF", cigar1="50M100N50M"), *pair("b", 100, 1000, "RF", cigar1="50M200N50M")])
    assert not dups
    _, _, dups = run(spark, [*pair("a", 100, 2000, cigar1="50M100N50M"), *pair("b", 100, 2000, cigar1="50M100N50M")])
    assert len(dups) == 1


def test_lower_quality_fragment_loses(spark):
    _, _, dups = run(spark, [read("low", 0, 0, 100, qual=0), read("high", 0, 0, 100, qual=30)])
    assert dups == {"low"}
    _, _, dups = run(spark, [read("solo", 0, 0, 100)])
    assert not dups


def test_libraries(spark):
    records = [*pair("a", 100, 500, rg="rg1"), *pair("b", 100, 500, rg="rg2")]
    result, _, dups = run(spark, records, header([("rg1", "libA"), ("rg2", "libA")]))
    assert len(dups) == 1 and counts(result).pairs_examined == 2 and result.library == "libA"
    result, _, dups = run(spark, records, header([("rg1", None), ("rg2", None)]))
    assert len(dups) == 1 and result.library == "Unknown Library"
    _, _, dups = run(spark, records, header([("rg1", "libA"), ("rg2", "libB")]))
    assert not dups


def test_names_meet_within_read_groups_only(spark):
    records = [*pair("x", 100, 500, rg="rg1"), *pair("x", 200, 700, rg="rg2")]
    result, rows, dups = run(spark, records, header([("rg1", "l1"), ("rg2", "l2")]))
    assert not dups and counts(result).pairs_examined == 2 and len(rows) == 4
    records = [*pair("shared", 100, 900, rg="rg1"), *pair("shared", 200, 800, rg="rg2"), *pair("control", 100, 800, rg="rg1")]
    result, _, dups = run(spark, records, header([("rg1", "l"), ("rg2", "l")]))
    assert not dups and counts(result).pairs_examined == 3


def test_four_equal_pairs(spark):
    result, _, dups = run(spark, [x for i in range(4) for x in pair(f"p{i}", 100, 500)])
    assert len(dups) == 3 and counts(result).pair_dups == 3
    found = R.parse_report(result.report("strandset"))
    assert found["ESTIMATED_LIBRARY_SIZE"] == 1 and found["READ_PAIR_DUPLICATES"] == 3


def test_fragments_only(spark):
    result, _, _ = run(spark, [read(f"s{p}", 0, 0, p) for p in (100, 200, 300)])
    found = R.parse_report(result.report("strandset"))
    assert found["UNPAIRED_READS_EXAMINED"] == 3 and found["PERCENT_DUPLICATION"] == 0 and found["ESTIMATED_LIBRARY_SIZE"] is None


def test_stale_marks_go_from_all_records(spark):
    records = [read("s", 0x400, 0, 100, DT="LB"), read("sec", 0x100 | 0x400, 0, 100), read("sup", 0x800 | 0x400, 0, 100), read("un", 4 | 0x400)]
    _, rows, dups = run(spark, records)
    assert not dups
    assert all([t.tag for t in r.tags] == ["PG"] for r in rows)


def test_removal_and_classes(spark):
    records = [read("low", 0, 0, 100, qual=10), read("high", 0, 0, 100), read("sec", 0x100, 0, 100), read("un", 4)]
    result, rows, _ = run(spark, records, remove_duplicates=True)
    assert {r.qname for r in rows} == {"high", "sec", "un"}
    c = counts(result)
    assert (c.unpaired_examined, c.unpaired_dups, c.secondary_or_supplementary, c.unmapped) == (2, 1, 1, 1)


def test_mate_unmapped_is_a_fragment(spark):
    _, _, dups = run(spark, [read("a", 0x49, 0, 100, qual=20), read("b", 0, 0, 100)])
    assert dups == {"a"}


def test_order_is_checked(spark):
    records = [read("a", 0, 0, 100), read("b", 0, 1, 100), read("c", 0, 0, 200)]
    with pytest.raises(ValueError, match="record 2"):
        run(spark, records, sort=False)
    for order in ("queryname", "unsorted", "odd", None):
        with pytest.raises(ValueError):
            run(spark, [read("a", 0, 0, 100)], header(order=order))
    run(spark, [read("a", 0, 0, 100)], header(order="queryname"), assume_sort_order="coordinate")


def test_barcodes(spark):
    differ = [*pair("a", 1000, 1200, RX="AAAAAA"), *pair("b", 1000, 1200, RX="CCCCCC")]
    assert not run(spark, differ, barcode_tag="RX")[2]
    assert len(run(spark, differ)[2]) == 1
    same = [*pair("good", 1000, 1200, qual=40, RX="AAAAAA"), *pair("bad", 1000, 1200, qual=20, RX="AAAAAA")]
    assert run(spark, same, barcode_tag="RX")[2] == {"bad"}
    assert not run(spark, [*pair("a", 1000, 1200, RX="AAAAAA"), *pair("b", 1000, 1200)], barcode_tag="RX")[2]
    assert len(run(spark, [*pair("a", 1000, 1200), *pair("b", 1000, 1200)], barcode_tag="RX")[2]) == 1
    assert not run(spark, differ, read_one_tag="RX")[2]
    with pytest.raises(Exception, match="has character X"):
        run(spark, [*pair("a", 1000, 1200, RX="XYZBAD")], barcode_tag="RX")


def test_interleaved_barcodes(spark):
    records = [read("a", 0, 0, 100, qual=40, RX="AAAA"), read("b", 0, 0, 100, qual=35, RX="CCCC"), read("c", 0, 0, 100, qual=30, RX="AAAA")]
    assert run(spark, records, barcode_tag="RX")[2] == {"c"}


def test_molecular_ids(spark):
    records = pair("a", 1000, 1200, RX="AAAAAA")
    _, rows, _ = run(spark, records, barcode_tag="RX", molecular_id_tag="MI")
    assert [{t.tag: t.value for t in r.tags}["MI"] for r in rows] == ["chr1:1200/"] * 2
    _, rows, _ = run(spark, records, barcode_tag="RX")
    assert all("MI" not in {t.tag for t in r.tags} for r in rows)


def test_tag_of_another_type_is_an_error(spark):
    records = [read("a", 0, 0, 100, RX="AAAA")]
    records[0]["tags"][0]["type"] = "i"
    with pytest.raises(Exception, match="is no string"):
        run(spark, records, barcode_tag="RX")


def test_stream_closing(spark):
    inward = [*pair("a", 100, 500), *pair("b", 100, 500)]
    outward = [*pair("a", 100, 500, "FF"), *pair("b", 100, 500, "FF")]
    assert len(run(spark, inward, closing="stream")[2]) == 1
    assert len(run(spark, outward)[2]) == 1
    assert not run(spark, outward, closing="stream")[2]


def test_ties_go_to_file_order_and_report_shape(spark):
    result, _, dups = run(spark, [read("first", 0, 0, 100), read("second", 0, 0, 100)])
    assert dups == {"second"}
    lines = result.report("strandset").split("\n")
    assert lines[0] == lines[2] == "## htsjdk.samtools.metrics.StringHeader" and lines[4] == ""
    assert len(lines[6].split("\t")) == 10 and lines[7].split("\t")[7] == "0" and lines[-1] == ""


def test_report_histogram():
    c = dict(zip(R.COUNTERS, (100, 5000, 50, 20, 10, 500), strict=True))
    text = R.report_text(c, enumerate([0, 4000, 400, 80, 15, 5]), "lib", "strandset")
    at = text.split("\n").index("## HISTOGRAM\tjava.lang.Double")
    rows = text.split("\n")[at + 1 :]
    assert rows[0].split("\t") == ["BIN", "CoverageMult", "all_sets", "non_optical_sets"]
    assert [r.split("\t")[0] for r in rows[1:6]] == ["1.0", "2.0", "3.0", "4.0", "5.0"]
    assert R.parse_report(text)["ESTIMATED_LIBRARY_SIZE"] == 23303


def test_empty_table(spark):
    result, rows, _ = run(spark, [])
    assert rows == [] and counts(result).pairs_examined == 0 and result.sizes.count() == 0


def test_fragment_groups_of_a_growing_table(spark, tmp_path):
    from strandset.operators import marking as M
    from strandset.streaming.groups import follow_fragment_groups

    libraries = spark.createDataFrame([], "rg string, library_idx int")
    reads = M.keyed_reads(table(spark, [read(f"r{i}", 0, 0, 100 + i % 3, qual=20 + i) for i in range(12)]), libraries)
    source, checkpoint, out = (str(tmp_path / x) for x in ("in", "cp", "out"))
    for part in ("record_id < 6", "record_id >= 6"):
        reads.where(part).write.mode("append").parquet(source)
        last = follow_fragment_groups(spark, source, reads.schema, checkpoint, out)
    key = [*M.FRAGMENT_KEY, "size", "winner"]
    assert sorted(map(tuple, last.select(*key).collect())) == sorted(map(tuple, M.fragment_groups(reads).select(*key).collect()))
