import json

import pytest

from strandset.cli import compare, compared, picard_arguments, run
from strandset.operators import checks as C
from strandset.sources.bam import read_bam, read_sam, write_bam
from strandset.sources.header import Header

from .helpers import header, pair, read, table


def test_header_round_trip_and_marking():
    text = "@HD\tVN:1.5\tSO:coordinate\tGO:none\n@SQ\tSN:chr1\tLN:10\n@RG\tID:a\tLB:x\n@RG\tID:b\n@PG\tID:bwa\n@PG\tID:sort\tPP:bwa\n@CO\tfree text: with colons\n"
    h = Header.parse(text)
    assert h.render() == text
    assert h.libraries("none") == [("a", 0), ("b", 1)] and h.references == [("chr1", 10)]
    marked = h.marked("1", "cmd")
    assert marked.of("HD") == [{"VN": "1.6", "SO": "coordinate"}]
    assert marked.of("PG")[-1] == {"ID": "MarkDuplicates", "PN": "MarkDuplicates", "VN": "1", "PP": "sort", "CL": "cmd"}
    assert marked.marked("1", "cmd").of("PG")[-1]["ID"] == "MarkDuplicates.1"


def records():
    odd = read("odd", 0, 1, 50, "3H5S10M2I4D6M", RX="AC-GT")
    odd["tags"] += [{"tag": "NM", "type": "i", "value": "-3"}, {"tag": "XA", "type": "A", "value": "q"}, {"tag": "XB", "type": "B", "value": "s,1,-2,3"}]
    bare = read("bare", 4)
    bare |= {"seq": "*", "qual": [], "cigar": "*"}
    return [*pair("a", 100, 500), *pair("b", 100, 500), odd, bare]


def test_bam_round_trip(spark, tmp_path):
    df, path = table(spark, records()), str(tmp_path / "x.bam")
    write_bam(df, header([("rg", "lib")]), path)
    found, again = read_bam(spark, path)
    assert found.render() == header([("rg", "lib")]).render()
    assert C.compare_alignments(df, again).count() == 0
    assert open(path, "rb").read().endswith(bytes.fromhex("1b0003000000000000000000"))


def test_bad_bam(tmp_path, spark):
    (tmp_path / "x.bam").write_bytes(b"not a bam")
    with pytest.raises(Exception):
        read_bam(spark, str(tmp_path / "x.bam"))
    with pytest.raises(ValueError, match="CRAM"):
        read_bam(spark, "x.cram")


def test_sam(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text("@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:1000\nq1\t99\tchr1\t101\t60\t4M\t=\t201\t104\tACGT\tIIII\tRX:Z:AC\nq2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    h, df = read_sam(spark, str(path))
    a, b = df.orderBy("record_id").collect()
    assert (a.ref_id, a.pos, a.mate_ref_id, a.mate_pos, a.qual, a.tags[0].value) == (0, 100, 0, 200, [40] * 4, "AC")
    assert (b.ref_id, b.pos, b.qual, b.mate_pos) == (None, None, [], None) and h.references == [("chr1", 1000)]


def test_command_line(spark, tmp_path):
    source, out, report = (str(tmp_path / x) for x in ("in.bam", "out.bam", "report.txt"))
    write_bam(table(spark, records()), header(), source)
    run(spark, {"input": source, "output": out, "metrics": report})
    _, df = read_bam(spark, out)
    assert df.where("flags & 1024 <> 0").select("qname").distinct().count() == 1
    assert "READ_PAIR_DUPLICATES" in open(report).read()
    with pytest.raises(ValueError, match="same file"):
        run(spark, {"input": source, "output": source})
    assert compare(spark, out, out, report, report)["passed"]
    assert compare(spark, source, out)["mismatch"]["class"] == "header_text"
    (tmp_path / "other.txt").write_text(open(report).read().replace("Unknown", "Known"))
    assert compare(spark, out, out, report, str(tmp_path / "other.txt"))["mismatch"]["class"] == "metrics_text"


def test_unsorted_input_of_the_other_style(spark, tmp_path):
    source, out = str(tmp_path / "in.bam"), str(tmp_path / "out.bam")
    write_bam(table(spark, [read("b", 0, 1, 5), read("un", 4), read("a", 0, 0, 9), read("c", 0, 0, 9)], sort=False), header(order="unsorted"), source)
    run(spark, {"input": source, "output": out, "sort": True})
    h, df = read_bam(spark, out)
    assert h.sort_order == "coordinate"
    assert [(r.qname, r.flags & 0x400) for r in df.orderBy("record_id").collect()] == [("a", 0), ("c", 0x400), ("b", 0), ("un", 0)]


def test_picard_arguments():
    words = "--INPUT a.bam --OUTPUT b.bam --METRICS_FILE m --VALIDATION_STRINGENCY LENIENT REMOVE_DUPLICATES=true".split()
    found = picard_arguments(words)
    assert found.pop("line").startswith("MarkDuplicates --INPUT a.bam --OUTPUT b.bam --METRICS_FILE m --ASSUME_SORT_ORDER queryname --MAX_SEQUENCES")
    assert found == {"input": "a.bam", "output": "b.bam", "metrics": "m", "remove": True, "sort": True}
    for bad in (["--NO_SUCH", "1"], ["--INPUT", "a.bam"], [*words, "--ASSUME_SORT_ORDER", "sideways"], [*words, "--BARCODE_TAG"]):
        with pytest.raises(ValueError):
            picard_arguments(bad)


def test_picard_options_without_effect():
    words = "--QUIET --INPUT x/a.bam --FLOW_MODE false --showHidden --OUTPUT b.bam -M m -R r/g.fa --arguments_file f --ASSUME_SORT_ORDER coordinate --help".split()
    found = picard_arguments(words)
    line = found.pop("line")
    assert found == {"input": "x/a.bam", "output": "b.bam", "metrics": "m", "reference": "r/g.fa", "assume": "coordinate", "remove": False, "sort": True}
    assert "--INPUT a.bam" in line and "--ASSUME_SORT_ORDER coordinate --REFERENCE_SEQUENCE g.fa --MAX_SEQUENCES" in line
    assert "--REMOVE_DUPLICATES false" in line and line.endswith("--USE_JDK_INFLATER false")
    assert "assume" not in picard_arguments([*words, "--ASSUME_SORT_ORDER", "unsorted"])


def test_compare_command(spark, tmp_path, capsys):
    source, out, report, result = (str(tmp_path / x) for x in ("in.bam", "out.bam", "report.txt", "result.json"))
    write_bam(table(spark, [read("a", 0, 0, 9), read("c", 0, 0, 9)]), header(), source)
    given = picard_arguments(["-I", source, "-O", out, "-M", report])
    run(spark, given)
    lines = open(report).read().split("\n")
    assert lines[1] == "# " + given["line"]
    other = tmp_path / "other.txt"
    other.write_text("\n".join(["# of another day" if x.startswith("# ") else x for x in lines]))
    words = ["--sample-id", "s", "--expected-bam", out, "--actual-bam", out, "--expected-metrics", report, "--actual-metrics", str(other), "--output-json", result]
    assert compared(words) == 1
    found = json.load(open(result))
    assert found["sample_id"] == "s" and found["mismatch"]["class"] == "metrics_text" and found["records_compared"] == 2
    assert found == json.loads(capsys.readouterr().out)
    assert compared([*words, "--metrics-data"]) == 0
    other.write_text(other.read_text().replace("Unknown", "Known"))
    assert compared([*words, "--metrics-data"]) == 1
    assert json.load(open(result))["mismatch"]["class"] == "metrics_data"
    assert compared([out, out]) == 0
    for bad in ([out], [out, out, "--expected-bam", out]):
        with pytest.raises(SystemExit):
            compared(bad)
