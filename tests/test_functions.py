import pytest
from pyspark.sql import functions as F

from strandset.functions import alignment as A
from strandset.functions import numbers as N
from strandset.operators import checks as C
from strandset.options import Options, check_tag


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(*columns).collect()]


def test_unclipped_5prime(spark):
    cases = [
        (1000, "100M", False, 1000), (1000, "5S95M", False, 995), (1000, "3H5S92M", False, 992), (1000, "10H90M", False, 990), (1000, "50M2I48M", False, 1000),
        (1000, "90M10S", True, 1100), (1000, "85M10S5H", True, 1100), (1000, "50M1000N50M5S", True, 2105), (1000, "100M", True, 1100), (1000, "50M5D50M", True, 1105),
        (500, "*", False, 500), (500, "*", True, 500), (500, None, True, 500), (500, "", False, 500),
    ]
    got = values(spark, [c[:3] for c in cases], "pos long, cigar string, reverse boolean", A.unclipped_5prime(F.col("pos"), F.col("cigar"), F.col("reverse")))
    assert [x for (x,) in got] == [c[3] for c in cases]


def test_quality_sum(spark):
    cases = [([30, 25, 20, 35, 40], 150), ([30, 10, 20, 5, 40], 90), ([10, 8, 12, 14, 5], 0), ([], 0), ([15, 14, 15, 14], 30), ([93, 93, 93], 279), (None, 0)]
    got = values(spark, [(q,) for q, _ in cases], "q array<int>", A.quality_sum(F.col("q")))
    assert [x for (x,) in got] == [e for _, e in cases]


def test_hashes(spark):
    cases = {"": 0, "A": 65, "AAAAAAAA": 1094643840, "AGCTAGCT": -2095457618, "agctagct": 1416882862, "AGCT-TGCA": -552756473, "AGCT-AGCT": -553322483, "AGCTTGCA": -2094891608}
    texts = [*cases, None]
    got = values(spark, [(x,) for x in texts], "t string", A.string_hash(F.col("t")), A.barcode_hash(F.col("t")), A.mate_barcode_hash(F.col("t")))
    assert [x for x, _, _ in got] == [*cases.values(), None]
    by = dict(zip(texts, got, strict=True))
    assert (by[None][1:], by[""][1:]) == ((31, 0), (31, 0))
    assert by["AAAAAAAA"][1] == 1094643871 and by["AGCTAGCT"][1] == -2095457587 and by["AAAAAAAA"][2] == 1094643840


def test_umi(spark):
    texts = ["ATCGNatcgn-", "", None, "ATCGX", "ATC1G", "AXY"]
    got = values(spark, [(x,) for x in texts], "t string", A.is_umi(F.col("t")), A.first_bad_umi_character(F.col("t")))
    assert got == [(True, None)] * 3 + [(False, "X"), (False, "1"), (False, "X")]
    with pytest.raises(Exception, match="has character X"):
        values(spark, [("ATCGX",)], "t string", A.checked_umi(F.col("t")))


def test_read_class(spark):
    flags = [4, 4 | 256, 256, 2048, 0, 1 | 8, 1, 1 | 64]
    got = values(spark, [(x,) for x in flags], "f int", A.read_class(F.col("f")))
    assert [x for (x,) in got] == ["unmapped", "unmapped", "secondary", "supplementary", "fragment", "fragment", "paired", "paired"]


def test_molecular_id(spark):
    got = values(spark, [("chr1", 1200), ("chrX", 9876), (None, 0), ("chr1", -1)], "c string, p long", A.molecular_id(F.col("c"), F.col("p")))
    assert [x for (x,) in got] == ["chr1:1200/", "chrX:9876/", "null:0/", "chr1:0/"]


def test_library_size(spark):
    cases = {(90481, 11688): 319364, (90171, 18405): 189677, (5000, 500): 23303, (3, 1): 3, (3, 2): 1, (4, 3): 1, (50000, 0): None, (0, 0): None, (100, 100): None}
    got = values(spark, list(cases), "n long, d long", N.library_size(F.col("n"), F.col("d")))
    assert [x for (x,) in got] == list(cases.values())
    assert [N.library_size_of(*k) for k in cases] == list(cases.values())


def test_percent(spark):
    rows = [(0, 90481, 0, 11688), (0, 50000, 0, 0), (0, 0, 0, 0), (100, 0, 99, 0)]
    got = values(spark, rows, "u long, p long, ud long, pd long", N.percent_duplication(*map(F.col, ("u", "p", "ud", "pd"))))
    assert [round(x, 6) for (x,) in got] == [0.129176, 0, 0, 0.99]
    assert [round(N.percent_of(*r), 6) for r in rows] == [0.129176, 0, 0, 0.99]


def test_trim_float(spark):
    cases = {0.0: "0", 100.0: "100", 0.129176: "0.129176", 1.5: "1.5", 10.0: "10", 0.1: "0.1"}
    got = values(spark, [(x,) for x in cases], "v double", N.trim_float(F.col("v")))
    assert [x for (x,) in got] == list(cases.values()) == [N.trimmed(x) for x in cases]


def order_breaks(places):
    """Record by record: a reference after the tail, a lower reference, a lower place."""
    before, tail, seen, out = None, False, False, []
    for i, (ref, pos) in enumerate(places):
        if ref is None:
            tail, before = tail or seen, None
        else:
            if tail or before and before > (ref, pos):
                out.append(i)
            before = (ref, pos)
        seen = True
    return out


def test_sort_violations(spark):
    import itertools

    spots = [(0, 5), (0, 9), (1, 1), (None, None)]
    for sequence in itertools.islice(itertools.product(spots, repeat=4), 0, None, 7):
        df = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(sequence)], "record_id long, ref_id int, pos long")
        expected = order_breaks(sequence)
        got = sorted(x.record_id for x in C.sort_violations(df).collect())
        assert got[:1] == expected[:1]


def test_options():
    assert check_tag("RX") == "RX" and check_tag("B2") == "B2"
    for bad in ("R", "RXX", "1X", "R-"):
        with pytest.raises(ValueError):
            check_tag(bad)
    with pytest.raises(ValueError, match="needs a barcode tag"):
        Options(molecular_id_tag="MI")
    with pytest.raises(ValueError):
        Options(assume_sort_order="queryname")
