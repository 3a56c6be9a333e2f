"""The registered queries over alignments, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import alignment as A
from ..functions import numbers as N
from ..operators import checks as C
from ..operators import marking as M
from ..operators import metrics as R
from ..options import Options
from .alignment_view import alignments, contigs, libraries

PLAIN, UMI, MATES, STREAM = Options(), Options(barcode_tag="RX"), Options(read_one_tag="RX", read_two_tag="RX"), Options(closing="stream")

VIEW = """
b as (select *, cast(round(l_discount * 100) as int) as d, cast(round(l_tax * 100) as int) as t, cast(l_suppkey % 2 as int) as ref_id,
             cast((l_partkey % 20) * 50 + 1000 as bigint) as pos from lineitem),
v as (select row_number() over (order by ref_id, pos, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as record_id,
             cast(l_orderkey as varchar) as qname, ref_id, pos,
             case d when 0 then '2S98M' when 1 then '98M2S' when 2 then '50M100N50M' when 3 then '3H5S92M' when 4 then '50M2I48M' when 5 then '50M5D50M' else '100M' end as cigar,
             list_value(cast(l_quantity as int), 14, 15, l_linenumber * 5) as qual,
             case cast(l_quantity as int) % 5 when 1 then 'AAAAAA' when 2 then 'CCCCCC' when 3 then 'aaaaaa' when 4 then 'AC-GT' end as rx,
             case when l_linenumber = 7 and l_linestatus = 'O' then 'S' else l_returnflag end as rg,
             cast((case when l_linenumber = 7 then 0 else 1 end) + (case when l_linenumber = 7 then 0 when l_linenumber % 2 = 1 then 64 else 128 end)
             + (case when l_suppkey % 4 >= 2 then 16 else 0 end) + (case when d = 10 and t = 8 then 4 else 0 end)
             + (case when d = 8 and t = 8 and l_linenumber < 7 then 8 else 0 end) + (case when d = 9 and t = 0 then 256 else 0 end)
             + (case when d = 9 and t = 1 then 2048 else 0 end) + (case when d = 3 and t = 2 then 1024 else 0 end) as int) as flags
      from b),
c as (select *, case when flags & 4 <> 0 then 'unmapped' when flags & 256 <> 0 then 'secondary' when flags & 2048 <> 0 then 'supplementary'
                     when flags & 1 = 0 or flags & 8 <> 0 then 'fragment' else 'paired' end as class,
             flags & 16 <> 0 as reverse, flags & 64 <> 0 as first_of_pair,
             coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: cast(x as bigint))), 0) as span,
             coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(cigar, '^((?:[0-9]+[SH])*)', 1), '([0-9]+)[SH]', 1), lambda x: cast(x as bigint))), 0) as lead_clip,
             coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(cigar, '((?:[0-9]+[SH])*)$', 1), '([0-9]+)[SH]', 1), lambda x: cast(x as bigint))), 0) as trail_clip,
             cast(coalesce(list_sum(list_filter(qual, lambda q: q >= 15)), 0) as bigint) as score
      from v),
h as (select *, cast(case when reverse then pos + span + trail_clip else pos - lead_clip end as bigint) as uc5,
             case rg when 'A' then 0 when 'N' then 0 when 'R' then 1 when 'S' then 2 else 0 end as library_idx,
             list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(coalesce(rx, ''), ''), lambda x: cast(case when x = '' then 0 else ascii(x) end as bigint))), lambda a, x: case when coalesce(rx, '') = '' then 0 else (a * 31 + x) & 4294967295 end) as raw
      from c),
k as (select *, case when raw >= 2147483648 then raw - 4294967296 else raw end as rx_hash,
             case when ((raw + 31) & 4294967295) >= 2147483648 then ((raw + 31) & 4294967295) - 4294967296 else (raw + 31) & 4294967295 end as rx_barcode from h)
"""


def keyed_sql(barcode: str = "0", mate: str = "0", extra: str = "") -> str:
    """The view, then reads, mates (m), pairs (p) with the winners of their groups, fragments (f)."""
    key = "library_idx, barcode, read1_hash, read2_hash, ref_lo, pos_lo, rev_lo, ref_hi, pos_hi, rev_hi" + (", segment" if extra else "")
    return f"""with {VIEW},
r as (select record_id, qname, rg, ref_id, pos, uc5, reverse, first_of_pair, class, score, library_idx, {barcode} as barcode, {mate} as mate_hash
      from k where class in ('fragment', 'paired')),
n as (select *, row_number() over (partition by rg, qname order by record_id) as arrival, lead(record_id) over (partition by rg, qname order by record_id) as next_id from r where class = 'paired'),
m as (select a.*, z.record_id as z_id, z.ref_id as z_ref, z.pos as z_pos, z.uc5 as z_uc5, z.reverse as z_rev, z.first_of_pair as z_first, z.score as z_score, z.barcode as z_barcode, z.mate_hash as z_hash, z.library_idx as z_lib
      from n a left join n z on z.record_id = a.next_id where a.arrival % 2 = 1),
p0 as (select z_lib as library_idx, z_barcode as barcode, case when z_first then z_hash else mate_hash end as read1_hash, case when z_first then mate_hash else z_hash end as read2_hash,
             case when ref_id < z_ref or (ref_id = z_ref and uc5 < z_uc5) then ref_id else z_ref end as ref_lo, case when ref_id < z_ref or (ref_id = z_ref and uc5 < z_uc5) then uc5 else z_uc5 end as pos_lo,
             case when ref_id < z_ref or (ref_id = z_ref and uc5 < z_uc5) then reverse else z_rev end as lo0,
             case when ref_id < z_ref or (ref_id = z_ref and uc5 < z_uc5) then z_ref else ref_id end as ref_hi, case when ref_id < z_ref or (ref_id = z_ref and uc5 < z_uc5) then z_uc5 else uc5 end as pos_hi,
             case when ref_id < z_ref or (ref_id = z_ref and uc5 < z_uc5) then z_rev else reverse end as hi0,
             score + z_score as score, record_id as id1, z_id as id2, z_ref as later_ref, z_pos as later_pos
       from m where z_id is not null),
p1 as (select *, case when ref_lo = ref_hi and pos_lo = pos_hi and lo0 and not hi0 then false else lo0 end as rev_lo, case when ref_lo = ref_hi and pos_lo = pos_hi and lo0 and not hi0 then true else hi0 end as rev_hi from p0),
{extra or "p as (select * from p1),"}
w as (select *, row_number() over (partition by {key} order by score desc, id1) as place, count(*) over (partition by {key}) as size from p),
f0 as (select *, bool_or(class = 'paired') over fk as marked, count(*) filter (where class = 'fragment') over fk as size,
              row_number() over (partition by library_idx, barcode, ref_id, uc5, reverse, class order by score desc, record_id) as place
       from r window fk as (partition by library_idx, barcode, ref_id, uc5, reverse)),
f as (select * from f0 where class = 'fragment'),
dup as (select id1 as record_id from w where place > 1 union all select id2 from w where place > 1 union all select record_id from f where marked or place > 1),
ct as (select (select count(*) from c where class in ('fragment', 'paired')) - 2 * (select count(*) from p) as unpaired_examined, (select count(*) from p) as pairs_examined,
              (select count(*) from c where class in ('secondary', 'supplementary')) as secondary_or_supplementary, (select count(*) from c where class = 'unmapped') as unmapped,
              (select count(*) from f where marked or place > 1) as unpaired_dups, (select count(*) from w where place > 1) as pair_dups),
sz as (select size as bin, count(*) as sets from (select size from w where place = 1 union all select size from f where place = 1) group by size)
"""


SEGMENTS = """
s1 as (select *, max(later_pos) over (partition by later_ref order by id2 rows between unbounded preceding and 1 preceding) as passed from p1),
s2 as (select *, later_pos >= pos_hi and later_ref = ref_hi as closes from s1),
s3 as (select *, min(case when closes then id2 end) over (partition by library_idx, barcode, read1_hash, read2_hash, ref_lo, pos_lo, rev_lo, ref_hi, pos_hi, rev_hi) as first_close from s2),
p as (select *, case when not closes or (id2 = first_close and coalesce(passed, -1) < pos_hi) then 0 else id2 + 1 end as segment from s3),
"""
LIBRARY_SIZE = """
  case when {n} > 0 and {d} > 0 and {d} < {n} then (
    select cast(floor(({n} - {d}) * (z.lo + z.hi) / 2) as bigint) from (
      select list_reduce(list_prepend({{'lo': 1.0::double, 'hi': list_filter(list_transform(range(2, 13), lambda i: pow(10.0, i)), lambda x: not (1 / x - 1 + exp(-{n} / (x * ({n} - {d}))) > 0))[1]}}, list_transform(range(40), lambda i: {{'lo': 0.0::double, 'hi': 0.0::double}})),
        lambda s, i: {{'lo': case when 1 / ((s.lo + s.hi) / 2) - 1 + exp(-{n} / (((s.lo + s.hi) / 2) * ({n} - {d}))) >= 0 then (s.lo + s.hi) / 2 else s.lo end,
                    'hi': case when 1 / ((s.lo + s.hi) / 2) - 1 + exp(-{n} / (((s.lo + s.hi) / 2) * ({n} - {d}))) <= 0 then (s.lo + s.hi) / 2 else s.hi end}}) as z))
  end"""
PERCENT = "case when unpaired_examined + 2 * pairs_examined = 0 then 0.0 else (unpaired_dups + 2 * pair_dups)::double / (unpaired_examined + 2 * pairs_examined) end"


def library_size_sql(n: str, d: str) -> str:
    return LIBRARY_SIZE.format(n=f"{n}::double", d=f"{d}::double")


def reads_of(spark: SparkSession, sf_dir: str, options: Options = PLAIN) -> DataFrame:
    return M.keyed_reads(alignments(spark, sf_dir), libraries(spark), options)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


@query(f"with {VIEW} select record_id, class from c")
def classify_reads(spark, sf_dir):
    return alignments(spark, sf_dir).select("record_id", A.read_class(F.col("flags")).alias("class"))


@query(f"with {VIEW} select record_id, uc5 from h")
def unclipped_5prime(spark, sf_dir):
    return alignments(spark, sf_dir).select("record_id", A.unclipped_5prime(F.col("pos"), F.col("cigar"), A.has(F.col("flags"), S.REVERSE)).alias("uc5"))


@query(f"with {VIEW} select record_id, score as quality_sum from c")
def quality_sum(spark, sf_dir):
    return alignments(spark, sf_dir).select("record_id", A.quality_sum(F.col("qual")).alias("quality_sum"))


@query(f"with {VIEW} select record_id, cast(rx_hash as int) as hash from k where rx is not null")
def java_string_hash(spark, sf_dir):
    return alignments(spark, sf_dir).where("rx is not null").select("record_id", A.string_hash(F.col("rx")).alias("hash"))


@query(f"with {VIEW} select record_id, cast(rx_barcode as int) as pair_hash, cast(rx_hash as int) as mate_hash from k")
def barcode_hash_variants(spark, sf_dir):
    return alignments(spark, sf_dir).select("record_id", A.barcode_hash(F.col("rx")).alias("pair_hash"), A.mate_barcode_hash(F.col("rx")).alias("mate_hash"))


@query("select c_custkey as id, regexp_matches(c_mktsegment, '^[ACGTNacgtn-]*$') as valid, nullif(regexp_extract(c_mktsegment, '([^ACGTNacgtn-])', 1), '') as first_bad from customer")
def umi_validation_report(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return found.select(F.col("c_custkey").alias("id"), A.is_umi(F.col("c_mktsegment")).alias("valid"), A.first_bad_umi_character(F.col("c_mktsegment")).alias("first_bad"))


@query(f"with {VIEW} select rg, library_idx, count(*) as reads from h where class in ('fragment', 'paired') group by rg, library_idx")
def library_lookup(spark, sf_dir):
    return reads_of(spark, sf_dir).groupBy(F.col("read_group").alias("rg"), "library_idx").agg(F.count(F.lit(1)).alias("reads"))


@query(keyed_sql() + "select record_id as id1, z_id as id2 from m where z_id is not null")
def mate_pairing(spark, sf_dir):
    return M.mates(reads_of(spark, sf_dir)).where("later is not null").select(F.col("record_id").alias("id1"), F.col("later.record_id").alias("id2"))


@query(keyed_sql() + "select record_id, rg as read_group, qname from m where z_id is null")
def orphan_reads(spark, sf_dir):
    return M.orphans(reads_of(spark, sf_dir))


@query(keyed_sql() + """select coalesce(max(waiting), 0)::bigint as peak from (select sum(case when arrival % 2 = 1 then 1 else -1 end) over (order by record_id rows unbounded preceding) as waiting from n)""")
def peak_pending_mates(spark, sf_dir):
    return C.peak_pending(M.mates(reads_of(spark, sf_dir)))


@query(keyed_sql() + "select id1, id2, library_idx, ref_lo, pos_lo, rev_lo, ref_hi, pos_hi, rev_hi, score from p")
def pair_keys(spark, sf_dir):
    return M.pairs(reads_of(spark, sf_dir)).select("id1", "id2", "library_idx", "ref_lo", "pos_lo", "rev_lo", "ref_hi", "pos_hi", "rev_hi", "score")


@query(keyed_sql() + "select id1 as winner, size from w where place = 1")
def pair_winners(spark, sf_dir):
    return M.pair_groups(M.pairs(reads_of(spark, sf_dir))).select("winner", "size")


@query(keyed_sql() + "select id1, id2 from w where place > 1")
def pair_duplicates(spark, sf_dir):
    return M.pair_duplicates(M.pairs(reads_of(spark, sf_dir)))


@query(keyed_sql() + "select library_idx, ref_id, uc5, reverse, count(*) as markers from r where class = 'paired' group by library_idx, ref_id, uc5, reverse")
def fragment_markers(spark, sf_dir):
    return reads_of(spark, sf_dir).where("paired").groupBy("library_idx", "ref_id", "uc5", "reverse").agg(F.count(F.lit(1)).alias("markers"))


@query(keyed_sql() + "select record_id, marked as by_marker from f where marked or place > 1")
def fragment_duplicates(spark, sf_dir):
    return M.fragment_duplicates(M.prepared(reads_of(spark, sf_dir)))


@query(keyed_sql() + "select record_id from dup")
def duplicate_record_ids(spark, sf_dir):
    return M.duplicate_ids(M.prepared(reads_of(spark, sf_dir)))


@query(keyed_sql() + "select count(distinct record_id) as duplicates from dup")
def duplicate_set_size(spark, sf_dir):
    return M.duplicate_ids(M.prepared(reads_of(spark, sf_dir))).agg(F.count_distinct("record_id").alias("duplicates"))


FLAGGED = "case when dup.record_id is null then v.flags & ~1024 else v.flags | 1024 end"


@query(keyed_sql() + f"select v.record_id, v.qname, cast({FLAGGED} as int) as flags, v.ref_id, v.pos from v left join dup using (record_id)")
def flagged_records(spark, sf_dir):
    rows = alignments(spark, sf_dir)
    found = M.duplicate_ids(M.prepared(M.keyed_reads(rows, libraries(spark))))
    return M.flag_duplicates(rows.select("record_id", "qname", "flags", "ref_id", "pos"), found)


@query(keyed_sql() + "select record_id, qname, flags & ~1024 as flags from v where record_id not in (select record_id from dup)")
def remove_duplicates(spark, sf_dir):
    rows = alignments(spark, sf_dir)
    found = M.duplicate_ids(M.prepared(M.keyed_reads(rows, libraries(spark))))
    return M.flag_duplicates(rows.select("record_id", "qname", "flags"), found, remove=True)


@query(keyed_sql(barcode="rx_barcode") + "select id1, id2 from w where place > 1")
def umi_pair_duplicates(spark, sf_dir):
    return M.pair_duplicates(M.pairs(reads_of(spark, sf_dir, UMI)))


@query(keyed_sql(barcode="rx_barcode") + "select record_id, marked as by_marker from f where marked or place > 1")
def umi_fragment_duplicates(spark, sf_dir):
    return M.fragment_duplicates(reads_of(spark, sf_dir, UMI))


@query(keyed_sql(mate="rx_hash") + "select id1, id2, read1_hash, read2_hash, place > 1 as is_duplicate from w")
def read12_barcode_pairs(spark, sf_dir):
    found = M.pairs(reads_of(spark, sf_dir, MATES))
    lost = M.pair_duplicates(found).select("id1", F.lit(True).alias("lost"))
    return found.join(lost, "id1", "left").select("id1", "id2", "read1_hash", "read2_hash", F.coalesce("lost", F.lit(False)).alias("is_duplicate"))


@query(keyed_sql() + "select bin, sets from sz")
def group_size_histogram(spark, sf_dir):
    return M.group_sizes(M.prepared(reads_of(spark, sf_dir)))


@query(keyed_sql() + "select unpaired_examined, pairs_examined, secondary_or_supplementary, unmapped, unpaired_dups, pair_dups from ct")
def duplication_counters(spark, sf_dir):
    rows = alignments(spark, sf_dir)
    return R.counters(rows, M.prepared(M.keyed_reads(rows, libraries(spark))))


@query(keyed_sql() + f"select round({PERCENT}, 6) as percent_duplication from ct")
def percent_duplication(spark, sf_dir):
    return R.with_rates(duplication_counters(spark, sf_dir)).select(F.round("percent_duplication", 6).alias("percent_duplication"))


@query(f"select o_orderkey as id, {library_size_sql('(o_orderkey % 5000 + 2)', '(o_custkey % 400)')} as library_size from orders")
def library_size_estimate(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("id"), N.library_size(F.col("o_orderkey") % 5000 + 2, F.col("o_custkey") % 400).alias("library_size"))


@query(keyed_sql() + f"""select bin, round(case when bin <= 100 then size * (1 - exp(-bin * n / size)) / u else 0.0 end, 6) as coverage_mult, sets as all_sets, sets as non_optical_sets
from sz, (select {library_size_sql('pairs_examined', 'pair_dups')}::double as size, pairs_examined::double as n, (pairs_examined - pair_dups)::double as u from ct) where size is not null""")
def roi_histogram(spark, sf_dir):
    rows = alignments(spark, sf_dir)
    reads = M.prepared(M.keyed_reads(rows, libraries(spark)))
    return R.roi_histogram(R.counters(rows, reads), M.group_sizes(reads)).withColumn("coverage_mult", F.round("coverage_mult", 6))


@query(keyed_sql() + f"""select library_idx, unpaired_examined, pairs_examined, unpaired_dups, pair_dups, round({PERCENT}, 6) as percent_duplication, {library_size_sql('pairs_examined', 'pair_dups')} as library_size
from (select l.library_idx, (select count(*) from r where class = 'fragment' and library_idx = l.library_idx) + (select count(*) from m where z_id is null and library_idx = l.library_idx) as unpaired_examined,
  (select count(*) from p where library_idx = l.library_idx) as pairs_examined, (select count(*) from f where (marked or place > 1) and library_idx = l.library_idx) as unpaired_dups,
  (select count(*) from w where place > 1 and library_idx = l.library_idx) as pair_dups from (select distinct library_idx from r) l)""")
def per_library_metrics(spark, sf_dir):
    found = R.with_rates(R.library_counters(M.prepared(reads_of(spark, sf_dir))))
    return found.withColumn("percent_duplication", F.round("percent_duplication", 6))


@query(keyed_sql() + f""",
one as (select ct.*, {PERCENT} as percent, {library_size_sql('pairs_examined', 'pair_dups')} as size from ct),
bins as (select row_number() over (order by bin) as k, bin, sets,
             case when bin <= 100 and size > 0 then size * (1 - exp(-bin::double * pairs_examined / size::double)) / (pairs_examined - pair_dups) else 0.0 end as cover
      from sz, one where size is not null and bin >= 1 and sets > 0),
lines as (select 1 as line, '## htsjdk.samtools.metrics.StringHeader' as text union all select 2, '# strandset INPUT=lineitem OUTPUT=stdout'
      union all select 3, '## htsjdk.samtools.metrics.StringHeader' union all select 5, '' union all select 6, '## METRICS CLASS' || chr(9) || 'picard.sam.DuplicationMetrics'
      union all select 7, '{"' || chr(9) || '".join(R.COLUMNS)}'
      union all select 8, concat_ws(chr(9), 'lib1', unpaired_examined, pairs_examined, secondary_or_supplementary, unmapped, unpaired_dups, pair_dups, 0,
                                    regexp_replace(format('{{:.6f}}', percent::double), '\\.?0+$', ''), coalesce(size::bigint::varchar, '')) from one
      union all select 9, '' union all select 10, '## HISTOGRAM' || chr(9) || 'java.lang.Double' from one where size is not null
      union all select 11, concat_ws(chr(9), 'BIN', 'CoverageMult', 'all_sets', 'non_optical_sets') from one where size is not null
      union all select 11 + k, concat_ws(chr(9), format('{{:.1f}}', bin::double), regexp_replace(format('{{:.6f}}', cover), '\\.?0+$', ''), sets, sets) from bins)
select line::int as line, text from lines
union all select ((select max(line) from lines) + i)::int, '' from (select unnest([1, 2]) as i)""")
def metrics_report_text(spark, sf_dir):
    rows = alignments(spark, sf_dir)
    reads = M.prepared(M.keyed_reads(rows, libraries(spark)))
    counts = R.counters(rows, reads).first().asDict()
    text = R.report_text(counts, [tuple(x) for x in M.group_sizes(reads).collect()], "lib1", "strandset INPUT=lineitem OUTPUT=stdout")
    lines = [(i + 1, x) for i, x in enumerate(text.split("\n")) if not x.startswith("# Started on")]
    return spark.createDataFrame(lines, "line int, text string")


@query(f"""with {VIEW},
x as (select record_id, case when record_id % 997 = 5 then null else ref_id end as ref_id, case when record_id % 101 = 3 then pos - 60 else pos end as pos from v),
y as (select record_id, ref_id, pos, lag(ref_id) over o as lr, lag(pos) over o as lp, max(case when ref_id is null and record_id >= 1 then 1 else 0 end) over (order by record_id rows between unbounded preceding and 1 preceding) as tail from x window o as (order by record_id))
select record_id from y where ref_id is not null and (coalesce(tail, 0) > 0 or (lr is not null and (lr > ref_id or (lr = ref_id and lp > pos))))""")
def sort_order_violations(spark, sf_dir):
    spoiled = alignments(spark, sf_dir).select("record_id", F.when(F.col("record_id") % 997 != 5, F.col("ref_id")).alias("ref_id"), F.when(F.col("record_id") % 101 == 3, F.col("pos") - 60).otherwise(F.col("pos")).alias("pos"))
    return C.sort_violations(spoiled)


@query(keyed_sql() + """, mp as (select id1 as record_id, later_pos as mate_pos from p union all select id2, v.pos from p join v on v.record_id = id1)
select v.record_id, concat(case ref_id when 0 then 'chr1' when 1 then 'chr2' else 'null' end, ':', cast(greatest((case when flags & 16 <> 0 then pos else coalesce(mate_pos, -1) end) + 1, 0) as varchar), '/') as mi
from v left join mp using (record_id)""")
def mi_tags(spark, sf_dir):
    rows = alignments(spark, sf_dir)
    met = M.mates(M.prepared(M.keyed_reads(rows, libraries(spark)))).where("later is not null")
    ends = F.explode(F.array(F.struct("record_id", F.col("later.pos").alias("mate_pos")), F.struct(F.col("later.record_id").alias("record_id"), F.col("pos").alias("mate_pos"))))
    places = met.select(ends.alias("x")).select("x.*")
    return C.molecular_ids(rows.select("record_id", "flags", "ref_id", "pos").join(places, "record_id", "left"), contigs(spark))


@query(f"with {VIEW} select record_id, concat_ws('|', 'RG:Z:' || rg, 'RX:Z:' || rx, 'PG:Z:MarkDuplicates') as tags from v")
def clear_dt_set_pg(spark, sf_dir):
    tag = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("tag"), F.lit("Z").alias("type"), value.alias("value")))
    made = F.array_compact(F.array(tag("RG", F.col("rg")), tag("DT", F.lit("LB")), tag("RX", F.col("rx")), tag("PG", F.lit("aligner"))))
    tags = C.replace_tags(made, ["DT"], [("PG", "Z", F.lit("MarkDuplicates"))])
    return alignments(spark, sf_dir).select("record_id", F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"])), "|").alias("tags"))


@query(f"""with {VIEW}, q as (select *, regexp_replace(cigar, '[0-9]+H', '', 'g') as soft from c where flags & 260 = 0),
x as (select ref_id, reverse, case when reverse then pos + 1 + span - 1 + coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(soft, '((?:[0-9]+S)*)$', 1), '([0-9]+)S', 1), lambda x: cast(x as bigint))), 0)
  else pos + 1 - coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(soft, '^((?:[0-9]+S)*)', 1), '([0-9]+)S', 1), lambda x: cast(x as bigint))), 0) end as uc5 from q)
select ref_id, cast(uc5 as bigint) as uc5, reverse, count(*) as reads from x group by all order by reads desc, ref_id, uc5, reverse limit 1""")
def max_five_prime_bucket(spark, sf_dir):
    return C.largest(C.five_prime_buckets(alignments(spark, sf_dir)), "reads", ["ref_id", "uc5", "reverse"])


@query(f"""with {VIEW}, q as (select ref_id, pos, regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1) as n, regexp_extract_all(cigar, '[0-9]+([MDN=X])', 1) as o from v where flags & 1796 = 0),
s as (select ref_id, o[i] as op, pos + coalesce(list_sum(list_transform(n[1:i - 1], lambda x: cast(x as bigint))), 0) as a, cast(n[i] as bigint) as w from (select *, unnest(range(1, len(n) + 1)) as i from q)),
e as (select ref_id, pos, sum(step) as step from (select ref_id, a as pos, 1 as step from s where op in ('M', '=', 'X') union all select ref_id, a + w, -1 from s where op in ('M', '=', 'X')) group by all),
d as (select ref_id, pos, sum(step) over (partition by ref_id order by pos) as depth from e)
select ref_id, cast(pos as bigint) as pos, cast(depth as bigint) as depth from d order by depth desc, ref_id, pos limit 1""")
def max_base_depth(spark, sf_dir):
    return C.largest(C.base_depths(alignments(spark, sf_dir)), "depth", ["ref_id", "pos"])


@query(keyed_sql() + f"""select coalesce(a.record_id, z.record_id) as record_id, case when a.record_id is null or z.record_id is null then 'record_count' when a.flags <> z.flags then 'flags' else 'pos' end as field
from (select case when record_id % 1000 = 7 then -1 - record_id else record_id end as record_id, flags, pos from v) a full join (select v.record_id, {FLAGGED} as flags, case when v.record_id % 500 = 3 then pos + 1 else pos end as pos from v left join dup using (record_id)) z using (record_id)
where a.record_id is null or z.record_id is null or a.flags <> z.flags or a.pos <> z.pos""")
def compare_alignments(spark, sf_dir):
    rows = alignments(spark, sf_dir).select("record_id", "qname", "flags", "ref_id", "pos")
    marked = flagged_records(spark, sf_dir).withColumn("pos", F.when(F.col("record_id") % 500 == 3, F.col("pos") + 1).otherwise(F.col("pos")))
    rows = rows.withColumn("record_id", F.when(F.col("record_id") % 1000 == 7, -1 - F.col("record_id")).otherwise(F.col("record_id")))
    return C.compare_alignments(rows, marked).select("record_id", "field")


@query(keyed_sql() + f"""select qname, is_duplicate, 'expected' as side from (select qname, flags & 1024 <> 0 as is_duplicate from v except all select v.qname, ({FLAGGED}) & 1024 <> 0 from v left join dup using (record_id))
union all select qname, is_duplicate, 'actual' from (select v.qname, ({FLAGGED}) & 1024 <> 0 as is_duplicate from v left join dup using (record_id) except all select qname, flags & 1024 <> 0 from v)""")
def flag_set_diff(spark, sf_dir):
    return C.flag_set_diff(alignments(spark, sf_dir).select("qname", "flags"), flagged_records(spark, sf_dir))


@query(keyed_sql(extra=SEGMENTS) + "select id1, id2, place > 1 as is_duplicate from w")
def stream_closing_pairs(spark, sf_dir):
    found = M.keyed_pairs(reads_of(spark, sf_dir, STREAM), STREAM)
    lost = M.pair_duplicates(found, STREAM).select("id1", F.lit(True).alias("lost"))
    return found.select("id1", "id2").join(lost, "id1", "left").select("id1", "id2", F.coalesce("lost", F.lit(False)).alias("is_duplicate"))
