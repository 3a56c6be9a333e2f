"""Column functions over alignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

MIN_QUALITY = 15


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def lengths(cigar: Column, operations: str) -> Column:
    """Sum of the lengths of some CIGAR operations."""
    found = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{operations}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda total, n: total + n.cast("bigint"))


def leading_clip(cigar: Column) -> Column:
    return lengths(F.regexp_extract(cigar, "^((?:[0-9]+[SH])*)", 1), "SH")


def trailing_clip(cigar: Column) -> Column:
    return lengths(F.regexp_extract(cigar, "((?:[0-9]+[SH])*)$", 1), "SH")


def reference_span(cigar: Column) -> Column:
    return lengths(cigar, "MDN=X")


def unclipped_5prime(pos: Column, cigar: Column, reverse: Column) -> Column:
    """Start less leading clips on the forward strand; exclusive end plus trailing clips on the reverse strand."""
    cigar = F.coalesce(cigar, F.lit("*"))
    # Most reads are one aligned stretch: no lists of operations for them.
    plain = cigar.rlike("^[0-9]+M$")
    stretch = F.substring_index(cigar, "M", 1).cast("bigint")
    return F.when(plain, F.when(reverse, pos + stretch).otherwise(pos)).when(reverse, pos + reference_span(cigar) + trailing_clip(cigar)).otherwise(pos - leading_clip(cigar))


def quality_sum(qual: Column) -> Column:
    """Sum of qualities of at least MIN_QUALITY; 0 without any."""
    zero = F.lit(0).cast("bigint")
    return F.coalesce(F.aggregate(qual, zero, lambda total, q: F.when(q >= MIN_QUALITY, total + q).otherwise(total)), zero)


def read_class(flags: Column) -> Column:
    """unmapped, secondary, supplementary, fragment or paired: the first that fits."""
    rules = [(S.UNMAPPED, "unmapped"), (S.SECONDARY, "secondary"), (S.SUPPLEMENTARY, "supplementary")]
    out = reduce(lambda c, rule: c.when(has(flags, rule[0]), rule[1]), rules[1:], F.when(has(flags, rules[0][0]), rules[0][1]))
    return out.when(~has(flags, S.PAIRED) | has(flags, S.MATE_UNMAPPED), "fragment").otherwise("paired")


def int32(value: Column) -> Column:
    """A bigint wrapped to 32 bits, signed."""
    return (F.pmod(value + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def string_hash(text: Column) -> Column:
    """h = 31 h + byte over the bytes of a string, in wrapping 32-bit arithmetic; null for null."""
    as_chars = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.when(text.isNotNull(), F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), as_chars).cast("int"))


def barcode_hash(text: Column) -> Column:
    """The hash of a whole pair's barcode; 31 where there is none."""
    return int32(F.lit(31).cast("bigint") + F.coalesce(string_hash(text), F.lit(0)))


def mate_barcode_hash(text: Column) -> Column:
    """The hash of one mate's barcode; 0 where there is none."""
    return F.coalesce(string_hash(text), F.lit(0))


def is_umi(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("^[ACGTNacgtn-]*$")


def first_bad_umi_character(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "([^ACGTNacgtn-])", 1), F.lit(""))


def checked_umi(text: Column) -> Column:
    """text, or an error that names the first character that no barcode may have."""
    message = F.concat(F.lit("barcode "), text, F.lit(" has character "), first_bad_umi_character(text))
    return F.when(is_umi(text), text).otherwise(F.raise_error(message).cast("string"))


def molecular_id(contig: Column, pos: Column) -> Column:
    """contig:1-based position/ with pos 1-based already; null contig as the word null, positions below 0 as 0."""
    return F.concat(F.coalesce(contig, F.lit("null")), F.lit(":"), F.greatest(F.coalesce(pos, F.lit(0)), F.lit(0)).cast("string"), F.lit("/"))
