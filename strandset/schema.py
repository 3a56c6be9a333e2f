"""The alignment table and the bits of its flags."""

from __future__ import annotations

# Flag bits of the SAM format.
PAIRED = 0x1
UNMAPPED = 0x4
MATE_UNMAPPED = 0x8
REVERSE = 0x10
MATE_REVERSE = 0x20
FIRST = 0x40
SECOND = 0x80
SECONDARY = 0x100
DUPLICATE = 0x400
SUPPLEMENTARY = 0x800

#: record_id is dense, from 0, in file order; pos and mate_pos are 0-based; tags keep the file's order.
ALIGNMENTS = (
    "record_id bigint, qname string, flags int, ref_id int, pos bigint, mapq int, cigar string, mate_ref_id int, mate_pos bigint, "
    "tlen int, seq string, qual array<int>, tags array<struct<tag: string, type: string, value: string>>"
)
