"""Small alignment tables, written down like file records."""

from __future__ import annotations

import re

from strandset.schema import ALIGNMENTS
from strandset.sources.header import Header

REFERENCES = [("chr1", 100_000), ("chr2", 100_000)]


def header(read_groups=(), order="coordinate", references=REFERENCES):
    lines = ([f"@HD\tVN:1.6\tSO:{order}"] if order else []) + [f"@SQ\tSN:{n}\tLN:{size}" for n, size in references]
    lines += [f"@RG\tID:{rg}" + (f"\tLB:{lb}" if lb else "") for rg, lb in read_groups]
    return Header.parse("\n".join(lines) + "\n")


def read(qname="read", flags=0, ref=0, pos=None, cigar="100M", mate_ref=None, mate_pos=None, qual=30, rg=None, **tags):
    """A record with a 1-based position; qual: one value for all bases."""
    size = sum(int(n) for n, op in re.findall(r"(\d+)([MIS=X])", cigar))
    listed = [{"tag": k, "type": "Z", "value": v} for k, v in ([("RG", rg)] if rg else []) + list(tags.items())]
    placed = pos is not None
    return {"qname": qname, "flags": flags, "ref_id": ref if placed else None, "pos": pos - 1 if placed else None, "mapq": 60, "cigar": cigar, "mate_ref_id": mate_ref, "mate_pos": None if mate_pos is None else mate_pos - 1, "tlen": 0, "seq": "A" * size, "qual": [qual] * size, "tags": listed}


def pair(qname, pos1, pos2, strands="FR", ref1=0, ref2=0, cigar1="100M", cigar2="100M", qual=30, **more):
    a, b = (16 if s == "R" else 0 for s in strands)
    one = read(qname, 0x41 | a | b * 2, ref1, pos1, cigar1, ref2, pos2, qual, **more)
    two = read(qname, 0x81 | b | a * 2, ref2, pos2, cigar2, ref1, pos1, qual, **more)
    return [one, two]


def table(spark, records, sort=True):
    if sort:
        records = sorted(records, key=lambda r: (r["ref_id"] is None, r["ref_id"] or 0, r["pos"] or 0))
    columns = [x.split()[0].rstrip(":") for x in "record_id,qname,flags,ref_id,pos,mapq,cigar,mate_ref_id,mate_pos,tlen,seq,qual,tags".split(",")]
    rows = [tuple([i if c == "record_id" else [tuple(t.values()) for t in r[c]] if c == "tags" else r[c] for c in columns]) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, ALIGNMENTS)
