"""Reading and writing BAM and SAM.

Records are numbered in file order, so a file is decoded as one stream; tables that are used more than once belong into
Parquet. Writing encodes ranges of records in parallel, as compressed blocks that only need to stand one after another.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import ALIGNMENTS
from .header import Header

# Fixed values of the formats: operations, bases, the empty last block, value types of tags.
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
PAYLOAD = 0xFF00
BATCH = 4096


def unzipped(path: str) -> Iterator[bytes]:
    """The contents of a file of gzip members."""
    with open(path, "rb") as f:
        engine, held = zlib.decompressobj(31), b""
        while chunk := held or f.read(1 << 20):
            out = engine.decompress(chunk)
            held = engine.unused_data
            if out:
                yield out
            if engine.eof:
                engine = zlib.decompressobj(31)


class Stream:
    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.data, self.at = parts, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            more = next(self.parts, None)
            if more is None:
                if len(self.data) == self.at:
                    return b""
                raise ValueError("the file ends inside a record")
            self.data, self.at = self.data[self.at :] + more, 0
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def open_bam(path: str) -> tuple[Header, list[str], Stream]:
    stream = Stream(unzipped(path))
    if stream.take(4) != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    header = Header.parse(stream.take(stream.number()).decode())
    names = []
    for _ in range(stream.number()):
        names.append(stream.take(stream.number()).rstrip(b"\0").decode())
        stream.number()
    return header, names, stream


def decode_tags(data: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(data):
        tag, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form = f"<{n}{SIZES[sub]}"
            value = ",".join([sub, *map(str, struct.unpack_from(form, data, at + 5))])
            at += 5 + struct.calcsize(form)
        else:
            form = "<" + SIZES[kind]
            value, at = str(struct.unpack_from(form, data, at)[0]), at + struct.calcsize(form)
        out.append({"tag": tag, "type": kind, "value": value})
    return out


def encode_tags(tags: list[dict]) -> bytes:
    out = b""
    for t in tags or []:
        kind, value = t["type"], t["value"]
        out += t["tag"].encode() + kind.encode()
        if kind == "A":
            out += value.encode()
        elif kind in "ZH":
            out += value.encode() + b"\0"
        elif kind == "B":
            sub, *values = value.split(",")
            out += sub.encode() + struct.pack(f"<i{len(values)}{SIZES[sub]}", len(values), *[float(x) if sub == "f" else int(x) for x in values])
        else:
            out += struct.pack("<" + SIZES[kind], float(value) if kind == "f" else int(value))
    return out


def decode(data: bytes, record_id: int) -> dict:
    ref, pos, name, mapq, _, n_ops, flags, n_seq, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    qname = data[at : at + name - 1].decode()
    at += name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = data[at : at + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
    at += len(packed)
    qual = list(data[at : at + n_seq])
    place = lambda x: None if x < 0 else x
    return {
        "record_id": record_id,
        "qname": None if qname == "*" else qname,
        "flags": flags,
        "ref_id": place(ref),
        "pos": place(pos),
        "mapq": mapq,
        "cigar": "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*",
        "mate_ref_id": place(mate_ref),
        "mate_pos": place(mate_pos),
        "tlen": tlen,
        "seq": seq or "*",
        "qual": [] if qual and set(qual) == {255} else qual,  # absent qualities count as none
        "tags": decode_tags(data[at + n_seq :]),
    }


def reference_bin(begin: int, end: int) -> int:
    """The bin of the format's index scheme that just holds [begin, end): each level is 8 times as fine, from 2^29 to 2^14."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return offset + (begin >> shift)
    return 0


def encode(r: dict) -> bytes:
    name = (r["qname"] or "*").encode() + b"\0"
    ops, number = [], ""
    for ch in "" if r["cigar"] in (None, "*") else r["cigar"]:
        if ch.isdigit():
            number += ch
        else:
            ops.append((int(number), OPERATIONS.index(ch)))
            number = ""
    seq = "" if r["seq"] in (None, "*") else r["seq"]
    codes = [BASES.index(x) if x in BASES else 15 for x in seq.upper()] + [0] * (len(seq) % 2)
    qual = bytes(r["qual"]) if r["qual"] else b"\xff" * len(seq)
    pos = -1 if r["pos"] is None else r["pos"]
    span = sum(n for n, op in ops if op in (0, 2, 3, 7, 8)) or 1
    place = lambda x: -1 if x is None else x
    body = struct.pack("<iiBBHHHiiii", place(r["ref_id"]), pos, len(name), r["mapq"] or 0, reference_bin(pos, pos + span) if pos >= 0 else 4680, len(ops), r["flags"], len(seq), place(r["mate_ref_id"]), place(r["mate_pos"]), r["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual + encode_tags(r["tags"])
    return struct.pack("<i", len(body)) + body


def zipped(data: bytes) -> bytes:
    """BGZF blocks of data."""
    out = []
    for i in range(0, len(data), PAYLOAD):
        part = data[i : i + PAYLOAD]
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = engine.compress(part) + engine.flush()
        out.append(struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


class BamSource(DataSource):
    """spark.read.format("strandset-bam").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "strandset-bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options["path"], schema)


class BamReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.types = path, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        _, _, stream = open_bam(partition.value)
        yield from batches(records(stream), self.types)


def records(stream: Stream) -> Iterator[dict]:
    number = 0
    while size := stream.take(4):
        yield decode(stream.take(struct.unpack("<i", size)[0]), number)
        number += 1


def batches(rows: Iterable[dict], types: StructType) -> Iterator[pa.RecordBatch]:
    schema, held = to_arrow_schema(types), []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_bam(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    if path.endswith(".cram"):
        raise ValueError("CRAM needs its reference and another decoder: convert it to BAM first")
    spark.dataSource.register(BamSource)
    return open_bam(path)[0], spark.read.format("strandset-bam").load(path)


def write_bam(df: DataFrame, header: Header, path: str) -> None:
    """One BAM file in order of record_id. Tasks encode and compress; the driver copies their blocks as they come."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([pa.array([zipped(b"".join(map(encode, batch.to_pylist())))], pa.binary())], ["blocks"])

    text = header.render().encode()
    names = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in header.references)
    columns = "record_id qname flags ref_id pos mapq cigar mate_ref_id mate_pos tlen seq qual tags".split()
    ordered = df.select(*columns).repartitionByRange("record_id").sortWithinPartitions("record_id").mapInArrow(run, "blocks binary")
    with open(path, "wb") as out:
        out.write(zipped(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(header.references)) + names))
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            out.write(row.blocks)
        out.write(LAST_BLOCK)


def parse_sam(lines: Iterable[str], names: dict[str, int], first: int = 0) -> Iterator[dict]:
    """Records of SAM lines, header lines left out."""
    number = first
    for line in lines:
        line = line.rstrip("\r\n")
        if not line or line.startswith("@"):
            continue
        f = line.split("\t")
        tags = [dict(zip(("tag", "type", "value"), x.split(":", 2), strict=True)) for x in f[11:]]
        yield {
            "record_id": number,
            "qname": None if f[0] == "*" else f[0],
            "flags": int(f[1]),
            "ref_id": names.get(f[2]),
            "pos": int(f[3]) - 1 if int(f[3]) > 0 else None,
            "mapq": int(f[4]),
            "cigar": f[5],
            "mate_ref_id": names.get(f[2] if f[6] == "=" else f[6]),
            "mate_pos": int(f[7]) - 1 if int(f[7]) > 0 else None,
            "tlen": int(f[8]),
            "seq": f[9],
            "qual": [] if f[10] == "*" else [ord(x) - 33 for x in f[10]],
            "tags": tags,
        }
        number += 1


class SamSource(DataSource):
    """spark.read.format("strandset-sam").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "strandset-sam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return SamReader(self.options["path"], schema)


class SamReader(BamReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = {name: i for i, (name, _) in enumerate(sam_header(partition.value).references)}
        with open(partition.value) as f:
            yield from batches(parse_sam(f, names), self.types)


def sam_header(path: str) -> Header:
    lines = []
    with open(path) as f:
        for line in f:
            if not line.startswith("@"):
                break
            lines.append(line)
    return Header.parse("".join(lines))


def read_sam(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    spark.dataSource.register(SamSource)
    return sam_header(path), spark.read.format("strandset-sam").load(path)
