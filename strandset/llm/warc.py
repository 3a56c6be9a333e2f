"""WARC archives in Zstandard: one frame a record, with a dictionary in the leading skippable frame.

Writing: each task makes one archive. It trains a dictionary on its first SAMPLES records, puts it into a skippable frame
(magic DICTIONARY) at the start and compresses each record by it. Spark's text writer makes the files, with an empty
skippable frame, which any decoder passes over, as line separator; so they are committed like any Spark output.

Reading: the archive's frames are found by their block headers, the dictionary is loaded from the leading frame, and each
other frame must hold one whole record whose header fields, block length and SHA-1 digests agree; ValueError otherwise.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest key is the response and the others
revisit it. Defined results: null html is an empty payload; a null url leaves the target out; null keys are smaller than
any other (if all are null, all are responses); of rows with the same payload and the same largest key all are
responses; an empty table gives an empty table; extra columns are ignored. Payloads of any length are kept whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

# Magic numbers of the Zstandard format; the first is that of dictionaries in WARC files.
DICTIONARY = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
#: An empty skippable frame, as text.
GAP = struct.pack("<II", 0x184D2A50, 0).decode("ascii")

MIN_REVISIT = 1000
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4 << 20, 64 << 10
LEVEL = 3
BATCH_BYTES = 4 << 20
# Fixed value: the profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:page:%s>"


def block_of(payload: bytes, whole: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return head + payload if whole else head


def make_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    block = block_of(payload, not revisit)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", RECORD_ID % ("null" if key is None else key)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~")))
    if revisit:
        fields += [("WARC-Refers-To", RECORD_ID % refers_to), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary, or nothing where the samples don't suffice for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_frames(records: Iterable[bytes]) -> Iterator[bytes]:
    """The frames of an archive."""
    first: list[bytes] = []
    total, compress = 0, None

    def begin() -> Iterator[bytes]:
        nonlocal compress
        content = train(first)
        known = zstandard.ZstdCompressionDict(content) if content else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True).compress
        if content:
            yield struct.pack("<II", DICTIONARY, len(content)) + content
        yield from map(compress, first)

    for record in records:
        if compress:
            yield compress(record)
            continue
        first.append(record)
        total += len(record)
        if len(first) >= SAMPLES or total >= SAMPLE_BYTES:
            yield from begin()
    if not compress:
        yield from begin()


def frames(content: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame, found by its blocks' headers."""
    at, n = 0, len(content)
    while at < n:
        if n - at < 8:
            raise ValueError(f"cut frame at byte {at}")
        magic, size = struct.unpack_from("<II", content, at)
        start = at
        if magic in SKIPPABLE:
            at += 8 + size
        elif magic == FRAME:
            at += zstandard.frame_header_size(content[at : at + 18])
            last = False
            while not last:
                head = int.from_bytes(content[at : at + 3], "little")
                if at + 3 > n:
                    raise ValueError(f"cut frame at byte {start}")
                last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
                at += 3 + (1 if kind == 1 else size)
            at += 4 * zstandard.get_frame_parameters(content[start : start + 18]).has_checksum
        else:
            raise ValueError(f"no frame at byte {at}")
        if at > n:
            raise ValueError(f"cut frame at byte {start}")
        yield magic, start, at


def read_records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame but skippable ones."""
    decompress = zstandard.ZstdDecompressor().decompress
    view = memoryview(content)
    for magic, start, end in frames(content):
        if magic == DICTIONARY:
            if start:
                raise ValueError("a dictionary must lead its archive")
            known = bytes(view[8:end])
            if known[:4] == struct.pack("<I", FRAME):  # dictionaries may be compressed themselves
                known = decompress(known)
            decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known)).decompress
        elif magic == FRAME:
            yield start, decompress(view[start:end], allow_extra_data=False)


def digest_of(value: str) -> str:
    """Lower-case hex of a labelled SHA-1 digest, in base 32 or hex."""
    label, _, text = value.partition(":")
    if label.lower() != "sha1":
        raise ValueError(f"unknown digest {value}")
    return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()


def parse_record(record: bytes) -> dict:
    """Fields of a valid record: headers by lower-cased name, block, http head, payload (None for revisits), its length and digest."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise ValueError(f"no {', '.join(sorted(missing))}")
    size = int(headers["content-length"])
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length and block disagree")
    block = rest[:size]
    if (x := headers.get("warc-block-digest")) and digest_of(x) != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest and block disagree")
    out = {"headers": headers, "block": block, "payload": None, "length": None, "digest": None}
    if headers["warc-type"] not in ("response", "revisit"):
        return out
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    out["length"] = int(told[0]) if told else None
    out["digest"] = digest_of(headers["warc-payload-digest"]) if "warc-payload-digest" in headers else None
    if headers["warc-type"] == "revisit":
        if payload:
            raise ValueError("a revisit holds a payload")
        if "warc-refers-to" not in headers or "warc-profile" not in headers:
            raise ValueError("a revisit without profile or target")
        return out
    if told and out["length"] != len(payload):
        raise ValueError("HTTP Content-Length and payload disagree")
    if out["digest"] not in (None, own := hashlib.sha1(payload).hexdigest()):
        raise ValueError("payload digest and payload disagree")
    return out | {"payload": payload, "length": len(payload), "digest": own}


def revisits(pages: DataFrame) -> DataFrame:
    """(key, content, refers_to) of the records that revisit: content is their payload's SHA-256."""
    narrow = pages.where(F.octet_length("payload") >= MIN_REVISIT).select("key", F.sha2("payload", 256).alias("content"))
    best = narrow.groupBy("content").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    return narrow.join(best.drop("n"), "content").where("key is null or key < refers_to").distinct()


def write_warc(df: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Archives under out, one for each task that has rows."""
    pages = df.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    again = materialize(revisits(pages), "warc-revisits").select(F.col("key").alias("again"), "content", "refers_to")
    content = F.when(F.octet_length("payload") >= MIN_REVISIT, F.sha2("payload", 256))
    told = pages.join(again, pages.key.eqNullSafe(again.again) & (content == again.content), "left").select("key", "url", "payload", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                    number, address, payload, refers_to = (x.as_py() for x in row)
                    yield make_record(number, address, payload, refers_to, date)

        held, total = [], 0
        for frame in archive_frames(records()):
            held.append(frame)
            total += len(frame)
            if total >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, total = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    told.mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", GAP).text(out)


def read_warc(spark: SparkSession, path: str, payload: bool = True, glob: str = "*") -> DataFrame:
    """Rows (archive, offset, record_id, record_type, target_uri, date, refers_to, payload_bytes, payload_digest[, payload])."""
    schema = "archive string, offset bigint, record_id string, record_type string, target_uri string, date string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, total = [], 0
                for offset, record in read_records(content.as_buffer().to_pybytes()):
                    try:
                        x = parse_record(record)
                    except ValueError as error:
                        raise ValueError(f"{archive}, byte {offset}: {error}") from error
                    h = x["headers"]
                    row = [archive, offset, h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h["warc-date"], h.get("warc-refers-to"), x["length"], x["digest"]]
                    held.append([*row, x["payload"]] if payload else row)
                    total += len(record)
                    if total >= BATCH_BYTES:
                        yield rows(held)
                        held, total = [], 0
                if held:
                    yield rows(held)

    def rows(held: list[list]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*held, strict=True), schema.split(", "), strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, schema)


def warc_round_trip(df: DataFrame) -> DataFrame:
    """Write a record for each page, read the archives back."""
    out = scratch(df.sparkSession, "warc")
    write_warc(df, out)
    number = lambda x: F.regexp_extract(x, "urn:page:(-?[0-9]+)>", 1)
    key = lambda x: F.when(number(x) != "", number(x)).cast("bigint")
    return read_warc(df.sparkSession, out, payload=False, glob="part-*").select(key(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", key(F.col("refers_to")).alias("refers_to"))
