"""Token-id files in Simple-8b coding.

A file is a row of segments, each followed by END. A segment is a header of little-endian unsigned 64-bit integers
(MAGIC, partition, documents, ids, blocks, words), the documents' keys, a byte for each that tells null keys, their id
counts, the first word of each block, and the words. Blocks hold BLOCK ids and are packed independently, so a reader
can start at any block, and all words of a segment are unpacked together, by selector. Selector 0 escapes to a raw
64-bit word, for ids of more than 60 bits.

Spark's text writer makes the files: a segment is a row, END its line separator. So they are committed as any Spark
output is, to any file system, and lost executors cost nothing but time.

Defined results: a null text counts as empty (one end id); null keys sort first; rows with equal keys stay separate,
in any order among them; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WHITE_SPACE, PieceCache
from .common import materialize, scratch, text_slices

CHUNK_CHARS = 1 << 19
#: Ids of a block, and of one in a file: small enough that many blocks of a text are packed side by side.
BLOCK, FILE_BLOCK = 1024, 256
MAGIC = int.from_bytes(b"S8BSEG01", "little")
END = "S8B-END\n"
#: Bits and ids a word by selector; 0 escapes, 1 is not in use.
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)


def pack_words(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the end) of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    rows = -(-n // block)
    size = np.full(rows, block, np.int64)
    size[-1] = n - (rows - 1) * block
    padded = np.zeros(rows * block + 64, np.uint64)
    padded[:n] = values
    width = np.frexp(padded.astype(np.float64))[1].astype(np.uint8)  # bits of each value, or one more for huge ones
    # All blocks choose their words' selectors side by side. A look at the next few values settles most.
    near = np.arange(10)
    at, alive = np.zeros(rows, np.int64), np.arange(rows)
    chosen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(alive):
        base = alive * block + at[alive]
        left = size[alive] - at[alive]
        seen = width[base[:, None] + near]
        seen[near >= left[:, None]] = 0
        top = np.maximum.accumulate(seen, axis=1)
        s = np.zeros(len(alive), np.int64)
        for x in range(15, 6, -1):  # from few wide values to many narrow ones
            s[top[:, COUNTS[x] - 1] <= BITS[x]] = x
        small = np.flatnonzero(s == 7)
        if len(small):
            far = np.arange(60)
            wide = width[base[small, None] + far]
            wide[far >= left[small, None]] = 0
            top = np.maximum.accumulate(wide, axis=1)
            for x in range(6, 1, -1):
                s[small[top[:, COUNTS[x] - 1] <= BITS[x]]] = x
        take = np.minimum(COUNTS[s], left)
        chosen.append((base, s, take))
        at[alive] += take
        alive = alive[at[alive] < size[alive]]
    base, selector, take = (np.concatenate(x) for x in zip(*chosen, strict=True))
    order = np.argsort(base)
    base, selector, take = base[order], selector[order], take[order]
    word = np.zeros(len(base), np.uint64)
    for s in np.unique(selector[selector > 0]):
        which = np.flatnonzero(selector == s)
        lane = np.arange(COUNTS[s])
        ids = padded[base[which, None] + lane]
        ids[lane >= take[which, None]] = 0
        word[which] = np.bitwise_or.reduce(ids << (lane.astype(np.uint64) * np.uint64(BITS[s])), axis=1) | (np.uint64(s) << np.uint64(60))
    raw = np.flatnonzero(selector == 0)
    per = np.bincount(base // block, weights=1 + (selector == 0), minlength=rows)
    starts = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    return np.insert(word, raw + 1, padded[base[raw]]), starts


def unpack_words(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values of packed words."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    escape = selector == 0
    if escape.any():  # what follows an escape is a value, whatever its top bits
        raw = np.zeros(len(words), bool)
        i = 0
        for i in np.flatnonzero(escape).tolist():
            if not raw[i]:
                raw[i + 1] = True
        counts = np.where(raw, 1, np.where(escape, 0, COUNTS[selector]))
    else:
        raw, counts = escape, COUNTS[selector]
    if (counts[~raw & ~escape] == 0).any():
        raise ValueError("unknown selector")
    # A block's last word may hold fewer ids than its selector allows.
    rows = len(starts) - 1
    size = np.full(rows, block, np.int64)
    if rows:
        size[-1] = n - (rows - 1) * block
    begin = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(rows), np.diff(starts))
    place = begin - begin[starts[:-1]][owner]
    counts = np.minimum(counts, size[owner] - place)
    if rows and (np.add.reduceat(counts, starts[:-1]) != size).any():
        raise ValueError("a block's words do not hold its ids")
    place += owner * block
    out = np.zeros(n, np.uint64)
    out[place[raw]] = words[raw]
    for s in np.unique(selector[~raw & ~escape]):
        which = np.flatnonzero((selector == s) & ~raw)
        lane = np.arange(COUNTS[s])
        got = (words[which, None] >> (lane.astype(np.uint64) * np.uint64(BITS[s]))) & np.uint64((1 << int(BITS[s])) - 1)
        keep = lane < counts[which, None]
        out[(place[which, None] + lane)[keep]] = got[keep]
    return out


def write_segment(keys: list[int | None], ids: list[np.ndarray], partition: int) -> bytes:
    counts = np.fromiter(map(len, ids), "<u8", len(ids))
    values = np.concatenate(ids) if ids else np.empty(0, np.uint64)
    words, starts = pack_words(values, FILE_BLOCK)
    header = np.array([MAGIC, partition, len(ids), len(values), len(starts) - 1, len(words)], "<u8")
    named = np.array([0 if x is None else x for x in keys], "<i8")
    null = np.array([x is None for x in keys], "u1")
    return b"".join(x.tobytes() for x in (header, named, null, counts, starts.astype("<u8"), words.astype("<u8")))


def read_segments(content: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(partition, keys, null keys, id counts, ids) of each segment; whatever does not fit raises ValueError."""
    at, end = 0, END.encode()
    while at < len(content):
        if len(content) - at < 48:
            raise ValueError("cut header")
        magic, partition, docs, n, blocks, n_words = np.frombuffer(content, "<u8", 6, at).tolist()
        total = 48 + 17 * docs + 8 * (blocks + 1 + n_words)
        if magic != MAGIC or content[at + total : at + total + len(end)] != end:
            raise ValueError(f"no whole segment at byte {at}")
        at += 48
        keys = np.frombuffer(content, "<i8", docs, at)
        null = np.frombuffer(content, "u1", docs, at + 8 * docs).astype(bool)
        counts = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
        starts = np.frombuffer(content, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)
        words = np.frombuffer(content, "<u8", n_words, at + 17 * docs + 8 * (blocks + 1))
        if counts.sum() != n or starts[-1] != n_words:
            raise ValueError("counts of a segment disagree")
        yield partition, keys, null, counts, unpack_words(words, starts, n, FILE_BLOCK)
        at += total - 48 + len(end)


#: Letters of one case mapping that normalisation leaves alone.
PLAIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u017e"
GAP = "".join(map(re.escape, map(chr, WHITE_SPACE)))
GAP_BUT_BLANK = "".join(re.escape(chr(x)) for x in WHITE_SPACE if x != 0x20)
CUT = "\x01"
#: Byte-level vocabularies write printable bytes as themselves, and the others, in order, as the characters from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


class LibraryTokenizer:
    """A tokenizers file behind a cache. Texts fall into pieces that pre-tokenisation never joins, each encoded once.

    Most texts can be cut before every blank, comma and full stop: where a letter or digit stands before each comma and
    stop, and no blank stands between white space. Others are cut by a pattern, at white space only. Byte-level files
    ("bytes") take a blank before a piece as its part and encode other white space; files for words drop it.

    The strings of added tokens, such as "<|endoftext|>", are ordinary text, unless `added`: then they get the tokens' ids,
    as from the library by default, which encodes texts that hold one whole.
    """

    def __init__(self, path: str, by: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own, self.by, self.cache = Tokenizer.from_file(path), by, PieceCache()
        self.own.encode_special_tokens = not added
        self.added = [x.content for x in self.own.get_added_tokens_decoder().values()] if added else []
        word = f"[^{GAP}]+"
        self.plain = re.compile(f" ?[{PLAIN}]+" if by == "bytes" else f"[{PLAIN}]+").fullmatch
        self.pattern = re.compile(f" ?{word}|[{GAP}]+(?![^{GAP}])|[{GAP}]+?(?=[{GAP}]?[^{GAP}])" if by == "bytes" else word).findall
        self.unsafe = re.compile(f"[,.{CUT}](?<![{PLAIN}0-9][,.])").search
        # What str.split takes for white space and normalisation does not; a blank between white space.
        self.odd_ascii = "\x1c\x1d\x1e\x1f" if by != "bytes" else ["\t ", "\n ", "\x0b ", "\x0c ", "\r "]
        self.odd = re.compile("[\x1c-\x1f]" if by != "bytes" else f"[{GAP_BUT_BLANK}] (?:[{GAP}]|\\Z)").search

    def pieces(self, text: str) -> list[str]:
        if self.unsafe(text) or not text.isascii() and self.odd(text):
            return self.pattern(text)
        if text.isascii() and any(x in text for x in self.odd_ascii):
            return self.pattern(text)
        if self.by == "bytes":
            if "  " in text:
                return self.pattern(text)
            return text.replace(" ", CUT + " ").replace(",", CUT + ",").replace(".", CUT + ".").split(CUT)
        return text.replace(",", " ,").replace(".", " .").split()

    def unseen(self, pieces: list[str]) -> list[list[int]]:
        """Plain words are one pre-token each: the library's model takes them as they are. The rest is encoded in full."""
        merges, plain = self.own.model.tokenize, self.plain
        out: list = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            if plain(piece):
                text = piece if self.by == "bytes" else piece.lower()
                out[i] = [x.id for x in merges(text.encode().decode("latin-1").translate(BYTE_CHARACTERS))]
            else:
                rest.append(i)
        for i, found in zip(rest, self.own.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [i for i, x in enumerate(texts) if any(s in x for s in self.added)]
        found = [self.pieces(x) for x in texts]
        for i in marked:
            found[i] = []
        first = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        ids = self.cache.ids(list(chain.from_iterable(found)), first, self.unseen)
        for i in marked:
            ids[i] = np.array(self.own.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return ids


@functools.cache
def library_tokenizer(path: str, by: str, added: bool) -> LibraryTokenizer:
    return LibraryTokenizer(path, by, added)


def encoded(batches: Iterable[pa.RecordBatch], path: str, by: str, end: int, added: bool = False) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and ids, each text's ids followed by the end id, of (key, text) batches."""
    own, last = library_tokenizer(path, by, added), np.array([end], "<u4")
    for batch in batches:
        for part, texts in text_slices(batch, 1, CHUNK_CHARS):
            yield part.column(0).to_pylist(), [np.concatenate([x, last]) for x in own.encode(texts)]


def in_key_order(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text").repartitionByRange("key").sortWithinPartitions("key")


def write_token_files(df: DataFrame, out: str, encode: Callable, key: str = "doc_id", text: str = "text") -> None:
    """Files under out, in ascending order of key; encode turns (key, text) batches into keys and ids."""

    def run(batches):
        partition = TaskContext.get().partitionId()
        for keys, ids in encode(batches):
            yield pa.RecordBatch.from_arrays([pa.array([write_segment(keys, ids, partition)], pa.binary())], ["segment"])

    in_key_order(df, key, text).mapInArrow(run, "segment binary").select(F.col("segment").cast("string")).write.option("lineSep", END).text(out)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids or ids_crc32) of token-id files; start counts the ids of all documents before."""
    kind = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                start = 0
                for partition, keys, null, counts, ids in read_segments(content.as_buffer().to_pybytes()):
                    stop = np.cumsum(counts)
                    spans = list(zip((stop - counts).tolist(), stop.tolist(), strict=True))
                    if digest:
                        plain = ids.astype("<u4")
                        shown = pa.array([zlib.crc32(plain[a:b].tobytes()) for a, b in spans], pa.int64())
                    else:
                        shown = pa.array([ids[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64()))
                    columns = [pa.array(np.full(len(keys), partition)), pa.array(keys, pa.int64(), mask=null), pa.array(start + stop - counts), pa.array(counts), shown]
                    start += int(counts.sum())
                    yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local", "n_tokens", kind.split()[0]])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = materialize(files.mapInArrow(run, f"part bigint, doc_id bigint, local bigint, n_tokens bigint, {kind}"), "token-rows")
    # One row for each file: as many as the writing stage had tasks.
    base, bases = 0, []
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases.append((part, base))
        base += n
    offsets = spark.createDataFrame(bases, "part bigint, base bigint")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", kind.split()[0])


def token_digests(df: DataFrame, tokenizer: str, end: int = 0, added: bool = False) -> DataFrame:
    """Encode, write, read back: per document its place, its number of ids and their CRC-32."""
    spark = df.sparkSession
    out = scratch(spark, "token-files")
    write_token_files(df, out, lambda batches: encoded(batches, tokenizer, "bytes", end, added))
    return read_token_files(spark, out, digest=True)
