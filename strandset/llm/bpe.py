"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is vectorised. Every code point gets a class from an array, the class (refined by a look at the next
code points) selects a transition function over the automaton's states, and an associative scan composes those
functions over the whole batch: the state before each code point, and so each token boundary, follows from array
look-ups alone. The slices between boundaries go to pair merging by rank, behind a bounded cache.

Defined results: a null text counts as empty and gives no ids; an empty table gives an empty table; rows are
independent, so repeated rows repeat and a null id stays null; extra columns are ignored. Texts of any length are
encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

CHUNK_CHARS = 1 << 20
CACHE_PIECES = 3 << 17  # in each of two generations

# The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters and numbers that Unicode 16 added to those of 15.1, for interpreters with the older tables.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

OTHER, LETTER, NUMBER, SPACE = range(4)
# The automaton's alphabet.
SYM_L, SYM_N, SYM_P, SYM_SHORT, SYM_LONG, SYM_WS, SYM_WS_LAST, SYM_BLANK_LAST, SYM_RESET = range(9)
# Its states: what the code points read so far leave open.
BOUND, IN_L, IN_N, IN_P, IN_WS, BLANK, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def transition(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if symbol == SYM_RESET:
        return BOUND, False
    if symbol == SYM_WS:
        return IN_WS, state != IN_WS
    if symbol == SYM_WS_LAST:
        return BOUND, True
    if symbol == SYM_BLANK_LAST:
        return BLANK, True
    if symbol == SYM_L and state in (ONE_LEFT, TWO_LEFT):
        return (BOUND, ONE_LEFT)[state == TWO_LEFT], False
    if symbol in (SYM_SHORT, SYM_LONG) and state not in (IN_P, BLANK):
        return (ONE_LEFT, TWO_LEFT)[symbol == SYM_LONG], True
    inside = {SYM_L: IN_L, SYM_N: IN_N}.get(symbol, IN_P)
    return inside, state not in (inside, BLANK)


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of transition functions: product table, values at each state, element of each symbol, starts."""
    generators = [tuple(transition(s, c)[0] for s in range(STATES)) for c in range(9)]
    elements = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *generators]))}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    listed = list(elements)
    product = np.array([[elements[tuple(g[x] for x in f)] for g in listed] for f in listed], np.int32)
    starts = np.array([[transition(s, c)[1] for c in range(9)] for s in range(STATES)], bool)
    return product, np.array(listed, np.uint8), np.array([elements[g] for g in generators], np.int32), starts


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, by its general category."""
    found = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for start in range(0, 0x110000, 0x1000):
        found[start : start + 0x1000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(start, start + 0x1000)]
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            found[first : last + 1] = kind
    found[WHITE_SPACE] = SPACE
    return found


def scan(elements: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix products: within blocks side by side, then over the blocks' totals, then both combined."""
    product = monoid()[0]
    flat, size, n = product.ravel(), len(product), len(elements)
    if n <= block:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    width = -(-n // block)
    padded = np.zeros(width * block, np.int32)
    padded[:n] = elements
    lanes = np.ascontiguousarray(padded.reshape(width, block).T)
    for i in range(1, block):
        lanes[i] = flat.take(lanes[i - 1] * size + lanes[i])
    before = np.zeros(width, np.int32)
    before[1:] = scan(lanes[-1], block)[:-1]
    lanes = flat.take(before * size + lanes)
    return lanes.T.ravel()[:n]


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, each piece's start and end in it, and where each text's pieces begin (one more entry than texts)."""
    joined = "\n".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    codes = np.frombuffer((joined + "\n").encode("utf-32-le"), "<u4")
    kinds = classes()[codes]
    kinds[ends] = SPACE
    n = len(codes)
    gap = kinds == SPACE
    gap_next = np.ones(n, bool)
    gap_next[:-1] = gap[1:]
    symbols = np.full(n, SYM_P, np.uint8)
    symbols[kinds == LETTER] = SYM_L
    symbols[kinds == NUMBER] = SYM_N
    symbols[gap] = np.where(gap_next[gap], SYM_WS, np.where(codes[gap] == 0x20, SYM_BLANK_LAST, SYM_WS_LAST))
    for i in np.flatnonzero(codes == 0x27).tolist():
        tail = joined[i + 1 : i + 3]
        # The contractions of the pattern.
        if tail[:1] in ("s", "t", "m", "d"):
            symbols[i] = SYM_SHORT
        elif tail in ("re", "ve", "ll"):
            symbols[i] = SYM_LONG
    symbols[ends] = SYM_RESET
    _, values, generator, starts = monoid()
    after = values[:, BOUND][scan(generator[symbols])]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = BOUND, after[:-1]
    begin = np.flatnonzero(starts[before, symbols])
    first = np.searchsorted(begin, np.concatenate([[0], ends + 1]))
    stop = np.empty(len(begin), np.int64)
    stop[:-1] = begin[1:]
    full = first[1:] > first[:-1]
    stop[first[1:][full] - 1] = ends[full]
    return joined, begin, stop, first


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def vocabulary(path: str) -> tuple[list[bytes], list[str], np.ndarray]:
    """Of each id: its bytes, its decimal digits, its length."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens, [str(i) for i in range(len(tokens))], np.fromiter(map(len, tokens), np.int64, len(tokens))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of lowest rank, leftmost first, is merged until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    get = ranks.get
    if len(piece) <= 48:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while known := [r for r in pairs if r is not None]:
            i = pairs.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1])
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i])
        return [ranks[p] for p in parts]
    # A long piece: a heap of pairs over a linked list of part ends.
    n = len(piece)
    end, back, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        live[j], end[i] = False, stop
        if stop < n:
            back[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := back[i]) >= 0 and (r := get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PieceCache:
    """Ids by piece as little-endian unsigned 32-bit integers; of full caches only the younger half's pieces stay."""

    def __init__(self, limit: int = CACHE_PIECES):
        self.limit, self.young, self.old = limit, {}, {}

    def ids(self, pieces: list[str], first: np.ndarray, unseen) -> list[np.ndarray]:
        """The ids of each text, whose pieces begin at first; unseen(pieces) gives the ids of pieces not held."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young = self.young
        coded = list(map(young.get, pieces))
        gaps = [i for i, x in enumerate(coded) if x is None]
        if gaps:
            missing = []
            for piece in {pieces[i] for i in gaps}:
                if (held := self.old.get(piece)) is None:
                    missing.append(piece)
                else:
                    young[piece] = held
            for piece, ids in zip(missing, unseen(missing), strict=True):
                young[piece] = array("I", ids).tobytes()
            for i in gaps:
                coded[i] = young[pieces[i]]
        at = first.tolist()
        return [np.frombuffer(b"".join(coded[a:b]), "<u4") for a, b in zip(at, at[1:], strict=False)]


class Encoder:
    """Encodes texts by a rank file."""

    def __init__(self, path: str):
        self.path, self.ranks, self.cache = path, load_ranks(path), PieceCache()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        joined, begin, stop, first = split(texts)
        pieces = [joined[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        return self.cache.ids(pieces, first, lambda new: [merge(x.encode(), self.ranks) for x in new])

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = vocabulary(self.path)[0]
        return b"".join([tokens[i] for i in ids])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin in the text's UTF-8."""
        lengths = vocabulary(self.path)[2][ids]
        return np.cumsum(lengths) - lengths


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_batches(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Of (id, text) batches: the ids' column and the token ids, a bounded number of characters at a time."""
    own = encoder(path)
    for batch in batches:
        for part, texts in text_slices(batch, 1, CHUNK_CHARS):
            yield part.column(0), own.encode(texts)


def bpe_encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids, offsets): token ids, and the byte offset of each token in the text's UTF-8."""

    def run(batches):
        for keys, coded in encode_batches(batches, path):
            offsets = [encoder(path).offsets(x) for x in coded]
            yield pa.RecordBatch.from_arrays([keys, pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], ["key", "ids", "offsets"])

    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>, offsets array<bigint>").withColumnRenamed("key", key)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Rows (key, content): the bytes that the ids stand for; null ids give null."""

    def run(batches):
        own = encoder(path)
        for batch in batches:
            content = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["key", "content"])

    return df.selectExpr(f"`{key}` as key", f"`{ids}` as ids").mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, content binary").withColumnRenamed("key", key)


def bpe_digests(df: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, a digest of the ids and one of the bytes decoded from them."""

    def run(batches):
        own, digits = encoder(path), vocabulary(path)[1]
        for keys, coded in encode_batches(batches, path):
            sha = lambda x: hashlib.sha256(x).hexdigest()
            counts = pa.array([len(x) for x in coded], pa.int64())
            listed = [x.tolist() for x in coded]
            of_ids = pa.array([sha(" ".join([digits[i] for i in x]).encode()) for x in listed])
            of_bytes = pa.array([sha(own.decode(x)) for x in listed])
            yield pa.RecordBatch.from_arrays([keys, counts, of_ids, of_bytes], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
