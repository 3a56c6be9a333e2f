"""Packing documents into sequences by order-preserving dynamic programming.

Documents keep their order. Each task cuts its stream of ids into windows of at most `size` ids; cuts may stand at
document ends, sentence ends and on a grid inside sentences, and cost what `COST` says, since they truncate. A window
costs its padding, unless its length is a power of two (SHORT lists those below size that are considered, at a fixed
cost each, so that short sequences stay rare). The cheapest cuts follow from

    best[j] = cut[j] + min(min over i in reach of best[i] + at[i]) + size - at[j], min over p in SHORT of best[i: at[i] = at[j] - p] + short)

where the inner minimum over the sliding reach comes from a monotone queue, so a stream takes time linear in its cuts.

Defined results: a null text counts as empty (just the end id); null keys come first; rows with equal keys stay separate
pieces; a text longer than a sequence spans several; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import trim
from .tokens import encoded, in_key_order

SIZE = 2048
GRID = 64
#: Cost, in ids of padding, of a cut at a document's end, at a sentence's end, inside a sentence.
COST = (0, 4, 24)
SHORT = (256, 512, 1024)
SHORT_COST = 64
#: Ids that are packed at once; the last window of each such stream ends with it.
STREAM = 1 << 20


@functools.cache
def sentence_ends(path: str) -> np.ndarray:
    """By id: whether the token consists of sentence-final marks."""
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    found = np.zeros(max(vocabulary.values()) + 2, bool)
    for token, i in vocabulary.items():
        marks = token.removesuffix("</w>")
        found[i] = bool(marks) and not marks.strip(".!?") and token.endswith("</w>")
    return found


def cuts(ids: np.ndarray, ends: np.ndarray, final: np.ndarray, size: int = SIZE, cost=COST, grid: int = GRID, short=SHORT, short_cost: int = SHORT_COST) -> list[int]:
    """Where windows end, the last at len(ids). ends: the documents' ends; final: by id, whether a sentence ends there."""
    n = len(ids)
    price = np.full(n + 1, -1, np.int64)
    price[grid : n + 1 : grid] = cost[2]
    price[np.flatnonzero(final[ids]) + 1] = cost[1]
    price[ends] = cost[0]
    price[0] = price[n] = 0
    places = np.flatnonzero(price >= 0)
    at, cut = places.tolist(), price[places].tolist()
    best, back = [0] * len(at), [0] * len(at)
    index: dict[int, int] = {0: 0}
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (best + place, place, index), best first
    for j in range(1, len(at)):
        here = at[j]
        while queue[0][1] < here - size:
            queue.popleft()
        least, i = queue[0][0] + size - here, queue[0][2]
        for p in short:
            k = index.get(here - p)
            if k is not None and best[k] + short_cost < least:
                least, i = best[k] + short_cost, k
        best[j] = least = least + cut[j]
        back[j] = i
        index[here] = j
        key = least + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def pack_sequences(df: DataFrame, tokenizer: str, end: int = 1, size: int = SIZE, with_ids: bool = False, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of sequences of at most size ids."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def emit(keys: list, held: list[np.ndarray], first: int):
        """The pieces of whole documents; the number of sequences."""
        ids = np.concatenate(held)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(sizes)
        windows = np.array(cuts(ids, ends, sentence_ends(tokenizer), size), np.int64)
        stops = np.union1d(ends, windows)
        starts = np.concatenate([[0], stops[:-1]])
        doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(windows, starts, "right")
        opened = np.concatenate([[0], windows])[seq]
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        columns = [pa.array([keys[i] for i in doc.tolist()], pa.int64()), pa.array(starts - (ends - sizes)[doc]), pa.array(stops - starts), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(first + seq), pa.array(starts - opened)]
        if with_ids:
            columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names), len(windows)

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        keys, held, total = [], [], 0
        for more, ids in encoded(batches, tokenizer, "words", end, added):
            keys += more
            held += ids
            total += sum(map(len, ids))
            if total >= STREAM:
                out, n = emit(keys, held, first)
                first += n
                keys, held, total = [], [], 0
                yield out
        if held:
            yield emit(keys, held, first)[0]
        trim()

    return in_key_order(df, key, text).mapInArrow(run, schema)
