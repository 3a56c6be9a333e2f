"""Scoring texts by a smoothed bigram model, as a weighted backoff automaton.

The model interpolates absolute discounting: over words w after a word h,

    p(w | h) = max(c(h w) - D2, 0) / c(h), for bigrams seen `keep` times or more, + l(h) * p1(w)
    p1(w)    = max(c(w) - D1, 0) / N + D1 * V / N / (V + 1)

with discounts from the counts of counts (n1 / (n1 + 2 n2)) and l(h) what is left, so all words and one unknown word
sum to 1 after any h. Each word is a state; kept bigrams are its arcs, which lead to the second word's state; its failure
arc, of weight l(h), leads to the root, whose arcs are the words. Traversal carries the state from token to token.

The model is never gathered in one place. Texts become blocks of about BLOCK tokens (word hashes, each once, and indices
of the tokens), written once. A block asks for the counts of its bigrams: sorted hashes, packed, dealt to buckets by hash,
so a hot word's bigrams spread over all buckets and a block sends one row to each. A bucket adds up the training counts of
all blocks and replies to each; of the blocks that asked for a kept bigram it names one the owner. Requests need no
contexts, since the owner knows them: it adds up its own bigrams by first word, and asks for its words with these sums, so
each bigram counts once. From the replies a block builds the part of the automaton that its texts can reach, and
traverses it.

Counts come from all training texts whole. Every bigram seen is kept (`keep` 1); a larger `keep` is a cutoff. Words and bigrams have 56-bit hashes.

Defined results: a null or empty text is one end token; null ids count as the empty string for the fold; repeated rows
count and are scored each; without training texts every token has probability 1; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, text_slices
from .words import mix, word_hashes

BLOCK = 1 << 21
CHUNK_CHARS = 1 << 20
WORD_BITS = 56
WORD_MASK = np.uint64((1 << WORD_BITS) - 1)
#: Hashes fill the upper bits of 64-bit integers; these below are left at 0 and not sent.
SPARE_BITS = np.uint64(64 - WORD_BITS)
SPARE = np.uint64((1 << (64 - WORD_BITS)) - 1)
END = np.uint64(0)
#: Tokens for each bucket, and the least number of buckets.
BUCKET, BUCKETS = 1 << 20, 32


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def narrow(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers as differences of the least whole number of bytes; the first byte says how many."""
    if not len(values):
        return b"\x01"
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + narrow(steps, width)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(widen(data[1:], data[0]), dtype=np.uint64)


def bucket_edges(buckets: int) -> np.ndarray:
    """The first 64-bit hash of each bucket."""
    return np.array([-(-(i << 64) // buckets) for i in range(buckets)], np.uint64)


def make_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (key, held, text) rows."""
    first = TaskContext.get().partitionId() << 24
    keys: list = []
    held: list = []
    sizes: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    total = 0

    def emit() -> pa.RecordBatch:
        words, index = np.unique(np.concatenate(hashes), return_inverse=True)
        named = np.array([0 if x is None else x for x in keys], "<i8").tobytes()
        null = np.array([x is None for x in keys], np.uint8).tobytes()
        columns = [[first], [total], [named], [null], [np.array(held, np.uint8).tobytes()], [squeeze(np.concatenate(sizes))], [pack_sorted(words)], [squeeze(index)]]
        kinds = [pa.int64()] * 2 + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "tokens", "keys", "unnamed", "held", "sizes", "words", "stream"])

    for batch in batches:
        for part, texts in text_slices(batch, 2, CHUNK_CHARS):
            found, counts = word_hashes(texts)
            found = np.maximum(found & WORD_MASK, np.uint64(1))
            hashes.append(np.insert(found, np.cumsum(counts), END))
            sizes.append(counts + 1)
            keys += part.column(0).to_pylist()
            held += part.column(1).to_pylist()
            total += len(hashes[-1])
            if total >= BLOCK:
                yield emit()
                first += 1
                keys, held, sizes, hashes, total = [], [], [], [], 0
    if total:
        yield emit()


BLOCK_SCHEMA = "block bigint, tokens bigint, keys binary, unnamed binary, held binary, sizes binary, words binary, stream binary"


class Block:
    """A block's tokens, and its distinct bigrams in order of their hashes."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.sizes, self.stream = unsqueeze(row["sizes"]), unsqueeze(row["stream"]).astype(np.int32)
        self.words = unpack_sorted(row["words"])
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.keys = pa.array(np.frombuffer(row["keys"], "<i8"), pa.int64(), mask=np.frombuffer(row["unnamed"], np.uint8).astype(bool))
        self.training = np.repeat(~self.held, self.sizes)
        # END stands before the first word, as the state that begins a text.
        before = np.empty_like(self.stream)
        before[0], before[1:] = 0, self.stream[:-1]
        self.before = before  # END has the least hash, so index 0; each text ends with it
        codes, pair = np.unique(before.astype(np.int64) * len(self.words) + self.stream, return_inverse=True)
        first, second = np.divmod(codes, len(self.words))
        hashes = mix(mix(self.words[first]) + self.words[second]) & ~SPARE
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.pair = place[pair]
        #: Hashes of the distinct bigrams, and the indices of their first words.
        self.hashes, self.contexts = hashes[order], first[order]

    def counts(self, index: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(index[self.training], minlength=n)


def spans(hashes: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of the buckets that ascending hashes reach."""
    cut = np.append(np.searchsorted(hashes, edges), len(hashes)).tolist()
    return [(i, a, b) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]


def asked(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, hashes, counts): the bigrams of blocks, by bucket."""
    edges = bucket_edges(buckets)
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row)
            counts, parts = block.counts(block.pair, len(block.hashes)), spans(block.hashes, edges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in parts], pa.int64()),
                    pa.array([block.number] * len(parts), pa.int64()),
                    pa.array([pack_sorted(block.hashes[a:b] >> SPARE_BITS) for _, a, b in parts], pa.binary()),
                    pa.array([squeeze(counts[a:b]) for _, a, b in parts], pa.binary()),
                ],
                ["bucket", "block", "hashes", "counts"],
            )


ASKED = "bucket bigint, block bigint, hashes binary, counts binary"


def asked_words(buckets: int):
    """Rows (bucket, block, hashes, counts, kept, types): the words of a block, by bucket, with the totals and the number
    of those kept bigrams that begin with the word and are the block's own."""
    edges = bucket_edges(buckets)

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(blocks.to_pylist()[0])
        rows = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
        totals = np.concatenate([unsqueeze(r["counts"]) for r in rows])
        own = np.concatenate([unsqueeze_bits(r["owned"], b - a) for r, (_, a, b) in zip(rows, spans(block.hashes, edges), strict=True)])
        context, n = block.contexts[own], len(block.words)
        counts, types = block.counts(block.stream, n), np.bincount(context, minlength=n)
        kept = np.bincount(context, weights=totals[own], minlength=n).astype(np.int64)
        parts = spans(block.words << SPARE_BITS, edges)
        return pa.table(
            [
                pa.array([i for i, _, _ in parts], pa.int64()),
                pa.array([block.number] * len(parts), pa.int64()),
                pa.array([pack_sorted(block.words[a:b]) for _, a, b in parts], pa.binary()),
                pa.array([squeeze(counts[a:b]) for _, a, b in parts], pa.binary()),
                pa.array([squeeze_wide(kept[a:b]) for _, a, b in parts], pa.binary()),
                pa.array([squeeze(types[a:b]) for _, a, b in parts], pa.binary()),
            ],
            names=["bucket", "block", "hashes", "counts", "kept", "types"],
        )

    return run


ASKED_WORDS = "bucket bigint, block bigint, hashes binary, counts binary, kept binary, types binary"
#: kind 0: sums of a bucket; 1 and 2: replies to a block about words and bigrams.
TOLD = "kind int, bucket bigint, block bigint, counts binary, owned binary, kept binary, types binary, total bigint, seen bigint, once bigint, twice bigint"
TOLD_NAMES = [x.split()[0] for x in TOLD.split(", ")]
TOLD_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def told(rows: list[dict]) -> pa.Table:
    return pa.table({name: pa.array([r.get(name) for r in rows], TOLD_TYPES[x.split()[1]]) for name, x in zip(TOLD_NAMES, TOLD.split(", "), strict=True)})


def summed(bucket: int, totals: np.ndarray) -> dict:
    return {"kind": 0, "bucket": bucket, "total": int(totals.sum()), "seen": int((totals > 0).sum()), "once": int((totals == 1).sum()), "twice": int((totals == 2).sum())}


def add_up(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, first places, places of all, and total counts."""
    unique, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return unique, first, inverse, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)


def count_bigrams(keep: int):
    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        hashes = [unpack_sorted(r["hashes"]) << SPARE_BITS for r in rows]
        _, first, inverse, totals = add_up(hashes, [unsqueeze(r["counts"]) for r in rows])
        kept = totals >= max(keep, 1)  # of held-out texts only: 0
        owned = np.zeros(len(inverse), bool)
        owned[first[kept]] = True
        out = [summed(rows[0]["bucket"], totals)]
        ends = np.cumsum([len(x) for x in hashes])
        replies = np.where(kept, totals, 0)[inverse]
        for row, a, b in zip(rows, np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            out.append({"kind": 2, "bucket": row["bucket"], "block": row["block"], "counts": squeeze(replies[a:b]), "owned": squeeze_bits(owned[a:b])})
        return told(out)

    return run


def squeeze_bits(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(values).tobytes())


def unsqueeze_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=n).astype(bool)


def squeeze_wide(values: np.ndarray) -> bytes:
    """Non-negative 64-bit integers."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze_wide(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def count_words(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    hashes = [unpack_sorted(r["hashes"]) << SPARE_BITS for r in rows]
    unique, _, inverse, totals = add_up(hashes, [unsqueeze(r["counts"]) for r in rows])
    kept, types = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
    ends = np.cumsum([len(x) for x in hashes])
    for row, a, b in zip(rows, np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        kept[inverse[a:b]] += unsqueeze_wide(row["kept"])  # a block names a word once
        types[inverse[a:b]] += unsqueeze(row["types"])
    out = [summed(rows[0]["bucket"], totals)]
    for row, a, b in zip(rows, np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        which = inverse[a:b]
        out.append({"kind": 1, "bucket": row["bucket"], "block": row["block"], "counts": squeeze_wide(totals[which]), "kept": squeeze_wide(kept[which]), "types": squeeze_wide(types[which])})
    return told(out)


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Automaton:
    """States are words, by index; arcs bigrams, by index (their states are those of the tokens they end with)."""

    def __init__(self, root: np.ndarray, failure: np.ndarray, arcs: np.ndarray):
        self.root, self.failure, self.arcs = root, failure, arcs

    def traverse(self, before: np.ndarray, pairs: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Log-probability of each token. The state before a token is the token before it, so all steps are taken at once:
        an arc where there is one (its weight is not nan), else the failure arc and then the root's."""
        arc = self.arcs[pairs]
        return np.where(np.isnan(arc), self.failure[before] + self.root[tokens], arc)


def score_block(stats: dict, keep: int):
    n, v, d1, d2 = stats["n"], stats["v"], stats["d1"], stats["d2"]

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(blocks.to_pylist()[0])
        rows = sorted(replies.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        of = lambda kind, name: np.concatenate([unsqueeze_wide(r[name]) for r in rows if r["kind"] == kind])
        c, kept, types = (of(1, x).astype(float) for x in ("counts", "kept", "types"))
        pairs = np.concatenate([unsqueeze(r["counts"]) for r in rows if r["kind"] == 2]).astype(float)
        p1 = np.maximum(c - d1, 0) / max(n, 1) + (d1 * v / n if n else 1.0) / (v + 1)
        left = np.where(c > 0, 1 - (kept - d2 * types) / np.maximum(c, 1), 1.0)
        # The arcs' ends: the first and second word of each distinct bigram.
        first, second = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        first[block.pair], second[block.pair] = block.before, block.stream
        weight = (pairs - d2) / np.maximum(c[first], 1) + left[first] * p1[second]
        with np.errstate(divide="ignore", invalid="ignore"):
            model = Automaton(np.log10(p1), np.log10(left), np.where(pairs >= max(keep, 1), np.log10(weight), np.nan))
        starts = np.cumsum(block.sizes) - block.sizes
        each = lambda x: np.add.reduceat(x, starts)
        base = np.log10((c + 1) / (n + v + 1))
        columns = [block.keys, pa.array(block.held), pa.array(block.sizes), pa.array(each((c > 0)[block.stream].astype(np.int64))), pa.array(np.full(len(starts), n)), pa.array(each(base[block.stream])), pa.array(each(model.traverse(block.before, block.pair, block.stream)))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(df: DataFrame, held: Column, key: str = "doc_id", text: str = "text", keep: int = 1) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns where held is false.
    Bigrams seen less than keep times get no arc."""
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), held.alias("held"), F.col(text).alias("text"))
    blocks = materialize(rows.mapInArrow(make_blocks, BLOCK_SCHEMA), "lm-blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(BUCKETS, math.ceil(tokens / BUCKET))
    requests = blocks.mapInArrow(lambda batches: asked(batches, buckets), ASKED)
    sums = lambda df: df.where("kind = 0").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "seen", "once", "twice")]).first()
    bigrams = materialize(requests.groupBy("bucket").applyInArrow(count_bigrams(keep), TOLD), "lm-bigrams")
    two = sums(bigrams)  # before release: shuffle files of the last query are seen to stay until another has run
    release(blocks.sparkSession)
    owned = bigrams.where("kind = 2").select("bucket", "block", "counts", "owned")
    words = blocks.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(asked_words(buckets), ASKED_WORDS)
    unigrams = materialize(words.groupBy("bucket").applyInArrow(count_words, TOLD), "lm-words")
    one = sums(unigrams)
    release(blocks.sparkSession)
    stats = {"n": one[0], "v": one[1], "d1": discount(one[2], one[3]), "d2": discount(two[2], two[3])}
    replies = bigrams.where("kind = 2").unionByName(unigrams.where("kind = 1")).select("kind", "bucket", "block", "counts", "kept", "types")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score_block(stats, keep), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def corpus_scores(df: DataFrame, keep: int = 1) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score_texts(df, held, keep=keep)
