"""Jaccard join of documents on word n-grams, exact, by blocked sparse products of the incidence matrix.

A document's row of the incidence matrix is its set of distinct n-grams, as 64-bit hashes. Documents with equal rows
form a class, of which one row takes part.

Size-derived bounds come first. With similarity a / b, linked sets of x <= y n-grams have y <= x b / a and differ in at
most D = x (b - a) / a n-grams. So sizes fall into levels of ratio b / a; of the smaller set's level, hashes fall into
k = D + 1 + e + m parts, of which at least e + m + 1 agree. The sums of the parts are signatures; classes that share none
are not multiplied. Parts without n-grams are no signatures, unless a row has more than e of them. As linked rows share
m + 1 signatures, each row may leave out its m most frequent ones: the rarest that two share is among neither's. So what
many rows have in common, such as a passage, brings none together.

The product then takes two steps. In each signature's group one row, the hub (in most and largest groups), is multiplied
with the others, in blocks of bounded size; groups whose members end up in one component are done. The rows of the other
groups fall into clusters (components of sharing such a signature). A cluster's rows are dealt to blocks, so that large
components have blocks of their own, and tiles of two blocks are multiplied: overlap counts add up, pairs under
(x + y) a / (a + b) are discarded, and a tile returns a spanning forest over the components that its pairs join, so never
more links than it has rows. Tiles within one component are left out: whatever they link is linked already.

Defined results: null and empty texts have no n-grams and link with nothing; texts shorter than an n-gram are one n-gram,
the whole sequence; equal rows, repeated ids among them, link; null ids sort last; an empty table gives an empty table;
extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, discard, materialize, release, scratch, temporary, text_slices, trim
from .components import connected_components
from .dedup import has_files, places, without
from .lm import bucket_edges, narrow, pack_sorted, squeeze_wide, unpack_sorted, unsqueeze_wide, widen
from .words import mix, word_hashes

CHUNK_CHARS = 1 << 20
SIGNATURE_BYTES = 6
#: Signatures for each bucket, and the least number of buckets.
BUCKET, BUCKETS = 1 << 20, 32
#: Rows that a task multiplies with one hub.
ROWS = 512
#: Rows and n-grams of a block of a tile; entries of the columns multiplied at once as a dense matrix.
BLOCK_ROWS, BLOCK_GRAMS, ENTRIES = 1024, 1 << 20, 1 << 19
#: A column of at most so many rows is multiplied as a sparse one.
SPARSE = 12


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams of words."""
    hashes, counts = word_hashes(texts)
    width = len(hashes) - n + 1
    grams = np.zeros(max(width, 0), np.uint64)
    for i in range(n):
        if width > 0:
            grams = mix(grams + mix(hashes[i : i + width] + np.uint64(i)))
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(grams[at : at + count - n + 1]))
        elif count:
            whole = np.zeros(1, np.uint64)
            for i in range(count):
                whole = mix(whole + mix(hashes[at + i : at + i + 1] + np.uint64(i)))
            out.append(mix(whole + np.uint64(count)))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out


def fingerprint(row: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as signed integers."""
    with np.errstate(over="ignore"):
        parts = [mix(np.array([mix(row + np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(row))], np.uint64)) for salt in (0x51ED, 0xA11CE)]
    return tuple(int(x.astype(np.int64)[0]) for x in parts)


class Levels:
    """Levels of sizes and their numbers of parts, for similarity a / b."""

    def __init__(self, a: int, b: int):
        self.a, self.b, self.starts, self.parts = a, b, [1], []

    def reach(self, size: int) -> int:
        while self.starts[-1] <= size:
            low, high = self.starts[-1], self.starts[-1] * self.b // self.a + 1
            differ = (high - 1) * (self.b - self.a) // self.a
            spare = 0
            for _ in range(4):  # as many spare parts as are likely to be empty
                k = differ + 1 + spare
                empty = k * math.exp(-low / k)
                spare = min(math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.01 else 0, max(0, low // 4 - differ - 1))
            more = (differ + 1) // 3
            self.parts.append((differ + 1 + spare + more, spare, more))
            self.starts.append(high)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def signatures(self, row: np.ndarray) -> np.ndarray:
        """Of the row's own level and of the one below, in which it may be the larger of a pair."""
        own = self.reach(len(row))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(row), dtype=np.uint64)])
        found = []
        for level in (own, own - 1)[: 2 if own else 1]:
            k, spare, _ = self.parts[level]
            edges = np.concatenate([[0], np.searchsorted(row, part_edges(k)), [len(row)]])
            filled = edges[1:] > edges[:-1]
            content = sums[edges[1:]] - sums[edges[:-1]]
            if k - int(filled.sum()) <= spare:
                content, which = content[filled], np.flatnonzero(filled)
            else:
                which = np.arange(k)
            hashed = mix(content + mix(which.astype(np.uint64) + np.uint64(level << 32))) >> np.uint64(65 - 8 * SIGNATURE_BYTES)
            found.append(hashed << np.uint64(1) | np.uint64(level % 2))  # the last bit tells the two levels apart
        return np.unique(np.concatenate(found))


@functools.lru_cache(maxsize=4096)
def part_edges(k: int) -> np.ndarray:
    return bucket_edges(k)[1:]


def linked(overlap, x, y, a: int, b: int):
    """Whether overlap / union >= a / b."""
    return b * overlap >= a * (x + y - overlap)


def rows_of(df: DataFrame, n: int, a: int, b: int, key: str, text: str) -> DataFrame:
    """(uid, doc_id, size, hi, lo, signatures, file, row) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, levels = TaskContext.get().partitionId() << 33, Levels(a, b)
        for batch in batches:
            for part, texts in text_slices(batch, 1, CHUNK_CHARS):
                sets = ngram_sets(texts, n)
                prints = [fingerprint(x) for x in sets]
                signs = [narrow(levels.signatures(x), SIGNATURE_BYTES) if len(x) else b"" for x in sets]
                uids = np.arange(uid, uid + len(texts))
                uid += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(uids), part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x for x, _ in prints], pa.int64()), pa.array([x for _, x in prints], pa.int64()), pa.array(signs, pa.binary()), part.column(2), part.column(3)], ["uid", "doc_id", "size", "hi", "lo", "signatures", "file", "row"])
        trim()

    place = places(df) if has_files(df) else [F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("row")]
    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *place).mapInArrow(run, "uid bigint, doc_id bigint, size bigint, hi bigint, lo bigint, signatures binary, file string, row bigint")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, uid) of all signatures that several rows have.

    Signatures meet in buckets by their value. Of rows that share one within a batch, only the first goes there, with a
    mark; the others are known to share it, and go to a bucket of the batch's own. So a signature of a third of all rows
    brings a row a batch to its bucket.
    """
    total = rows.agg(F.sum(F.octet_length("signatures"))).first()[0] or 0
    buckets = max(BUCKETS, math.ceil(total / SIGNATURE_BYTES / BUCKET))
    edges = bucket_edges(buckets)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for i, pair in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                seen.setdefault(pair, i)  # copies within a batch add nothing
            first = list(seen.values())
            held = [widen(x, SIGNATURE_BYTES) for x in batch.column(1).take(pa.array(first)).to_pylist()]
            uids = batch.column(0).to_numpy()
            sigs = np.concatenate(held) << np.uint64(64 - 8 * SIGNATURE_BYTES)
            owner = np.repeat(uids[first], [len(x) for x in held])
            order = np.argsort(sigs)
            sigs, owner, base = sigs[order], owner[order], int(uids.min())  # a batch may hold rows of several partitions' ids
            again = np.zeros(len(sigs), bool)
            again[1:] = sigs[1:] == sigs[:-1]
            marked = np.append(again[1:], False)[~again]  # the first of several
            lead, head = sigs[~again], owner[~again]
            cut = np.append(np.searchsorted(lead, edges), len(lead)).tolist()
            spans = [(i, lead[x:y], head[x:y], marked[x:y]) for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
            if again.any():
                spans.append((-1 - base, sigs[again], owner[again], np.ones(int(again.sum()), bool)))
            columns = [pa.array([i for i, *_ in spans], pa.int64()), pa.array([base] * len(spans), pa.int64()), pa.array([pack_sorted(x) for _, x, _, _ in spans], pa.binary()), pa.array([squeeze_wide(x - base) for _, _, x, _ in spans], pa.binary()), pa.array([np.packbits(x).tobytes() for *_, x in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "base", "sigs", "owners", "marks"])
        trim()

    def meet(told: pa.Table) -> pa.Table:
        rows = told.to_pylist()
        held = [unpack_sorted(r["sigs"]) for r in rows]
        sigs = np.concatenate(held)
        owner = np.concatenate([unsqueeze_wide(r["owners"]) + r["base"] for r in rows])
        shared = np.concatenate([np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=len(x)) for r, x in zip(rows, held, strict=True)]).astype(bool)
        order = np.argsort(sigs)
        sigs, owner, shared = sigs[order], owner[order], shared[order]
        same = sigs[1:] == sigs[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        return pa.table([pa.array(sigs[shared].astype(np.int64)), pa.array(owner[shared])], names=["sig", "uid"])

    dealt = rows.where("size > 0").select("uid", "signatures", "hi", "lo").mapInArrow(deal, "bucket bigint, base bigint, sigs binary, owners binary, marks binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "sig bigint, uid bigint")


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs of rows: the incidence matrix times its transpose. Columns of few
    rows add to the pairs of their rows; the others are multiplied as dense matrices, some columns at a time."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(x) for x in rows])
    _, index, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = owner[np.argsort(index, kind="stable")]  # by column, then by row
    starts = np.cumsum(df) - df
    out = np.zeros((n, n), np.float32)
    flat = out.ravel()
    for width in range(2, SPARSE + 1):
        at = starts[df == width]
        held = [owner[at + i] for i in range(width)] if len(at) else []
        for i, low in enumerate(held):
            for high in held[i + 1 :]:
                np.add.at(flat, low * n + high, np.float32(1))
    out += out.T
    dense = np.flatnonzero(df > SPARSE)
    held = np.maximum(df[dense], n // 4)  # so a matrix has at most four places an entry
    for a, b in chunks(held.tolist(), ENTRIES):
        part = dense[a:b]
        widths = df[part]
        which = np.repeat(np.arange(len(part)), widths)
        place = np.repeat(starts[part], widths) + np.arange(len(which)) - np.repeat(np.cumsum(widths) - widths, widths)
        tile = np.zeros((n, len(part)), np.float32)
        tile[owner[place], which] = 1
        out += tile @ tile.T
    return out


def forest(counts: np.ndarray, sizes: np.ndarray, roots: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """Linked pairs of rows that join all components that linked rows join: fewer than there are rows."""
    _, mark = np.unique(roots, return_inverse=True)
    mark, found = mark.copy(), []
    for i in range(len(sizes) - 1):
        later = counts[i, i + 1 :].astype(np.int64)
        near = i + 1 + np.flatnonzero(linked(later, sizes[i], sizes[i + 1 :], a, b))
        for j in near[mark[near] != mark[i]].tolist():
            if mark[j] != mark[i]:
                mark[mark == mark[j]] = mark[i]
                found.append((i, j))
    return found


def star_product(pairs: DataFrame, sets: DataFrame, column: str, kind: str, a: int, b: int) -> DataFrame:
    """(a, b) of the pairs (hub, rep) whose overlap, in a column of hashes, suffices: hubs times blocks of rows."""

    def star(key: tuple, hub: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        if hub.num_rows and others.num_rows:
            row = np.unique(np.frombuffer(hub["own"][0].as_py(), kind))
            held = [np.frombuffer(x, kind) for x in others["hashes"].to_pylist()]
            sizes = np.array([len(x) for x in held])
            overlap = np.empty(len(held), np.int64)
            for low, high in chunks(sizes.tolist(), ENTRIES):
                flat = np.concatenate(held[low:high])
                at = np.minimum(np.searchsorted(row, flat), len(row) - 1)
                overlap[low:high] = np.add.reduceat(row[at] == flat, np.cumsum(sizes[low:high]) - sizes[low:high], dtype=np.int64)
            ok = linked(overlap, len(hub["own"][0].as_py()) // row.itemsize, sizes, a, b)
            found = others["rep"].filter(pa.array(ok)).to_pylist()
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("blocks"))
    dealt = pairs.join(many, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"))
    others = dealt.join(sets.select("rep", F.col(column).alias("hashes")), "rep").select("hub", "block", "rep", "hashes")
    first = dealt.select("hub", "block").distinct().join(sets.select(F.col("rep").alias("hub"), F.col(column).alias("own")), "hub").select(F.col("hub").alias("head"), F.col("block").alias("part"), "own")
    return first.groupBy("head", "part").cogroup(others.groupBy("hub", "block")).applyInArrow(star, "a bigint, b bigint")


def jaccard_links(df: DataFrame, n: int, a: int, b: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, members, links): all rows; (uid, doc_id, size, rep, rep_doc) with the representative of the class of each row
    that has n-grams; and links (a, b) between representatives: all but those of pairs that others connect."""
    spark = df.sparkSession
    signed = materialize(rows_of(df, n, a, b, key, text), "join-rows")
    rows = materialize(signed.drop("signatures"), "join-narrow")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")
    classes = rows.where("size > 0").groupBy("hi", "lo").agg(F.min(order).alias("first"))
    classes = classes.select("hi", "lo", F.col("first.uid").alias("rep"), F.col("first.doc_id").alias("rep_doc"))
    narrow_rows = rows.select("uid", "doc_id", "size", "hi", "lo")
    members = materialize(narrow_rows.where("size > 0").join(classes, ["hi", "lo"]).select("uid", "doc_id", "size", "rep", "rep_doc"), "join-members")

    met = materialize(shared_signatures(signed).join(members.select("uid", "rep", "size"), "uid").select("sig", "rep", "size").distinct(), "join-met")
    discard(signed)  # its signatures are dealt
    release(spark)
    sizes = met.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    levels = Levels(a, b)
    levels.reach(rows.agg(F.max("size")).first()[0] or 1)
    table = spark.createDataFrame([(i, low, levels.starts[i + 1], i % 2, levels.parts[i][2]) for i, low in enumerate(levels.starts[:-1])], "level int, low bigint, high bigint, odd int, more int")
    # One row a level, some hundreds: a row's own level and the one below, by the signature's last bit.
    own = table.select("low", "high", F.col("odd").alias("bit"), "more")
    below = table.alias("o").join(table.alias("l"), F.col("o.level") == F.col("l.level") + 1).select("o.low", "o.high", F.col("l.odd").alias("bit"), "l.more")
    bit = F.shiftright("sig", 64 - 8 * SIGNATURE_BYTES).bitwiseAND(F.lit(1)).cast("int")
    ranked = met.join(sizes, "sig").withColumn("bit", bit).withColumn("place", F.row_number().over(Window.partitionBy("rep", "bit").orderBy(F.desc("n"), F.desc("sig"))))
    kept = ranked.join(F.broadcast(own.unionByName(below)).alias("v"), (F.col("size") >= F.col("v.low")) & (F.col("size") < F.col("v.high")) & (ranked.bit == F.col("v.bit"))).where("place > more").select("sig", "rep")
    kept = materialize(kept, "join-kept")
    discard(met)
    groups = materialize(kept.join(kept.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sig"), "join-groups")
    discard(kept)
    release(spark)
    weight = groups.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("w"))
    hubs = groups.join(weight, "rep").groupBy("sig").agg(F.max(F.struct("w", (-F.col("rep")).alias("hub"))).alias("top")).select("sig", (-F.col("top.hub")).alias("hub"))
    pairs = materialize(groups.join(hubs, "sig").where("rep <> hub").select("hub", "rep").distinct(), "join-pairs")

    # Rows of the incidence matrix, for classes that share a signature.
    wanted = groups.select("rep").distinct().join(members.where("uid = rep").select("rep", "rep_doc"), "rep").select("rep_doc", "rep")
    release(spark)
    sets = materialize(incidence(df, wanted, rows, n, key, text), "join-sets")

    # A bound comes before the counts: 16 bits of each hash overlap at least as much as whole hashes do.
    likely = materialize(star_product(pairs, sets, "brief", "<u2", a, b), "join-likely").select(F.col("a").alias("hub"), F.col("b").alias("rep"))
    links = materialize(star_product(likely, sets, "grams", "<u8", a, b), "join-links")

    release(spark)

    # Groups of several components, apart from their hubs: all of whose pairs are known.
    roots = connected_components(links)
    rest = groups.where("n > 2").join(hubs, "sig").where("rep <> hub").select("sig", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rest = materialize(rest, "join-rest")
    open_groups = rest.groupBy("sig").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("rep").alias("low")).where("least <> most").select("sig", "low")
    chained = rest.join(open_groups, "sig").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    clusters = materialize(connected_components(chained), "join-clusters").withColumnRenamed("node", "rep").withColumnRenamed("root", "cluster")
    if clusters.isEmpty():
        return rows, members, links
    return rows, members, links.unionByName(cluster_links(clusters, roots, sets, members, a, b))


def cluster_links(clusters: DataFrame, roots: DataFrame, sets: DataFrame, members: DataFrame, a: int, b: int) -> DataFrame:
    """(a, b): links between rows of a cluster that are of different components."""
    sized = clusters.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = materialize(sized.join(members.where("uid = rep").select("rep", "size"), "rep"), "join-placed-rows")
    # A component of a block or more has its own blocks (home is its root); the others of a cluster share some.
    load = F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") / BLOCK_GRAMS)
    own = placed.groupBy("cluster", "root").agg(load.alias("load"))
    own = own.withColumn("home", F.when(F.col("load") >= 1, F.col("root")))
    homes = own.groupBy("cluster", "home").agg(F.ceil(F.sum("load")).alias("parts"))
    blocks = homes.select("cluster", "home", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    blocks = materialize(blocks.select("cluster", "home", "part", F.struct(F.coalesce("home", F.lit(-1)).alias("home"), "part").alias("block")), "join-blocks")
    one, two = blocks.select("cluster", F.col("home").alias("home1"), F.col("block").alias("one")), blocks.select("cluster", F.col("home").alias("home2"), F.col("block").alias("two"))
    tiles = one.join(two, "cluster").where((F.col("one") <= F.col("two")) & (F.col("home1").isNull() | F.col("home2").isNull() | (F.col("home1") != F.col("home2")))).select("cluster", "one", "two")
    sides = tiles.select("cluster", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    where = placed.join(own.select("cluster", "root", "home"), ["cluster", "root"]).join(homes.select("cluster", F.coalesce("home", F.lit(-1)).alias("at"), "parts"), ["cluster"]).where(F.col("at") == F.coalesce("home", F.lit(-1)))
    where = where.select("cluster", "rep", "root", F.struct(F.col("at").alias("home"), F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")).alias("block"))

    def product(tile: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, "<u8") for x in tile["grams"].to_pylist()]
        reps = tile["rep"].to_numpy()
        found = forest(overlaps(held), np.array([len(x) for x in held]), tile["root"].to_numpy(), a, b)
        trim()
        return pa.table([pa.array(reps[[i for i, _ in found]]), pa.array(reps[[j for _, j in found]])], names=["a", "b"])

    dealt = where.join(sides, ["cluster", "block"]).join(sets.select("rep", "grams"), "rep")
    return materialize(dealt.select("cluster", "one", "two", "rep", "root", "grams").groupBy("cluster", "one", "two").applyInArrow(product, "a bigint, b bigint"), "join-more")


def incidence(df: DataFrame, wanted: DataFrame, rows: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(rep, grams, brief) of the wanted classes, from the texts of their representatives: hashes, and 16 bits of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 0, CHUNK_CHARS):
                sets = ngram_sets(texts, n)
                prints = [fingerprint(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in prints], pa.int64()), pa.array([x for _, x in prints], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()), pa.array([(x >> np.uint64(48)).astype("<u2").tobytes() for x in sets], pa.binary())], ["hi", "lo", "grams", "brief"])
        trim()

    texts = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    # By sorting and merging at every size: what is wanted grows with the table.
    some = texts.join(wanted.select(F.col("rep_doc").alias("wanted")).distinct().hint("merge"), F.col("doc").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    found = some.mapInArrow(run, "hi bigint, lo bigint, grams binary, brief binary")
    named = wanted.select("rep").join(rows.select(F.col("uid").alias("rep"), "hi", "lo"), "rep")
    # Where ids repeat, several rows may have the same set; any of them will do.
    return found.join(named, ["hi", "lo"]).groupBy("rep").agg(F.first(F.struct("grams", "brief")).alias("x")).select("rep", "x.*")


def jaccard_components(df: DataFrame, n: int, a: int, b: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, stays, file, row) of every row: the smallest id reachable by links of similarity
    a / b or more, and whether the row is the one of its component that stays (smallest id, then first of the table).
    file and row locate it, where df comes from files."""
    rows, members, links = jaccard_links(df, n, a, b, key, text)
    roots = connected_components(links)
    placed = materialize(members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("uid", F.coalesce("root", "rep").alias("root"), "doc_id"), "join-placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("first"))
    named = placed.join(first, "root").select("uid", F.col("first.doc_id").alias("smallest"), F.col("first.uid").alias("stayer"))
    found = rows.select("uid", "doc_id", "size", "file", "row").join(named, "uid", "left")
    alone = F.col("stayer").isNull()  # no n-grams
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"), (alone | (F.col("uid") == F.col("stayer"))).alias("stays"), "file", "row")


def one_of_each(df: DataFrame, n: int = 5, a: int = 80, b: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, all columns, with one of each component."""
    source = df if has_files(df) else materialize(df, "join-input")
    path = scratch(df.sparkSession, "join-dropped")
    with temporary(df.sparkSession):
        dropped = materialize(jaccard_components(source, n, a, b, key, text).where(~F.col("stays")).select("file", "row"), "join-dropped", path)
    return without(source, dropped)


def component_report(df: DataFrame) -> DataFrame:
    return jaccard_components(df, 3, 90, 100).select("doc_id", "n_shingles", "component_id")
