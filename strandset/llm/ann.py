"""Nearest neighbours by largest inner product over an inverted multi-index.

Vectors fall into two halves, each quantised by its own codebook (k-means on a bounded sample), so K * K cells hold the
rows. For a query, pairs of centroids are traversed in order of summed distance (the negative inner products of the
halves) with a heap, until the cells passed hold the share of rows that reached `recall` on the sample; entries of
these cells are reranked by the exact inner product.

Cells are dealt to shards of about SHARD rows; a cell of more than a shard's rows is spread over all shards by row, so a
hot vector has no single place. Queries go to the shards of their cells; each returns its k best, and a ranked merge
keeps k. Sizes held by the driver are bounded: the sample (SAMPLE rows), the codebooks, and K * K cell counts.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, as queries or candidates; ties go to the smaller id; a query has fewer rows if there are fewer candidates; rows
without id take no part; of rows with equal ids each counts as its own candidate, but none of them for a query of that
id; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SAMPLE = 8192
TRIALS = 200
MAX_CODES = 256
SHARD = 4096
ROUNDS = 12


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    return fine


def kmeans(points: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        nearest = assign(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=k)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        centres[~filled] = points[rng.choice(len(points), (~filled).sum())]
    return centres


def assign(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    half = (centres**2).sum(1) / 2
    for a in range(0, len(points), 8192):
        out[a : a + 8192] = (half - points[a : a + 8192] @ centres.T).argmin(1)
    return out


def traverse(near: np.ndarray, far: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by summed distance, until they hold `enough` rows. near, far: distances of the halves' centroids."""
    first, second = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    a, b = near[first].tolist(), far[second].tolist()
    one, two, k = first.tolist(), second.tolist(), len(b)
    heap, reached, cells, held = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = one[i] * k + two[j]
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        # Row i continues to the right; the row below begins with its first column.
        if j + 1 < k:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return cells


class MultiIndex:
    """Two codebooks and the share of rows that a query passes."""

    def __init__(self, sample: np.ndarray, total: int, k: int, recall: float):
        self.half = max(1, sample.shape[1] // 2)
        codes = int(min(MAX_CODES, max(2, math.sqrt(total / 16)), len(sample)))
        self.books = [kmeans(sample[:, : self.half], codes), kmeans(sample[:, self.half :], codes)] if sample.shape[1] > 1 else [kmeans(sample, codes), np.zeros((1, 0))]
        self.width = len(self.books[1])
        self.share = self.calibrate(sample, k, recall)

    def cells(self, points: np.ndarray) -> np.ndarray:
        return assign(points[:, : self.half], self.books[0]) * self.width + assign(points[:, self.half :], self.books[1])

    def distances(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(self.books[0] @ query[: self.half]), -(self.books[1] @ query[self.half :])

    def calibrate(self, sample: np.ndarray, k: int, recall: float) -> float:
        """The least share of rows with which the sample's own queries reach the recall."""
        cells = self.cells(sample)
        counts = np.bincount(cells, minlength=len(self.books[0]) * self.width)
        trials = sample[:: max(1, len(sample) // TRIALS)]
        needed = []
        for query in trials:
            order = traverse(*self.distances(query), counts, len(sample))
            rank = np.zeros(len(counts), np.int64)
            rank[order] = np.cumsum(counts[order])
            best = np.argpartition(-(sample @ query), min(k, len(sample) - 1))[: k + 1]
            needed.append(rank[cells[best]] / len(sample))
        return float(min(1.0, np.quantile(np.concatenate(needed), recall)))


def nearest(df: DataFrame, is_query: str, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = 0.96) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows that the SQL condition is_query (over id) selects."""
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    fine = usable(df, key, vector)
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    fine, total = fine.where(F.size("v") == lengths.n), lengths["count"]
    picked = fine.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(SAMPLE).select("v").collect()
    index = MultiIndex(np.array([x.v for x in picked]), total, k, recall)

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).flatten().to_numpy().reshape(-1, lengths.n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index.cells(points))], ["id", "v", "cell"])

    entries = materialize(fine.mapInArrow(locate, "id bigint, v array<double>, cell bigint"), "ann-entries")
    counts = np.zeros(len(index.books[0]) * index.width, np.int64)  # bounded: MAX_CODES squared
    for cell, n in entries.groupBy("cell").count().collect():
        counts[cell] = n
    shards = max(1, math.ceil(total / SHARD))
    spread = counts > SHARD
    enough = math.ceil(index.share * total)
    shard_of = np.random.default_rng(3).permutation(np.arange(len(counts)) % shards)
    large = [int(x) for x in np.flatnonzero(spread)]  # at most total / SHARD, and at most MAX_CODES squared

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).flatten().to_numpy().reshape(-1, lengths.n)
            for at, (number, query) in enumerate(zip(batch.column(0).to_pylist(), points, strict=True)):
                cells = np.array(traverse(*index.distances(query), counts, enough), np.int64)
                wide = cells[spread[cells]]
                to = {int(s): [int(x) for x in wide] for s in (range(shards) if len(wide) else ())}
                for cell in cells[~spread[cells]].tolist():
                    to.setdefault(int(shard_of[cell]), []).append(cell)
                if to:
                    vectors = batch.column(1).take(pa.array([at] * len(to)))
                    yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int64()), pa.array([number] * len(to), pa.int64()), vectors, pa.array(list(to.values()), pa.list_(pa.int64()))], ["shard", "id", "v", "cells"])

    def search(key: tuple, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entries) and len(queries):
            order = np.argsort(entries["cell"].to_numpy(), kind="stable")
            cells, ids = entries["cell"].to_numpy()[order], entries["id"].to_numpy()[order]
            points = np.stack(entries["v"].to_numpy())[order]
            for number, query, visited in zip(queries["id"], queries["v"], queries["cells"], strict=True):
                visited = np.asarray(visited)
                a, b = np.searchsorted(cells, visited), np.searchsorted(cells, visited, "right")
                rows = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)])
                rows = rows[ids[rows] != number]
                if not len(rows):
                    continue
                rough = points[rows] @ query
                if len(rows) > k:
                    bar = np.partition(rough, len(rows) - k)[len(rows) - k]
                    rows = rows[rough >= bar - 1e-9 * max(1.0, abs(bar))]
                exact = (points[rows].astype(np.longdouble) * query).sum(axis=1).astype(np.float64)
                best = np.lexsort((ids[rows], -exact))[:k]
                found.append(pd.DataFrame({"query_id": number, "vec_id": ids[rows][best], "score": exact[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    wide = F.col("cell").isin(large) if large else F.lit(False)
    placed = entries.withColumn("shard", F.when(wide, F.pmod(F.xxhash64("id"), F.lit(shards))).otherwise(F.element_at(F.lit(shard_of.tolist()), (F.col("cell") + 1).cast("int"))).cast("bigint"))
    queries = entries.where(is_query).select("id", "v").mapInArrow(route, "shard bigint, id bigint, v array<double>, cells array<bigint>")
    partial = placed.groupBy("shard").cogroup(queries.groupBy("shard")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
