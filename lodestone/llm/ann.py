"""Operator 10: approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised apart, a pair of centroids is a cell, and cells are listed with their vectors; the
number of centroids grows with the table. A query walks the cells by the sum of its squared distances to both centroids, with a
heap over the sorted distances, up to a bound, and what those cells hold is ranked by the exact distance. The bound lies a fixed
reach beyond the sum at which the cells hold FEW * k vectors, so it falls as the table grows denser, and no table is searched
whole for its size. The reach is learnt: for calibration vectors the true neighbours are found in one pass over all vectors, and
it is the smallest that gets target_recall of them.

Vectors that are null, all zero, hold nulls or non-finite numbers, or differ in length from the most frequent length (ties: the
smaller) take no part. Finite numbers of any size do: for the cells vectors are brought to the size of most and cut far beyond
it, and distances whose squares leave the range of doubles are worked out scaled. Ties go to the smaller vec_id; equal vectors
share a cell, and cells of any size are split over tasks. Rows that share a vec_id are no candidates of each other; null vec_ids
take no part. Fewer candidates than k are all returned; an empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bounds on what the driver gets: SAMPLE vectors, CALIBRATION * K neighbours and a row for each of CENTROIDS * CENTROIDS cells.
K, SAMPLE, CALIBRATION, TARGET_RECALL, CENTROIDS, SHARD, QUERY_BLOCK = 10, 20_000, 200, 0.97, 1_024, 2_000, 1_000
FEW, PER_CELL = 5, 4  # PER_CELL: vectors that a cell has on average, as long as CENTROIDS allows
FAR = 1e6  # times the usual size of a vector; beyond it the cells do not tell vectors apart
KINDS = "vec_id long, cell int, raw binary"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v: array<double>, of the vectors that take part; their number)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length["d"] if length else 0)), length["count"] if length else 0


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all c, as near as floating point has them by products."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of x to q; those whose squares would overflow or vanish are worked out scaled."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = x - q
        d = np.sqrt((gap**2).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(d) | (d < 1e-140))
        if len(odd):
            largest = np.abs(gap[odd]).max(axis=1, initial=0)
            part = gap[odd] / np.where((largest > 0) & np.isfinite(largest), largest, 1)[:, None]
            d[odd] = np.where(np.isfinite(largest), largest * np.sqrt((part**2).sum(axis=1)), np.inf)
    return d


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids; those that lose all points start anew at the farthest ones."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = squares(x, c)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((len(c), 0))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
    return c


@dataclass
class Index:
    """Centroids of both halves, how many vectors each cell holds, and how far a walk goes on."""

    left: np.ndarray
    right: np.ndarray
    scale: float = 1.0
    reach: float = np.inf

    def __post_init__(self):
        self.count = np.zeros(len(self.left) * len(self.right), np.int64)

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of x to the centroids of both halves."""
        with np.errstate(over="ignore"):
            x = np.clip(x / self.scale, -FAR, FAR)
        h = self.left.shape[1]
        return squares(x[:, :h], self.left), squares(x[:, h:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._near(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def sums(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The summed distances of all x to cells."""
        a, b = self._near(x)
        return a[:, cells // len(self.right)] + b[:, cells % len(self.right)]

    def walk(self, q: np.ndarray, wanted: int, reach: float | None = None) -> tuple[list[int], float]:
        """(cells by rising sum, up to reach beyond the sum at which they hold wanted vectors; that bound)."""
        a, b = (d[0] for d in self._near(q[None, :]))
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen, held, out, bound = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, 0, [], np.inf
        while heap and heap[0][0] <= bound:
            s, x, y = heapq.heappop(heap)
            cell = int(i[x]) * len(b) + int(j[y])
            if self.count[cell]:
                out.append(cell)
                held += int(self.count[cell])
                if held >= wanted and bound == np.inf:
                    bound = s + (self.reach if reach is None else reach) + 1e-9 * s
            for n in ((x + 1, y), (x, y + 1)):
                if n[0] < len(a) and n[1] < len(b) and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (a[i[n[0]]] + b[j[n[1]]], *n))
        return out, float(bound)

    def share(self, q: np.ndarray, wanted: int) -> float:
        """The share of all vectors that q looks at."""
        return float(self.count[self.walk(q, wanted)[0]].sum() / max(1, self.count.sum()))


@dataclass
class Layout:
    """Cells in order, packed to groups of about size rows; larger cells are split over several groups by the id."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, count: np.ndarray, size: int) -> Layout:
        return cls((np.cumsum(count) - count) // size, np.maximum(1, -(-count // size)))

    def place(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return self.first[cells] * 1_000_000 + spread % self.parts[cells]

    def groups(self, cells: list[int]) -> list[int]:
        return sorted({int(self.first[c]) * 1_000_000 + p for c in cells for p in range(int(self.parts[c]))})


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each list of doubles; all lists are as long as one another."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def raws(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def best_of(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: int, rough: np.ndarray, inside: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest of x that are inside, by (distance, id). rough, squared distances by products, only
    leaves out what is surely farther; where it is not finite it leaves out nothing."""
    at = np.flatnonzero((ids != own) & inside)
    known = at[np.isfinite(rough[at])]
    if len(known) > k:
        r = rough[known]
        edge = np.partition(r, k - 1)[k - 1]
        with np.errstate(over="ignore"):
            at = np.concatenate([known[r <= edge + 1e-9 * (edge + (q * q).sum() + 1e-300)], at[~np.isfinite(rough[at])]])
    d = distances(x[at], q)
    best = np.lexsort((ids[at], d))[:k]
    return at[best], d[best]


def true_neighbours(listed: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """(number of the query, cell) of the k nearest of each query among all rows: each task keeps k for each query."""
    own, q = np.array([i for i, _ in queries]), np.stack([x for _, x in queries])

    def run(batches):
        kept: list[list] = [[] for _ in own]
        for batch in batches:
            ids, cell, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), raws(batch.column(2))
            rough, everything = squares(q, v), np.ones(len(ids), bool)
            for n in range(len(own)):
                at, d = best_of(q[n], ids, v, own[n], rough[n], everything, k)
                kept[n] = sorted([*kept[n], *zip(d.tolist(), ids[at].tolist(), cell[at].tolist())])[:k]
        rows = [(n, *x) for n, found in enumerate(kept) for x in found]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["n", "d", "vec_id", "cell"])

    near = listed.mapInArrow(run, "n int, d double, vec_id long, cell int")
    w = Window.partitionBy("n").orderBy("d", "vec_id")
    return [(r["n"], r["cell"]) for r in near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("n", "cell").toLocalIterator()]


def fit(vectors: DataFrame, k: int = K, sample: int = SAMPLE, calibration: int = CALIBRATION, target_recall: float = TARGET_RECALL, centroids: int = CENTROIDS) -> tuple[Index, DataFrame] | None:
    """(index, vec_id, cell and raw of all vectors that take part), or None without any. At most sample vectors, chosen by a hash
    of vec_id, reach the driver."""
    rows, n = usable(vectors)
    if not n:
        return None
    h = F.xxhash64("vec_id")
    some = rows.where(F.pmod(h, F.lit(1 << 30)) <= min(1.0, 2.0 * sample / n + 1e-4) * (1 << 30))  # so few rows are sorted
    drawn = some.orderBy(h, "vec_id").limit(sample).toArrow().combine_chunks()
    if not drawn.num_rows:  # a very small table whose hashes all lie above
        drawn = rows.limit(sample).toArrow().combine_chunks()
    ids, x = drawn.column("vec_id").to_numpy(), matrix(drawn.column("v").chunk(0))
    scale = float(np.median(np.abs(x).max(axis=1))) or 1.0
    with np.errstate(over="ignore"):
        z, half = np.clip(x / scale, -FAR, FAR), x.shape[1] // 2
    number = max(1, min(centroids, int((n / PER_CELL) ** 0.5)))
    index = Index(k_means(z[:, :half], number), k_means(z[:, half:], number), scale)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.cells(v).astype(np.int32)), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "cell", "raw"])

    listed = common.materialize(rows.mapInArrow(assign, KINDS), "cells")
    for r in listed.groupBy("cell").count().toLocalIterator():
        index.count[r["cell"]] = r["count"]
    asked = [(int(ids[i]), x[i]) for i in range(min(calibration, len(x)))]
    firsts = [index.walk(v, FEW * k, 0.0)[1] for _, v in asked]
    found = true_neighbours(listed, asked, k)
    beyond = np.array([index.sums(asked[q][1][None, :], np.array([cell]))[0, 0] - firsts[q] for q, cell in found])
    index.reach = max(0.0, float(np.quantile(beyond, target_recall, method="higher"))) if len(beyond) else np.inf
    return index, listed


def search(vectors: DataFrame, is_query: Column, k: int = K, shard: int = SHARD, query_block: int = QUERY_BLOCK, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector for which is_query (of vec_id) holds. options are fit's.
    Rows are dealt to shards of cells and queries, in the order of their own cells, to blocks; a shard goes to the blocks alone
    whose queries visit it."""
    spark = vectors.sparkSession
    fitted = fit(vectors, k, **options)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, listed = fitted
    asked = listed.where(is_query).dropDuplicates(["vec_id", "raw"])
    asked = common.materialize(asked.join(listed.where(is_query).groupBy("vec_id").agg(F.count("*").alias("own")), "vec_id"), "queries")
    queries = np.zeros(len(index.count), np.int64)
    for r in asked.groupBy("cell").count().toLocalIterator():
        queries[r["cell"]] = r["count"]
    shards, blocks = Layout.of(index.count, shard), Layout.of(queries, query_block)

    def place(batches):
        for batch in batches:
            ids, cell = batch.column(0), batch.column(1)
            at = shards.place(cell.to_numpy(), ids.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), cell, ids, batch.column(2)], ["shard", "cell", "vec_id", "raw"])

    def route(batches):
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            block = blocks.place(cell, ids) if batch.num_rows else ids
            values, owns = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for n, raw in enumerate(values):
                visited, bound = index.walk(np.frombuffer(raw, np.float64), FEW * k + owns[n])
                visits = shards.groups(visited)
                for column, value in zip(out, (ids[n], block[n], raw, bound)):
                    column.extend([value] * len(visits))
                out[4].extend(visits)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64()))], ["query_id", "block", "q", "bound", "shard"])

    asked = common.packed(asked.select("vec_id", "cell", "raw", "own"), int(queries.sum()), query_block)
    routed = asked.mapInArrow(route, "query_id long, block long, q binary, bound double, shard long")
    routed = common.materialize(routed, "visits")
    entries = listed.mapInArrow(place, "shard long, cell int, vec_id long, raw binary")
    entries = entries.join(routed.select(F.col("shard").alias("shard"), F.col("block").alias("block")).distinct(), "shard")

    def rank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, cell = left.column("vec_id").to_numpy(), left.column("cell").to_numpy()
            own, bound = right.column("query_id").to_numpy(), right.column("bound").to_numpy()
            v, q = raws(left.column("raw")), raws(right.column("q"))
            for a in range(0, len(q), 100):
                rough, inside = squares(q[a : a + 100], v), index.sums(q[a : a + 100], cell) <= bound[a : a + 100, None]
                for i in range(len(rough)):
                    at, d = best_of(q[a + i], ids, v, own[a + i], rough[i], inside[i], k)
                    for column, values in zip(out, ([own[a + i]] * len(at), ids[at], d)):
                        column.extend(values)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = entries.groupBy("shard", "block").cogroup(routed.groupBy("shard", "block")).applyInArrow(rank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
