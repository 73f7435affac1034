"""A clustered layout of a collection of vectors: cells around centroids are folders, so a search reads the cells that it probes.

Centroids are fitted on a bounded sample, all rows are dealt to the nearest one and written by cell; a cell may have any number of
files, so one with very many rows is no task's burden. Rows whose vector can not be compared lie in the cell -1, which no search
reads. How many cells a search probes by default is learnt: the vectors of a sample ask all rows, and the smallest number is taken
whose cells hold target of their true neighbours. Probing all cells is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import place
from .search import comparable, flat, meet, most_frequent_length, search_many, search_one, top_k

SAMPLE, MOST_CELLS, ROUNDS, ASKED, TARGET = 20_000, 4096, 8, 200, 0.97
NONE = -1


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids of at most cells groups of the sample's rows (k-means); rows of the sample begin it."""
    distinct = np.unique(sample, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        own = order(sample, centroids, 1)[:, 0]
        n = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def order(v: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    if not len(centroids):
        return np.zeros((len(v), 0), np.int64)
    out = []
    for a in range(0, len(v), 2000):
        rough = (centroids**2).sum(1) - 2 * v[a : a + 2000] @ centroids.T
        out.append(np.argsort(rough, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def directed(v: np.ndarray, metric: str) -> np.ndarray:
    """For cosine, vectors of length 1: near by angle is then near by distance."""
    return v / np.sqrt((v * v).sum(1))[:, None] if metric == "cosine" else v


@dataclass(frozen=True)
class VectorIndex:
    path: str
    pk: str
    vector: str
    metric: str
    width: int
    cells: int
    nprobe: int
    schema: T.StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def centroids(self, spark: SparkSession) -> np.ndarray:
        """At most MOST_CELLS rows."""
        found = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.array([r["centroid"] for r in found], np.float64).reshape(len(found), self.width)


def build(chunks: DataFrame, path: str, pk: str = "vec_id", vector: str = "embedding", metric: str = "l2", cells: int | None = None, sample: int = SAMPLE, asked: int = ASKED, target: float = TARGET, k: int = 10) -> VectorIndex:
    """Writes chunks, all columns, to path by cell. cells: by default the root of the rows, MOST_CELLS at most. sample, asked: the
    rows on which centroids are fitted, and the queries on which the number of probes is learnt, chosen by a hash of pk."""
    spark = chunks.sparkSession
    width = most_frequent_length(chunks, vector)
    fit_for = comparable(F.col(vector), width, metric == "cosine")
    n = chunks.where(fit_for).count()
    chance = F.pmod(F.xxhash64(F.lit("centroids"), F.col(pk).cast("string")), F.lit(1 << 30))

    def some(most: int) -> DataFrame:
        return chunks.where(fit_for).where(chance <= min(1.0, 1.5 * most / max(1, n)) * (1 << 30)).select(F.col(pk).alias("pk"), F.col(vector).cast("array<double>").alias("v")).limit(most)

    taken = directed(np.array([r["v"] for r in some(sample).collect()], np.float64).reshape(-1, max(1, width)), metric)
    centroids = fit(taken, min(MOST_CELLS, cells or max(1, int(n**0.5)))) if n else np.zeros((0, max(1, width)))
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    schema = T.StructType([*(f for f in chunks.schema.fields if f.name != "cell"), T.StructField("cell", T.IntegerType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            valid = batch.column("_fit").to_numpy(zero_copy_only=False)
            cell = np.full(batch.num_rows, NONE, np.int32)
            if valid.any():
                v = flat(batch.column("_v").filter(batch.column("_fit")), width)
                cell[valid] = order(directed(v, metric), centroids, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cell)], schema.names)

    placed = chunks.select(*kept, fit_for.alias("_fit"), F.col(vector).cast("array<double>").alias("_v")).mapInArrow(run, schema)
    placed.repartitionByRange("cell", F.xxhash64(F.col(pk))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/rows")
    out = VectorIndex(path, pk, vector, metric, width, len(centroids), len(centroids), schema)
    return replace(out, nprobe=learnt(out, some(asked), target, k))


def learnt(index: VectorIndex, asked: DataFrame, target: float, k: int) -> int:
    """The smallest number of cells that hold target of the true neighbours of asked (pk, v), a bounded set of queries."""
    spark = asked.sparkSession
    centroids = index.centroids(spark)
    vectors = {r["pk"]: r["v"] for r in asked.collect()}  # once: which rows a limit takes may differ from run to run
    if not vectors:
        return index.cells
    queries = spark.createDataFrame(list(vectors.items()), asked.schema).toDF("query_id", "query")
    rows = index.rows(spark)
    true = search_many(rows, queries, k, index.metric, index.pk, index.vector)
    found = true.join(rows.select(F.col(index.pk).alias("vec_id"), "cell"), "vec_id").select("query_id", "cell").collect()  # k rows a query
    ids = list(vectors)
    ranks = np.argsort(order(directed(np.array([vectors[i] for i in ids], np.float64), index.metric), centroids, len(centroids)), axis=1)
    at = {i: n for n, i in enumerate(ids)}
    places = np.sort([ranks[at[r["query_id"]], r["cell"]] for r in found if r["cell"] != NONE])
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1 if len(places) else index.cells


def search(spark: SparkSession, index: VectorIndex, query: list[float], k: int, nprobe: int | None = None, condition: Column | None = None) -> DataFrame:
    """search_one in the nprobe cells nearest to query: their folders are all that is scanned, and condition is pushed to the scan."""
    near = order(directed(np.array([query], np.float64), index.metric), index.centroids(spark), nprobe or index.nprobe)[0]
    rows = index.rows(spark).where(F.col("cell").isin([int(c) for c in near]))
    return search_one(rows, query, k, index.metric, condition, index.vector, index.pk)


def search_queries(index: VectorIndex, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
    """search_many in the nprobe cells nearest to each query. Queries are written once for each cell that they probe; rows of these
    cells are read once, and each task reads the queries of the cells it meets."""
    spark, width, metric = queries.sparkSession, index.width, index.metric
    centroids, n = index.centroids(spark), nprobe or index.nprobe

    def run(batches):
        for batch in batches:
            q = flat(batch.column(1), width)
            cell = order(directed(q, metric), centroids, n)
            which = pa.array(np.repeat(np.arange(len(q)), cell.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(cell.reshape(-1).astype(np.int32))], ["query_id", "q", "cell"])

    valid = queries.where(comparable(F.col("query"), width, metric == "cosine")).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("q"))
    folder = place(spark, "queries-by-cell")
    dealt = valid.mapInArrow(run, "query_id long, q array<double>, cell int")
    dealt.repartitionByRange("cell", "query_id").sortWithinPartitions("cell").write.partitionBy("cell").parquet(folder)
    probed = [r["cell"] for r in spark.read.schema("query_id long, q array<double>, cell int").parquet(folder).select("cell").distinct().collect()]
    rows = index.rows(spark).where(F.col("cell").isin(probed)).select(F.col(index.pk).cast("long").alias("vec_id"), F.col(index.vector).cast("array<double>").alias("v"), "cell")
    return top_k(meet(rows, folder, k, metric, width, cells=True), "distance", k, ["query_id"], tie="vec_id")
