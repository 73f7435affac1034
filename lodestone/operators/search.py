"""Retrieval: exact dense search, BM25, rank fusion, reranking, score normalisation, thresholds and context merging."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import Condition
from ..functions.text import sigmoid
from ..sources.shared import place, store, written
from .models import Reranker

METRICS, MOST_COLLECTIONS = ("l2", "cosine"), 5
SHARD_ROWS, QUERY_ROWS = 20_000, 1_000


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in double precision."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def comparable(v: Column, dimensions: int, directed: bool = False) -> Column:
    """Whether a vector takes part in a search: as long as the query, without nulls and numbers that are not finite, and, where
    directions are compared, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))
    return fit & F.exists(v, lambda x: x != 0) if directed else fit


def top_k(rows: DataFrame, score: str, k: int, by: list[str] | None = None, tie: str = "pk", descending: bool = False) -> DataFrame:
    """The k best rows of each group with rank from 1; ties go to the smaller tie. Partial limits run before the shuffle."""
    w = Window.partitionBy(*(by or [])).orderBy(F.desc(score) if descending else F.asc(score), tie)
    if by:
        return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    best = rows.orderBy(F.desc(score) if descending else F.asc(score), tie).limit(k)  # k rows: their rank may be taken in one task
    return best.withColumn("rank", F.row_number().over(w).cast("long"))


def search_one(chunks: DataFrame, query: list[float], k: int, metric: str = "l2", condition: Column | None = None, vector: str = "embedding", pk: str = "vec_id") -> DataFrame:
    """The k chunks nearest to one vector among those that condition holds for; the condition reaches the scan. Vectors that are
    null, of another length, not finite or, for cosine, zero are not found; a query like that is refused."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if any(x is None or not math.isfinite(x) for x in query) or metric == "cosine" and not any(query):
        raise ValueError("the query's numbers must be finite, and for cosine not all zero")
    rows = chunks if condition is None else chunks.where(condition)
    rows = rows.where(comparable(F.col(vector), len(query), metric == "cosine"))
    q = F.array(*(F.lit(float(x)) for x in query))
    distance = (l2 if metric == "l2" else cosine_distance)(F.col(vector), q)
    return top_k(rows.withColumn("distance", distance), "distance", k, tie=pk)


def flat(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(ids: np.ndarray, v: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[list, list, list]:
    """(query ids, ids, distances): of the vectors v the k nearest to each of q, which are no zero vectors where metric is cosine, its
    own id left out; ties go to the smaller id."""
    out = ([], [], [])
    norm, size = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
    for a in range(0, len(q), 100):
        product = q[a : a + 100] @ v.T
        rough = norm**2 - 2 * product if metric == "l2" else -product / norm
        for i in range(len(rough)):
            n, r = a + i, np.where(ids == own[a + i], np.inf, rough[i])
            at = np.flatnonzero(ids != own[n])
            if len(at) > k:  # what is surely farther is left out, the rest compared exactly
                edge = np.partition(r, k - 1)[k - 1]
                at = at[~(r[at] > edge + 1e-9 * (abs(edge) + size[n] ** 2 + 1))]
            d = np.sqrt(((v[at] - q[n]) ** 2).sum(1)) if metric == "l2" else 1 - (v[at] * q[n]).sum(1) / (norm[at] * size[n])
            near = np.lexsort((ids[at], d))[:k]
            for column, values in zip(out, ([own[n]] * len(near), ids[at][near], d[near])):
                column.extend(values)
    return out


def most_frequent_length(rows: DataFrame, vector: str) -> int:
    found = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def meet(rows: DataFrame, folder: str, k: int, metric: str, width: int, cells: bool = False, shard: int = SHARD_ROWS, block: int = QUERY_ROWS) -> DataFrame:
    """rows: vec_id, v and, where cells, cell. query_id, vec_id, distance: for each shard of rows the k nearest of each query (query_id,
    q) that lies in folder, or in its subfolder of the rows' cell. Rows stay where they are read; a task holds a shard of them and
    reads queries block by block, so that k rows a query and shard are all that is shuffled later."""

    def run(batches):
        from pyarrow import dataset
        from pyarrow.fs import FileSelector

        files, inside = store(folder)

        def found(held):
            ids = np.concatenate([x.column(0).to_numpy() for x in held])
            v = np.concatenate([flat(x.column(1), width) for x in held])
            place = f"{inside}/cell={held[0].column(2)[0].as_py()}" if cells else inside
            if not any(x.size for x in files.get_file_info(FileSelector(place, allow_not_found=True))):
                return
            asked = dataset.dataset(place, filesystem=files, format="parquet", partitioning=None)
            for some in asked.to_batches(columns=["query_id", "q"], batch_size=block, use_threads=False, batch_readahead=1, fragment_readahead=1):
                if some.num_rows:
                    out = nearest(ids, v, some.column(0).to_numpy(), flat(some.column(1), width), k, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "distance"])

        held, n, cell = [], 0, None
        for batch in batches:
            cuts = [0, batch.num_rows]
            if cells and batch.num_rows:
                c = batch.column(2).to_numpy()
                cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for at in range(a, b, shard):
                    part = batch.slice(at, min(shard, b - at))
                    mine = part.column(2)[0].as_py() if cells else None
                    if held and (mine != cell or n + part.num_rows > shard):
                        yield from found(held)
                        held, n = [], 0
                    held.append(part)
                    n, cell = n + part.num_rows, mine
        if held:
            yield from found(held)

    return rows.mapInArrow(run, "query_id long, vec_id long, distance double")


def search_many(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "l2", pk: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, distance, rank: for each query (query_id, query) the k nearest chunks, the query's own id left out.
    The search is exhaustive: a set of queries against all rows, in blocks. Vectors whose length is not the queries' most frequent
    one, or that are null, not finite or, for cosine, zero take no part on either side."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    width = most_frequent_length(queries, "query")
    asked = queries.where(comparable(F.col("query"), width, metric == "cosine")).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("q"))
    folder = place(chunks.sparkSession, "queries")
    asked.write.parquet(folder)
    rows = chunks.where(comparable(F.col(vector), width, metric == "cosine")).select(F.col(pk).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return top_k(meet(rows, folder, k, metric, width), "distance", k, ["query_id"], tie="vec_id")


def terms(docs: DataFrame, pk: str = "doc_id", text: str = "text") -> DataFrame:
    """pk, term, tf: lower-case words of letters and digits, counted."""
    words = F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return docs.select(pk, words.alias("term")).groupBy(pk, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query_terms: list[str], k1: float = 1.2, b: float = 0.75, pk: str = "doc_id", text: str = "text") -> DataFrame:
    """pk, score of documents with a query term; none without terms. Texts are read and split once, each in its row: lengths and
    counts of the query's terms are written, and statistics and scores come from those."""
    asked = sorted({t.lower() for t in query_terms if t})
    if not asked:
        return docs.select(pk, F.lit(0.0).alias("score")).where(F.lit(False))
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("double").alias("dl"), *((F.size(w) - F.size(F.array_remove(w, t))).cast("double").alias(f"tf{i}") for i, t in enumerate(asked)))

    # inline() of an array of one struct: the counts become columns that are worked out once, not once for each use.
    counted = written(docs.where(F.col(text).isNotNull()).select(pk, F.inline(F.transform(F.array(words), counts))), "term-counts")
    found = [F.col(f"tf{i}") > 0 for i in range(len(asked))]
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(c).alias(f"df{i}") for i, c in enumerate(found))).first()
    n, avgdl = float(stats["n"]), float(stats["avgdl"] or 1.0)

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), float(stats[f"df{i}"])
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))

    return counted.where(reduce(operator.or_, found)).select(pk, reduce(operator.add, map(part, range(len(asked)))).alias("score"))


def reciprocal_rank_fusion(ranked: list[DataFrame], constant: int = 60, pk: str = "pk") -> DataFrame:
    """pk, score: sum over the lists (pk, rank) of 1 / (constant + rank)."""
    every = ranked[0].select(pk, "rank")
    for other in ranked[1:]:
        every = every.unionByName(other.select(pk, "rank"))
    return every.groupBy(pk).agg(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))).alias("score"))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, w_dense: float = 0.5, w_sparse: float = 0.5, pk: str = "pk") -> DataFrame:
    """pk, score: each list's scores brought to 0..1 by its least and largest, weighted and added; absent ones count 0."""

    def scaled(rows: DataFrame, name: str) -> DataFrame:
        ends = rows.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))  # one row
        lo, hi = F.col("_lo"), F.col("_hi")
        return rows.join(F.broadcast(ends)).select(pk, F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0).alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), pk, "full")
    return both.select(pk, (w_dense * F.coalesce("d", F.lit(0.0)) + w_sparse * F.coalesce("s", F.lit(0.0))).alias("score"))


def boosted_sum(dense: DataFrame, sparse: DataFrame, dense_boost: float = 0.5, sparse_boost: float = 0.5, pk: str = "pk") -> DataFrame:
    """pk, score: the raw scores of both lists times their boosts, added; absent ones count 0."""
    both = dense.select(pk, F.col("score").alias("d")).join(sparse.select(pk, F.col("score").alias("s")), pk, "full")
    return both.select(pk, (dense_boost * F.coalesce("d", F.lit(0.0)) + sparse_boost * F.coalesce("s", F.lit(0.0))).alias("score"))


def lexical_score(query_terms: list[str], text: Column) -> Column:
    """A stand-in for a cross-encoder's logit: ten times the share of the query's terms that text has, less five."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    asked = sorted({t.lower() for t in query_terms if t})
    if not asked:
        return F.lit(-5.0)
    return 10.0 * F.size(F.array_intersect(words, F.array(*map(F.lit, asked)))) / len(asked) - 5.0


def rerank(queries: DataFrame, hits: DataFrame, reranker: Reranker, k: int, threshold: float = 0.0) -> DataFrame:
    """hits (query_id, pk, text, ...) with relevance_score and rank: scored against the text of their query (query_id, query) by
    reranker, normalised, those under threshold left out, the k best of each query kept; ties go to the smaller pk."""
    pairs = hits.join(queries.select("query_id", "query"), "query_id")
    scored = normalize(pairs.withColumn("score", reranker(F.col("query"), F.col("text"))))
    return top_k(confident(scored, threshold), "relevance_score", k, ["query_id"], descending=True).drop("query", "score")


def fan_out(collections: DataFrame, conditions: dict[str, Condition], search: Callable[[DataFrame], DataFrame], k: int, most: int = MOST_COLLECTIONS) -> DataFrame:
    """Rows of several collections, each under its own condition (in the order of conditions, at most `most` of them), as search
    scores them (smaller is better: pk, distance, collection_name): the k best of each collection, with place, the collection's
    number in that order, and rank. One scan: a row is kept where its own collection's condition holds."""
    if not 0 < len(conditions) <= most:
        raise ValueError(f"between one and {most} collections are searched at once")
    own = [(F.col("collection_name") == name) & c.flag() for name, c in conditions.items()]
    rows = collections.where(reduce(operator.or_, own))
    place = reduce(lambda x, n: x.when(F.col("collection_name") == n[1], n[0]), list(enumerate(conditions))[1:], F.when(F.col("collection_name") == next(iter(conditions)), 0))
    return top_k(search(rows), "distance", k, ["collection_name"]).withColumn("place", place.cast("long"))


def normalize(rows: DataFrame, score: str = "score") -> DataFrame:
    return rows.withColumn("relevance_score", sigmoid(F.col(score)))


def confident(rows: DataFrame, threshold: float, score: str = "relevance_score") -> DataFrame:
    """Rows whose score reaches threshold; scores that are missing or no number count as 0."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    return rows.where(F.coalesce(F.col(score).try_cast("double"), F.lit(0.0)) >= threshold)


def merge_contexts(lists: list[DataFrame], content: str = "content", pk: str = "pk") -> DataFrame:
    """All lists one after another without later copies of a content. Copies are told by their digest, whose first place is
    found by an aggregate, so a content with very many copies is no task's burden."""
    every = None
    for i, rows in enumerate(lists):
        part = rows.withColumn("list_no", F.lit(i))
        every = part if every is None else every.unionByName(part)
    every = every.withColumn("_digest", F.sha2(content, 256))
    first = every.groupBy("_digest").agg(F.min(F.struct("list_no", pk)).alias("first")).select("first.*", "_digest")
    same = [every[c].eqNullSafe(first[c]) for c in ("list_no", pk, "_digest")]
    once = every.join(first, reduce(operator.and_, same), "left_semi").dropDuplicates(["list_no", pk, "_digest"])  # a place may repeat
    return once.drop("_digest")


def check_limits(vdb_top_k: int, reranker_top_k: int) -> None:
    for name, k in (("vdb_top_k", vdb_top_k), ("reranker_top_k", reranker_top_k)):
        if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
            raise ValueError(f"{name} is a positive whole number")
    if reranker_top_k > vdb_top_k:
        raise ValueError("reranker_top_k is at most vdb_top_k")
