import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, term_index, vector_index
from lodestone.sources import shared

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bm25_brute(docs, queries, k):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    tfs = {i: Counter(split(t)) for i, t in docs if t is not None}
    mean = sum(sum(c.values()) for c in tfs.values()) / len(tfs)
    df = Counter(w for c in tfs.values() for w in c)
    out = set()
    for q, text in queries:
        scores = Counter()
        for w in set(split(text or "")):
            for i, c in tfs.items():
                if c[w]:
                    scores[i] += math.log(1 + (len(tfs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out |= {(q, i, r + 1, round(s, 6)) for r, (i, s) in enumerate(best)}
    return out


def zipf_docs(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, " .,;"), (n + 3, "W0 w0 É日本")]


@pytest.mark.parametrize("options", [{}, {"block": 4, "share": 200, "buckets": 3}, {"block": 1, "share": 7, "buckets": 1}])
def test_bm25_many(spark, options, monkeypatch):
    """Small blocks and shares, so that common words are dealt and most blocks are skipped; few postings at once."""
    monkeypatch.setattr(term_index, "AT_ONCE", 60 if options else term_index.AT_ONCE)
    docs = zipf_docs(300)
    queries = [(0, "w0 w1"), (1, "w150 w0"), (2, "É w3 w3 w9"), (3, "nowhere"), (4, ""), (5, None), (6, "w7")]
    index = term_index.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shared.place(spark, "t"), **options)
    assert index.documents == 303
    asked = spark.createDataFrame(queries, "query_id long, query string")
    got = {(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in term_index.bm25_many(index, asked, 5).collect()}
    assert got == bm25_brute(docs, queries, 5)
    if options.get("block") == 4:
        read = term_index.candidates(index, asked, 5).agg(F.sum(F.size("pks"))).first()[0]
        every = index.blocks(spark).join(term_index.wanted(index, asked, 5), "term").agg(F.sum(F.size("pks"))).first()[0]
        assert read < 0.9 * every, (read, every)


def test_search_reads_folders_of_terms_and_no_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    index = term_index.build(docs, shared.place(spark, "t"))
    found = plan(term_index.bm25_many(index, spark.createDataFrame([(1, "the heat")], "query_id long, query string"), 5))
    assert "documents.parquet" not in found and re.search(r"PartitionFilters: \[[^\]]*bucket", found) and re.search(r"PushedFilters: \[[^\]]*In\(term", found)


def test_empty_term_index(spark):
    index = term_index.build(spark.createDataFrame([], "doc_id long, text string"), shared.place(spark, "t"))
    assert term_index.bm25_many(index, spark.createDataFrame([(1, "a")], "query_id long, query string"), 3).count() == 0


def test_a_block_is_dealt_once_for_all_requests(spark):
    """What is dealt for a set of requests is at most the index, however many requests ask for the same words; and in bytes by shard."""
    index = term_index.build(spark.createDataFrame(zipf_docs(300), "doc_id long, text string").repartition(3), shared.place(spark, "t"), block=4)
    asked = lambda n: spark.createDataFrame([(i, "w0 w1 w5") for i in range(n)], "query_id long, query string")
    dealt = lambda n: term_index.candidates(index, asked(n), 5).agg(F.sum(F.size("pks"))).first()[0]
    assert dealt(40) == dealt(1) > 0
    common = term_index.candidates(index, spark.createDataFrame([(1, "w0")], "query_id long, query string"), 5).agg(F.sum(F.size("pks"))).first()[0]
    assert 5 <= common < 0.5 * index.blocks(spark).where("term = 'w0'").agg(F.sum("n")).first()[0]
    assert [r["rank"] for r in term_index.bm25_many(index, asked(40), 5).collect()].count(1) == 40


def test_bounds_hold_where_shards_are_unlike(spark):
    """Shards of short and of long documents, under whose own means blocks are cut; keys are strings, and texts are repeated."""
    rng = random.Random(5)
    docs = [(f"d{i}", " ".join(rng.choices(["a", "b", "c", "d"], [8, 4, 2, 1], k=rng.randint(1, 4) if i < 120 else rng.randint(20, 90)))) for i in range(240)]
    docs += [(f"e{i}", docs[3][1]) for i in range(20)]
    index = term_index.build(spark.createDataFrame(docs, "doc_id string, text string").coalesce(1), shared.place(spark, "t"), share=40, block=2)
    queries = [("x", "a"), ("y", "b d"), ("z", docs[3][1]), ("w", "d")]
    asked = spark.createDataFrame(queries, "query_id string, query string")
    got = {(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in term_index.bm25_many(index, asked, 3).collect()}
    assert got == bm25_brute(docs, queries, 3)


def vectors(spark, n=1200, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8)) * 5
    rows = [(i, [float(x) for x in centers[i % 12] + rng.normal(size=8)], i % 3) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [1.0], 0), (n + 3, [float("nan")] * 8, 0), (n + 4, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_index(spark, metric):
    rows = vectors(spark)
    index = vector_index.build(rows, shared.place(spark, "v"), metric=metric)
    assert index.rows(spark).count() == rows.count() and index.rows(spark).where("cell = -1").count() == (4 if metric == "cosine" else 3)
    asked = rows.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    key = lambda df: {(r["query_id"], r["rank"]): (r["vec_id"], round(r["distance"], 9)) for r in df.collect()}
    true = key(search.search_many(rows, asked, 10, metric))
    assert key(vector_index.search_queries(index, asked, 10, index.cells)) == true
    some = key(vector_index.search_queries(index, asked, 10))
    assert index.nprobe < index.cells and len(set(some.items()) & set(true.items())) >= 0.9 * len(true)


def test_condition_and_cells_reach_the_scan(spark):
    rows = vectors(spark)
    index = vector_index.build(rows, shared.place(spark, "v"))
    query = rows.where("vec_id = 5").first()["embedding"]
    exact = search.search_one(rows, query, 8, condition=F.col("label") == 2).select("vec_id", "rank").collect()
    whole = vector_index.search(spark, index, query, 8, index.cells, F.col("label") == 2)
    few = vector_index.search(spark, index, query, 8, 2, F.col("label") == 2)
    assert whole.select("vec_id", "rank").collect() == exact
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan(few)) and "EqualTo(label,2)" in plan(few)
    assert few.select("cell").distinct().count() <= 2 < index.cells


def test_vector_index_of_few_and_no_rows(spark):
    for n in (0, 1):
        rows = spark.createDataFrame([(1, [1.0, 2.0], 0)][:n], "vec_id long, embedding array<double>, label int")
        index = vector_index.build(rows, shared.place(spark, "v"))
        asked = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, query array<double>")
        assert index.cells == n and vector_index.search_queries(index, asked, 3).count() == n == vector_index.search(spark, index, [0.0, 1.0], 3).count()


def test_identical_vectors_fill_several_files(spark):
    rows = spark.range(6000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = vector_index.build(rows, shared.place(spark, "v"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert index.cells == 1 and len(index.rows(spark).inputFiles()) > 1
    assert [r["vec_id"] for r in vector_index.search(spark, index, [0.0, 0.0], 3).collect()] == [0, 1, 2]
