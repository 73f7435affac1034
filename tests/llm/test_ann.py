import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann

from ..conftest import SMALL


def brute(rows, queries, k=10):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))
        out[q] = [(int(ids[i]), d[i]) for i in order[:k] if np.isfinite(d[i])]
    return out


def clustered(n, d, seed=3, centres=40):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d)) * 3
    return [(i, (c[i % centres] + rng.normal(size=d)).tolist()) for i in range(n)]


def recall(out, want):
    hits = sum(r["vec_id"] in [i for i, _ in want[r["query_id"]]] for r in out)
    return hits / sum(map(len, want.values()))


def test_query_on_a_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    out = ann.op10(spark, SMALL).orderBy("query_id", "rank").collect()
    by = {i: np.array(v) for i, v in rows}
    assert recall(out, want) >= 0.9 and len(out) == 10 * len(want)
    assert all(r["score"] == pytest.approx(np.sqrt(((by[r["query_id"]] - by[r["vec_id"]]) ** 2).sum()), rel=1e-12) for r in out)


def test_clustered_vectors_need_a_small_share(spark):
    rows = clustered(4000, 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want, by = brute(rows, range(0, 4000, 100)), {i: np.array(v) for i, v in rows}
    out = ann.search(df, F.col("vec_id") % 100 == 0, shard=500, query_block=15).collect()
    assert all(r["score"] == np.sqrt(((by[r["query_id"]] - by[r["vec_id"]]) ** 2).sum()) for r in out)
    assert len(out) == 400 and recall(out, want) >= 0.9
    index, listed = ann.fit(df)
    assert index.count.sum() == listed.count() == 4000 and len(index.left) == 31
    shares = [index.share(by[i], 50) for i in range(0, 4000, 100)]
    assert np.mean(shares) < 0.2 and max(shares) < 0.5


def test_the_share_falls_as_the_table_grows(spark):
    shares = []
    for n in (2000, 16000):
        rows = clustered(n, 8, centres=100)
        index, _ = ann.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        shares.append(np.mean([index.share(np.array(rows[i][1]), 50) for i in range(0, 300, 10)]))
    assert shares[1] < 0.6 * shares[0]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, [5.0, 0.0, 2.0]), (100, [1.0, 0.0, 3.0])]
    bad = [(4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, nan, 1.0]), (7, [1.0, None, 1.0]), (8, [1.0, 2.0]), (9, [inf, 0.0, 0.0]), (None, [1.0, 0.0, 2.0]), (200, None)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("cell", F.lit(1))
    out = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    assert {r["vec_id"] for r in out} == {1, 2, 3} and {r["query_id"] for r in out} == {100}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.search(none, F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert ann.search(alone, F.col("vec_id") % 100 == 0).count() == 0


def test_very_large_and_very_small_numbers(spark):
    rows = [(0, [1e160, 0.0]), (1, [1e160, 2e160]), (2, [-3e160, 1.0]), (3, [1.0, 1.0]), (100, [1.0, 2.0]), (4, [1e-200, 0.0]), (200, [3e-200, 0.0]), (5, [1.7e308, 0.0]), (300, [-1.7e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all(len(v) == 8 for v in got.values())
    assert got[0][:6] == [(3, pytest.approx(1e160)), (4, pytest.approx(1e160)), (100, pytest.approx(1e160)), (200, pytest.approx(1e160)), (1, pytest.approx(2e160)), (2, pytest.approx(4e160))]
    assert got[200][0] == (4, pytest.approx(2e-200)) and got[100][0] == (3, 1.0)
    assert got[300][-1] == (5, float("inf"))


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else rng.normal(size=4).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = ann.search(df, F.col("vec_id") == 100, shard=200).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14] and all(r["score"] == 0 for r in out)


def test_many_rows_of_one_id_are_looked_past(spark):
    rows = [(100, [1.0, 1.0 + i / 1e6]) for i in range(400)] + [(i, [float(i), 1.0]) for i in range(1, 12)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100).collect()
    assert {r["vec_id"] for r in out} <= set(range(1, 12)) and len(out) == 10


def test_walk_follows_the_sum_up_to_its_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    index = ann.Index(ann.k_means(x[:, :3], 8), ann.k_means(x[:, 3:], 8))
    index.count = np.bincount(index.cells(x), minlength=64)
    d = index.sums(x[:1], np.arange(64))[0]
    order, bound = index.walk(x[0], 501)
    assert bound == np.inf and sorted(order) == sorted(np.flatnonzero(index.count)) and (np.diff(d[order]) >= -1e-9).all()
    some, bound = index.walk(x[0], 11, 2.0)
    assert set(some) == {c for c in np.flatnonzero(index.count) if d[c] <= bound} and len(some) < len(order)


def test_layout_splits_large_cells():
    layout = ann.Layout.of(np.array([3, 0, 25, 4]), 10)
    at = layout.place(np.array([2] * 25), np.arange(25))
    assert set(at) <= set(layout.groups([2])) and len(set(at)) == 3 and len(layout.groups([0, 3])) == 2
