import contextlib
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup

from .fixtures import awkward, empty

BLANKS = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault((text or "").translate(BLANKS), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for norm, members in groups.items():
        members.sort()
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), i == 0, digest) for i, m in enumerate(members)]
    return sorted(out, key=repr)


def ours(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def rows(n, seed):
    rng = random.Random(seed)
    texts = ["same start of all of these texts " + "".join(rng.choices("abcé \t\n ", k=rng.randint(0, 6))) for _ in range(n // 4)] + ["hot copy"] * (n // 3) + ["hot  copy", None, "", " \n", "ho tcopy"] * 3
    found = [(i, rng.choice(texts)) for i in range(n)] + [(None, "hot copy"), (None, "hot copy"), (5, "hot copy"), (5, "hot copy"), (None, " only null "), (None, "only null")]
    rng.shuffle(found)
    return found


@contextlib.contextmanager
def ranges(spark, n):
    set_ = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 3, 16, 200])
def test_against_brute_force(spark, parts):
    """Many ranges: groups go over the edges of one, two and many."""
    found = rows(600, parts)
    docs = spark.createDataFrame(found, "doc_id long, text string").repartition(4)
    with ranges(spark, parts):
        assert ours(exact_dedup.copies(docs)) == brute(found)


def test_one_hot_text_is_spread(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the very same text").alias("text"))
    with ranges(spark, 4):
        dealt = exact_dedup.content_sorted(docs).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) > 1 and max(r["count"] for r in dealt) < 3000
        assert exact_dedup.copies(docs).where("keep_id = 0 and group_size = 4000").count() == 4000
        assert exact_dedup.dedup(docs).collect() == [(0, "the very same text")]


def test_equal_rows_without_ids(spark):
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t x t").alias("text"))
    out = exact_dedup.copies(docs).groupBy("kept", "keep_id", "group_size").count().collect()
    assert sorted((r["kept"], r["keep_id"], r["group_size"], r["count"]) for r in out) == [(False, None, 300, 299), (True, None, 300, 1)]


def test_dedup_keeps_columns(spark):
    docs = awkward(spark, extra=True).withColumn("keep_id", F.lit("clash")).withColumn("_head", F.lit(1))
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    read = Counter((r["doc_id"], r["text"], r["keep_id"], r["_head"]) for r in out.collect())
    told = {(d, k) for d, k, _, kept, _ in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if kept}
    assert {d for d, *_ in read} == {d for d, _ in told} and sum(read.values()) == len(told)
    assert exact_dedup.copies(docs, keep=("lang", "keep_id")).columns == ["doc_id", "lang", "keep_id", "group_size", "kept", "text_sha256"]


def test_empty_table_and_names(spark):
    assert exact_dedup.copies(empty(spark)).count() == 0
    assert exact_dedup.dedup(empty(spark)).count() == 0
