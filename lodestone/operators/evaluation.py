"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """k, recall: the mean over queries of the share of relevant rows (query_id, item) among the first k hits (query_id, item,
    rank). The denominator counts relevant rows as given, copies too; queries without hits count 0."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    found = hits.where(F.col("rank") <= max(ks)).join(relevant.distinct(), ["query_id", "item"], "left_semi")
    per = found.groupBy("query_id").agg(*(F.count_distinct(F.when(F.col("rank") <= k, F.col("item"))).alias(f"h{k}") for k in ks))
    each = total.join(per, "query_id", "left")
    means = each.agg(*(F.avg(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n")).alias(f"r{k}") for k in ks))
    return means.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"r{k}").alias("recall")) for k in ks))).alias("x")).select("x.*")
