"""Distributions of measurements: histograms of fixed buckets, which merge, and exact quantiles without a buffer for each group."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: The upper bounds of buckets that exporters of metrics use where none are given (fixed values).
BOUNDS = (0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0)


def histogram(rows: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """by, counts (of values up to each bound and over the one before, and of those over the last), n, total, least, most. Nulls and
    NaN are left out. A group is one row of fixed size in every task, however many values it has."""
    if list(bounds) != sorted(set(bounds)):
        raise ValueError("bounds rise")
    v = F.col(value).cast("double")
    low = [None, *bounds]
    inside = lambda lo, hi: (F.lit(True) if lo is None else v > lo) & (F.lit(True) if hi is None else v <= hi)
    counts = F.array(*(F.count_if(inside(lo, hi)) for lo, hi in zip(low, [*bounds, None])))
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(counts.alias("counts"), F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


def merged(histograms: DataFrame, by: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """One histogram of each group, of several over the same bounds (of days, of servers)."""
    counts = F.array(*(F.sum(F.get("counts", F.lit(i))) for i in range(len(bounds) + 1)))
    return histograms.groupBy(*by).agg(counts.alias("counts"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def buckets(histograms: DataFrame, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """A row for each bucket in place of counts: upper (null for the last one) and count."""
    pairs = F.array(*(F.struct(F.lit(b).cast("double").alias("upper"), F.get("counts", F.lit(i)).alias("count")) for i, b in enumerate([*bounds, None])))
    return histograms.select(*(c for c in histograms.columns if c != "counts"), F.inline(pairs))


def quantiles(rows: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """by, and for each name of at the exact quantile of value, between neighbours in proportion; nulls are left out. Values are
    sorted once, over ranges of (group, value), so a group of any size lies in as many ranges as it fills; from the counts of groups
    in ranges follows where the few ranks lie that are asked for, and only those rows are taken."""
    slim = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null").withColumn("_spread", F.monotonically_increasing_id())
    order = [*by, "_v", "_spread"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of a row in its range
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).select(*by, "_v", F.spark_partition_id().alias("_range"), place.alias("_place"))
    dealt = written(dealt, "ranges")
    parts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    group = Window.partitionBy(*by)  # a row for each range of a group
    parts = parts.withColumn("_before", F.sum("_n").over(group.orderBy("_range")) - F.col("_n")).withColumn("_all", F.sum("_n").over(group))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("at")) for name, q in at.items()))
    asked = parts.select("*", F.inline(asked)).select("*", F.inline(F.array(*(F.struct(rank.alias("_rank")) for rank in (F.floor("at"), F.ceil("at"))))))
    asked = asked.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    asked = asked.select("_range", (F.col("_rank") - F.col("_before") + F.col("_first")).alias("_place"), "name", "at", "_rank").distinct()
    found = dealt.join(asked, ["_range", "_place"])
    low, high = F.min("_v"), F.max("_v")
    out = lambda name: F.when(F.col("name") == name, F.col("_v"))
    share = F.max(F.col("at") - F.floor("at"))
    each = found.groupBy(*by, "name").agg((low + (high - low) * share).alias("_v"))
    return each.groupBy(*by).agg(*(F.max(out(name)).alias(name) for name in at))


def summary(rows: DataFrame, value: str, by: list[str], at: dict[str, float], **sums: Column) -> DataFrame:
    """quantiles() with aggregates beside them."""
    groups = rows.groupBy(*by).agg(*(c.alias(n) for n, c in sums.items()))
    found = quantiles(rows, value, by, at)
    same = [groups[c].eqNullSafe(found[c]) for c in by]
    joined = groups.join(found, reduce(operator.and_, same), "left")
    return joined.select(*(groups[c] for c in [*by, *sums]), *(found[n] for n in at))
