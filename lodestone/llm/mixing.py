"""Operator 3: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, scaled by its quality weight; within its source documents stand by key, and a prefix
sum of their sizes meets the source's token budget. Complete epochs come first, the rest of a budget takes documents by key,
and counts the one that crosses it up to the budget's last word; documents themselves are only ever taken whole. Keys derive
from doc_id alone: reruns agree.

Null text has size 0 and is never drawn for the rest; null sources form a source of their own, last in order; equal rows are drawn
like any others (their order among themselves does not show); equal keys stand in the order of doc_id and text; texts of any
length are counted whole; columns besides those named are kept by mix_documents(), whatever their names, and not read otherwise;
an empty table gives an empty one; weights that are null count as 1. One source may hold most rows: the sums run over ranges of (source, key), of which a source takes as many as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
GOOD, BAD = 2.0, 0.5


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with weight: GOOD or BAD by the label of its doc_id (the best one, if it has several), else 1."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    weight = F.when(F.col("_quality") > 0, GOOD).when(F.col("_quality") <= 0, BAD).otherwise(1.0)
    return docs.join(best, "doc_id", "left").withColumn("weight", weight).drop("_quality")


def exponential_key(weight: Column, doc_id: Column, seed: str = "") -> Column:
    """-ln(u) / weight; u, in (0, 1), is made of the first 13 hexadecimal digits of the MD5 of seed and doc_id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size. Adds target: shares of the whole by weight, those above most * source_size cut to it and
    the excess shared anew by weight. A source is full once the level (target by weight) reaches its ratio, cap by weight; so
    in the order of ratios prefix sums of caps and weights give the level at which each next one would still be open, and the
    level is the first that its ratio is above: one sorted pass, in ranges, for any number of sources."""
    order = F.col("source").asc_nulls_last()  # strings stand in the order of their UTF-8 bytes, that is by code point
    parts = common.ordered_parts(sizes, order, tag="sources")
    w = Window.partitionBy("part").orderBy(order)
    ranked = parts.withColumn("_n", F.row_number().over(w) - 1).join(F.broadcast(common.part_offsets(parts, F.lit(1))), "part")
    kinds = F.array(*map(F.lit, weights))
    share = F.get(kinds, F.pmod(F.col("_n") + F.col("base"), F.lit(len(weights))).cast("int"))
    cap = F.col("source_size") * float(most)
    table = ranked.select("source", "source_size", share.alias("share"), cap.alias("cap")).withColumn("ratio", F.col("cap") / F.col("share"))
    by_ratio = [F.col("ratio"), order]
    dealt = common.ordered_parts(table, *by_ratio, tag="shares")
    common.drop(parts)
    sums = dealt.groupBy("part").agg(F.sum("cap").alias("c"), F.sum("share").alias("s"))  # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("c").over(before), F.lit(0.0)).alias("cut"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("gone"))
    total = dealt.agg(F.sum("source_size").alias("all"), F.sum("share").alias("share")).first()
    inside = Window.partitionBy("part").orderBy(*by_ratio).rowsBetween(Window.unboundedPreceding, -1)
    cut, gone = (F.col(base) + F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for base, c in (("cut", "cap"), ("gone", "share")))
    level = (F.lit(float(total["all"] or 0)) - cut) / (F.lit(float(total["share"] or 0)) - gone)
    levels = dealt.join(F.broadcast(bases), "part").select("ratio", "source", level.alias("level"))
    first = levels.where("ratio > level").orderBy(*by_ratio).limit(1).first()
    return dealt.select("source", "source_size", F.least("cap", F.col("share") * F.lit(first["level"])).alias("target") if first else F.col("cap").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS, weight: str = "weight") -> DataFrame:
    """docs: rid, source, size, weight (rid: a struct that tells rows apart, with doc_id). Adds source_size, target, epochs
    (complete ones), part (words that the rest of the budget takes) and taken (epochs * size + part)."""
    key = exponential_key(F.coalesce(weight, F.lit(1.0)), F.col("rid.doc_id"))
    slim = docs.withColumn("_key", key).withColumn("_null", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    parts = common.ordered_parts(slim, F.col("_null"), F.col("_source"), F.col("_key"), F.col("rid"), tag="mixing")
    sums = common.materialize(parts.groupBy("part", "_null", "_source").agg(F.sum("size").alias("_sum")), "mixing-sums")
    sources = sums.groupBy("_null", "_source").agg(F.sum("_sum").cast("long").alias("source_size"))
    goals = targets(sources.select(F.when(~F.col("_null"), F.col("_source")).alias("source"), "source_size"), weights, most)
    goals = goals.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    before = Window.partitionBy("_null", "_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(goals, ["_null", "_source"]).drop("_sum")
    inside = Window.partitionBy("part", "_null", "_source").orderBy("_key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["part", "_null", "_source"])
    epochs = F.least(F.lit(most), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rest = F.when(F.col("epochs") >= most, 0).otherwise(F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("_base") - F.col("_in"))).cast("long")
    rows = rows.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return rows.drop("_null", "_source", "_key", "_base", "_in")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", common.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    rows = mix(quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumn("rid", F.struct("doc_id", "_text")).drop("_text"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs as often as the mix takes them, whole: a row for each complete epoch, and one more for those that the rest of the
    budget takes. The document that crosses the budget is taken if at least half of it is in, which is nearest to the target.
    Rows that agree in doc_id, source and text are drawn as one."""
    rid = F.struct("doc_id", F.xxhash64("text").alias("_text"), "source")
    slim = docs.select(rid.alias("rid"), "doc_id", "source", common.word_count(F.col("text")).alias("size"))
    times = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    rows = mix(quality(slim, labels)).groupBy("rid").agg(F.max(times).cast("int").alias("__mix_times")).where("__mix_times > 0").withColumnRenamed("rid", "__mix_row")
    keyed = docs.withColumn("__mix_rid", rid)
    out = keyed.join(rows, keyed["__mix_rid"].eqNullSafe(rows["__mix_row"])).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
    return out.select(*docs.columns)


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{common.WORD}')), 0) AS BIGINT) AS size FROM documents),
best AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
keyed AS (
  SELECT s.doc_id, source, size, -ln((CAST('0x' || substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / {float(16**13)!r}) / CASE WHEN q > 0 THEN {GOOD} WHEN q <= 0 THEN {BAD} ELSE 1.0 END AS key
  FROM sized s LEFT JOIN best b ON s.doc_id = b.doc_id),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([{", ".join(map(str, WEIGHTS))}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)) AS share
  FROM keyed GROUP BY source),
filled AS (
  SELECT *, {MAX_EPOCHS}.0 * source_size / share AS ratio,
         (sum(source_size) OVER () - coalesce(sum({MAX_EPOCHS}.0 * source_size) OVER w, 0)) / (sum(share) OVER () - coalesce(sum(share) OVER w, 0)) AS level
  FROM sources WINDOW w AS (ORDER BY {MAX_EPOCHS}.0 * source_size / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT level FROM filled WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1),
goals AS (SELECT source, source_size, least({MAX_EPOCHS}.0 * source_size, share * (SELECT level FROM water)) AS target FROM sources),
placed AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, least({MAX_EPOCHS}, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END) AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CASE WHEN epochs >= {MAX_EPOCHS} THEN 0 ELSE floor(target - epochs * source_size) END - before)) AS BIGINT) AS taken
FROM placed
"""
