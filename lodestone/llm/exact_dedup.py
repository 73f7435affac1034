"""Operator 12: exact dedup by a content sort.

Texts are normalised (white space goes) and sorted: sampled splitters deal them to ranges, each range is sorted externally, so
equal texts lie side by side, and neighbours are compared in full. The order of equal texts puts the one to keep first: most code
points in the original, then smallest doc_id. Splitters hold the first HEAD characters, the digest, the length, the doc_id and the
row's number, never a whole text, so what the sampling gives to the driver is bounded while texts that begin alike, and the copies
of one text, still part: a group of any size is spread over as many ranges as its rows fill. What crosses the edge of a range is
stitched from one row for each range and the texts at its two ends, which are compared in full as well.

Null texts count as empty; empty texts and those of white space alone are equal to each other; texts of any length are compared
whole; a null doc_id comes after all others, so it is kept only where all are null; of rows that are equal in everything one is
kept; an empty table gives an empty one. Extra columns pass through dedup() and those named in keep through copies(), where the
result's names win; others are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLANKS = " \t\n\x0b\x0c\r"
HEAD = 24
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_sorted(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text and others. Those but text, with _norm, _digest and _chars, in ranges of content that are sorted."""
    norm = docs.select("*", normalised(F.col("text")).cast("binary").alias("_norm"), F.coalesce(F.length("text"), F.lit(0)).alias("_chars"), F.monotonically_increasing_id().alias("_row"))
    keyed = norm.drop("text").select("*", F.substring("_norm", 1, HEAD).alias("_head"), F.unhex(F.sha2("_norm", 256)).alias("_digest"))
    start, end = ["_head", "_digest"], [F.desc("_chars"), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    return keyed.repartitionByRange(*start, *end).sortWithinPartitions(*start, "_norm", *end).drop("_head", "_row", "_chars")


def runs(dealt: DataFrame) -> DataFrame:
    """dealt: what content_sorted() gives. Its columns but _norm, and of the run of equal texts that a row is in: _run (number in the
    range), keep_id (doc_id of its first row), _first, group_size (its rows in this range). The first and the last row of a range
    have their text in _head and _tail. Of the run that is open only slim columns and one text are held."""
    fields = [f for f in dealt.schema.fields if f.name != "_norm"]
    names = [f.name for f in fields]
    own = T.StructType().add("_run", "long").add("keep_id", dealt.schema["doc_id"].dataType).add("_first", "boolean").add("group_size", "long").add("_head", "binary").add("_tail", "binary")

    def emit(rows: list, starts: np.ndarray, done: int, head=None, tail=None) -> pa.RecordBatch:
        """rows: whole runs, which begin at starts; done runs came before."""
        table = pa.Table.from_batches(rows).combine_chunks()
        sizes = np.diff(starts, append=len(table))
        doc = table.column("doc_id").take(pa.array(np.repeat(starts, sizes)))
        first = np.zeros(len(table), bool)
        first[starts] = True
        heads, tails = [None] * len(table), [None] * len(table)
        heads[0], tails[-1] = head, tail
        more = [pa.array(np.repeat(done + np.arange(len(starts)), sizes)), doc, pa.array(first), pa.array(np.repeat(sizes, sizes)), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())]
        return pa.Table.from_arrays([*table.columns, *more], names=[*names, *own.names]).combine_chunks().to_batches()[0]

    def run(batches):
        open_, last, head, done = [], None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, slim = batch.column("_norm"), batch.select(names)
            new = np.ones(len(texts), bool)
            new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is None or texts[0].as_py() != last
            head = texts[0].as_py() if last is None else head
            starts = np.flatnonzero(new)
            last = texts[len(texts) - 1].as_py()
            if open_ and len(starts):
                before = sum(x.num_rows for x in open_)
                ends = int(starts[-1])
                yield emit([*open_, slim.slice(0, ends)], np.concatenate([[0], before + starts[:-1]]), done, head)
                done, head, open_ = done + len(starts), None, [slim.slice(ends)]
            elif len(starts) > 1:
                ends = int(starts[-1])
                yield emit([slim.slice(0, ends)], starts[:-1], done, head)
                done, head, open_ = done + len(starts) - 1, None, [slim.slice(ends)]
            else:
                open_.append(slim)
        if open_:
            yield emit(open_, np.zeros(1, np.int64), done, head, last)

    return dealt.mapInArrow(run, T.StructType([*fields, *own.fields]))


def stitched(rows: DataFrame) -> DataFrame:
    """rows: what runs() gives, with _part. One row for each range (_part) whose first or last run goes on in a neighbour: what the
    runs numbered _run have in truth (_keep, _size), and whether the first of them begins there (_begins)."""
    ends = rows.where("_head is not null or _tail is not null")
    slim = ends.groupBy("_part").agg(F.max("_run").alias("last"), F.max(F.when(F.col("_head").isNotNull(), F.col("group_size"))).alias("n_first"), F.max(F.when(F.col("_tail").isNotNull(), F.col("group_size"))).alias("n_last"))
    # A row for each range: windows over them are small, and texts are not among them.
    order = Window.orderBy("_part")
    slim = slim.withColumn("_before", F.lag("_part").over(order))
    heads = ends.where("_head is not null").select("_part", "_head")
    tails = ends.where("_tail is not null").select(F.col("_part").alias("_before"), "_tail")
    keeps = ends.where("_tail is not null").select("_part", F.col("keep_id").alias("k_last"))
    met = slim.join(heads, "_part").join(tails, "_before", "left").select("_part", (F.coalesce(F.col("_head") == F.col("_tail"), F.lit(False))).alias("joined"))
    flat = slim.join(met, "_part").join(keeps, "_part")
    # A chain is a run over several ranges. It begins in the last run of a range that is not joined to the one before, or has more runs than one.
    starts = flat.withColumn("link", F.sum(F.when(F.col("joined") & (F.col("last") == 0), 0).otherwise(1)).over(order))
    # Range i's last run has chain number link; its first run, where joined, the chain number of the range before.
    last = starts.select("_part", F.col("last").alias("_run"), F.col("link").alias("chain"), F.col("n_last").alias("n"), "k_last", (~F.col("joined") | (F.col("last") > 0)).alias("begins"))
    first = starts.withColumn("chain", F.lag("link").over(order)).where("joined and last > 0").select("_part", F.lit(0).cast("long").alias("_run"), "chain", F.col("n_first").alias("n"), F.lit(None).cast(rows.schema["keep_id"].dataType).alias("k_last"), F.lit(False).alias("begins"))
    both = last.unionByName(first)
    chain = Window.partitionBy("chain")
    told = both.select("_part", "_run", F.sum("n").over(chain).alias("_size"), F.max(F.struct("begins", "k_last")).over(chain)["k_last"].alias("_keep"), F.col("begins").alias("_begins"), F.count("*").over(chain).alias("many"))
    return told.where("many > 1").drop("many")


def copies(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text. Rows: doc_id, keep, keep_id, group_size, kept, text_sha256, one for each row of docs."""
    keep = [c for c in keep if c not in (*RESULT, "doc_id")]
    own = docs.select("doc_id", F.col("text").alias("text"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    rows = common.materialize(runs(content_sorted(own)).withColumn("_part", F.spark_partition_id()), "content-sorted")
    told = F.broadcast(stitched(rows))  # at most two rows for each range
    found = rows.drop("_head", "_tail").join(told, ["_part", "_run"], "left")
    crosses = F.col("_size").isNotNull()
    return found.select(
        "doc_id", *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), F.when(crosses, F.col("_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("_size", "group_size").alias("group_size"), (F.col("_first") & F.coalesce("_begins", F.lit(True))).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the copies of others, in all their columns."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    packed = docs.select("doc_id", "text", F.struct(*(F.col(c).alias(n) for c, n in zip(docs.columns, names))).alias("__row"))
    return copies(packed, keep=("__row",)).where("kept").select(*(F.col("__row")[n].alias(c) for c, n in zip(docs.columns, names)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(common.documents(spark, sf_dir))


SQL = r"""
WITH read AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM read WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""
