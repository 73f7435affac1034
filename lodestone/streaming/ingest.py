"""Incremental ingestion and status, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk

TERMINAL = ("SUCCESS", "FAILED")


def ingest(docs: DataFrame, target: str, checkpoint: str, size: int = 1024, overlap: int = 150, once: bool = True) -> StreamingQuery:
    """A stream of documents (collection_name, document_name, text, ts) into target, each document once within the watermark.
    A batch's rows carry its number, and a batch that runs again writes its folder anew, so none is stored twice. A document whose
    text is blank is stored as chunk 0 that is null. Folders are named by collection; as a folder's name does not tell an empty
    collection_name from one that is null, that is in the files too. Without once, each row is a document, names may repeat or be null."""
    unique = docs.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["collection_name", "document_name"]) if once else docs

    def store(batch: DataFrame, number: int) -> None:
        rows = chunk(batch, size, overlap, blanks=True).withColumn("collection", F.col("collection_name"))
        rows.write.mode("overwrite").partitionBy("collection").parquet(f"{target}/batch={number}")

    return unique.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(log: DataFrame) -> DataFrame:
    """task, status, started_at, completed_at of a stream of log rows (task, ts, status): the latest row of each task, however
    late rows come. The state is a row for each task."""
    last = F.max(F.struct("ts", "status"))
    rows = log.groupBy("task").agg(last.alias("last"), F.min(F.when(F.col("status") == "IN_PROGRESS", F.col("ts"))).alias("started_at"))
    return rows.select("task", F.col("last.status").alias("status"), "started_at", F.when(F.col("last.status").isin(*TERMINAL), F.col("last.ts")).alias("completed_at"))


def counts_by_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total: late rows count until the watermark has passed their window."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_once(rows: DataFrame, keys: list[str], checkpoint: str, target: str) -> DataFrame:
    """What a streaming aggregate (a row for each keys) has after all input so far. Each batch adds the rows that it changed, in a
    folder of its number, which is written anew if the batch runs again; of a key the row of the last batch counts."""
    spark, others = rows.sparkSession, [c for c in rows.columns if c not in keys]

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])).parquet(target)
    return found.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*").select(*rows.columns)
