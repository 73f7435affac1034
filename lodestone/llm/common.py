"""What the operators of this subpackage share: tables in the shared folder, columns, numbering."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a temporary one on a local master, on
    which all of them are one process. A cluster without it is refused: its executors would write where none else can read."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or getattr(spark, "_lodestone_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark._lodestone_dir = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, lost executors cost nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes what materialize() wrote for frames that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._lodestone_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so Arrow batches are kept to ARROW_ROWS of them, or fewer where the session says so. The setting is
    read when a result is worked out, which may be long after, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(df: DataFrame, n: int, per_task: int) -> DataFrame:
    """df's n small rows, each of which is work, dealt evenly: a task for each while cores are free, at most per_task a task after."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(n, max(4 * cores, -(-n // per_task)))))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(sizes, most: int):
    """(from, to) runs of rows whose sizes add up to most at the most, or of a single row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ordered_parts(df: DataFrame, *order: Column, tag: str) -> DataFrame:
    """df, of slim rows, dealt to partitions by ranges of order, written with its partition's number as part: a stable
    total order, since later jobs read the numbers and never deal the rows again."""
    once = materialize(df, f"{tag}-rows")  # ranges are sampled first, which would work out df twice
    out = materialize(once.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), tag)
    drop(once)
    return out


def part_offsets(df: DataFrame, value: Column) -> DataFrame:
    """(part, base): the sum of value in all parts before. One row for each part, so the window is small."""
    sums = df.groupBy("part").agg(F.sum(value).cast("long").alias("_sum"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("base"))
