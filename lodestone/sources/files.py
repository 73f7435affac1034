"""Reading files into documents and elements, and writing chunks and payloads of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import written

TEXT_LIKE = ("txt", "md", "html", "htm", "json", "sh", "csv")
ALLOWED = (*TEXT_LIKE, "pdf", "docx", "pptx", "png", "jpg", "jpeg", "bmp", "tiff", "mp3", "wav", "parquet")


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ALLOWED) -> DataFrame:
    """path, document_name, extension, length of the files below folder, by their listing alone."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    rows = rows.withColumn("document_name", T.basename(F.col("path"))).withColumn("extension", T.extension(F.col("document_name")))
    return rows.where(F.col("extension").isin(*extensions)).select("path", "document_name", "extension", "length")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """document_name, content of the text-like files below folder; pages of markup are reduced to what they show."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = T.basename(F.col("path"))
    rows = rows.where(T.extension(name).isin(*TEXT_LIKE)).select(name.alias("document_name"), F.decode("content", "utf-8").alias("raw"))
    return rows.select("document_name", F.when(T.extension(F.col("document_name")).isin("html", "htm"), T.html_text(F.col("raw"))).otherwise(F.col("raw")).alias("content"))


def with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files with their metadata (filename, ...), by base name on both sides; nulls where there is none. Texts that are empty or blank
    are no values, and become null."""
    texts = {f.name for f in metadata.schema.fields if f.dataType.simpleString() == "string" and f.name != "filename"}
    values = [F.when(F.trim(c) != "", F.col(c)).alias(c) if c in texts else F.col(c) for c in metadata.columns if c != "filename"]
    named = metadata.select(T.basename(F.col("filename")).alias("_file"), *values)
    return files.join(named, T.basename(F.col("document_name")) == F.col("_file"), "left").drop("_file")


def batches(files: DataFrame, per_batch: int) -> DataFrame:
    """files with batch_no: in the order of their paths, per_batch to a batch. Places are counted by ranges of paths, so no task has
    more than its range of them."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(files.repartitionByRange("path").sortWithinPartitions("path").select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "files")
    order = Window.orderBy("_range")  # a row for each range
    sizes = dealt.groupBy("_range").count().select("_range", (F.sum("count").over(order) - F.col("count")).alias("_before"))
    return dealt.join(F.broadcast(sizes), "_range").withColumn("batch_no", F.floor((F.col("_before") + F.col("_place")) / per_batch)).drop("_range", "_place", "_before")


def batch_shape(files: DataFrame) -> DataFrame:
    """text_share, files_per_batch, parallel_batches: mostly text goes in a few large batches."""
    share = F.avg(F.col("extension").isin(*TEXT_LIKE).cast("double"))
    return files.agg(share.alias("text_share")).select("text_share", F.when(F.col("text_share") > 0.5, 200).otherwise(16).cast("long").alias("files_per_batch"), F.when(F.col("text_share") > 0.5, 1).otherwise(4).cast("long").alias("parallel_batches"))


def write_collection(chunks: DataFrame, path: str) -> None:
    """Appends chunks (collection_name among their columns); each collection is a folder, so a search prunes to its own."""
    chunks.write.mode("append").partitionBy("collection_name").parquet(path)


def read_collections(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if names is None else rows.where(F.col("collection_name").isin(*names))


def payloads(elements: DataFrame, collection: str) -> DataFrame:
    """key, content of elements that have a box and are shown by their payload."""
    key = T.object_key(F.lit(collection), F.col("document_name"), F.col("page_number"), F.col("location"))
    return elements.where(F.col("location").isNotNull() & F.col("document_type").isin("image", "structured")).select(key.alias("key"), "content")


def with_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.where(F.col("key").startswith(prefix))
