"""Ingestion of a stream of documents, or of a folder of files, into chunks, with a status for each document.

Each batch is compared with what is stored: a document whose collection has one of its name is refused, however long ago that came,
and so are files of other kinds and documents without text. A batch writes its chunks, then its statuses, then an empty file with its name;
readers take named batches only, so chunks and statuses appear together. A batch that runs again writes the same folders anew and
compares itself with the batches before it, so nothing is stored twice after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.chunking import SPACE, chunk
from ..sources.files import ALLOWED, TEXT_LIKE
from ..sources.shared import drop, written

CHUNKS = "document_name string, chunk_no long, chunk string, batch string, collection_name string"
STATUSES = "collection_name string, document_name string, status string, error string, batch string"
KEY = ("collection_name", "document_name")


def files(spark: SparkSession, folder: str, per_batch: int = 200) -> DataFrame:
    """A stream of the files below folder, oldest first, at most per_batch in a batch: collection_name (the folder they lie in),
    document_name, text (null where the kind of file has none here), path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    name = T.basename(F.col("path"))
    kind = T.extension(name)
    raw = F.decode("content", "utf-8")
    text = F.when(kind.isin("html", "htm"), T.html_text(raw)).when(kind.isin(*TEXT_LIKE), raw)
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("collection_name"), name.alias("document_name"), text.alias("text"), "path", kind.isin(*ALLOWED).alias("allowed"))


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the batches that are whole."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/batches")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(place)) if store.exists(place) else []


def _read(spark: SparkSession, root: str, kind: str, schema: str, but: str | None = None) -> DataFrame:
    names = [n for n in committed(spark, root) if n != but]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*(f"{root}/{kind}/batch={n}" for n in names))


def chunks(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "chunks", CHUNKS)


def statuses(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "statuses", STATUSES)


def judged(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch: collection_name, document_name, text and perhaps path, allowed. With error, null for documents that are taken in: of
    several of a name in one batch the one with the smallest path, or, without paths, hash."""
    allowed = F.coalesce(F.col("allowed"), F.lit(False)) if "allowed" in batch.columns else F.lit(True)
    path = F.col("path") if "path" in batch.columns else F.xxhash64("text")
    fit = allowed & F.coalesce(F.col("text").rlike(rf"[^{SPACE}]"), F.lit(False))
    rows = batch.withColumn("_fit", fit).withColumn("_path", path)
    slim = rows.select(*KEY, "_fit", "_path").withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "_fit").orderBy("_path")))
    first = slim.where("_fit and _n = 1").select(*KEY, F.col("_path").alias("_first")).withColumn("_wins", F.lit(True))
    had = stored.select(*KEY).distinct().withColumn("_had", F.lit(True))
    rows = rows.join(had, list(KEY), "left").join(first, list(KEY), "left")
    name = F.col("document_name")
    error = (
        F.when(name.isNull() | F.col("collection_name").isNull(), "a document needs a name and a collection").when(~allowed, F.concat(F.lit("files of this kind are not taken in: "), name))
        .when(F.col("_had"), F.concat(F.lit("Document "), name, F.lit(" already exists. Use update document API instead."))).when(~F.col("_fit"), F.concat(F.lit("no text in "), name))
        .when(~F.col("_path").eqNullSafe(F.col("_first")), F.concat(F.lit("Document "), name, F.lit(" is more than once in this batch.")))
    )
    return rows.select(*KEY, "text", error.alias("error"), "_path")


def ingest(docs: DataFrame, root: str, checkpoint: str, upload: str, size: int = 1024, overlap: int = 150) -> StreamingQuery:
    """docs: a stream of what judged() takes, run to the end of what there is. upload: a name of letters and digits for this stream,
    one for each checkpoint, which names its batches."""

    def store(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{upload}-{number:08d}"
        stored = _read(spark, root, "statuses", STATUSES, but=name).where("status = 'SUCCESS'")
        rows = written(judged(batch, stored), "judged")
        new = rows.where("error is null").dropDuplicates([*KEY]).select(*KEY, "text")
        chunk(new, size, overlap).write.mode("overwrite").partitionBy("collection_name").parquet(f"{root}/chunks/batch={name}")
        status = rows.select(*KEY, F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), "error").distinct()
        status.write.mode("overwrite").parquet(f"{root}/statuses/batch={name}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/batches/{name}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True).close()
        drop(rows)

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
