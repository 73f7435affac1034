"""Operator 1: token counts by a separator scan over flat, unindexed token files.

Token files hold the ids of documents one after another, each followed by an end-of-document id, and nothing else. Blocks of
a file are searched for that id with numpy; a prefix scan over one small row for each block stitches documents that cross
block boundaries. Ids take two bytes, or four where the tokenizer has larger ones.

Empty texts and nulls are documents of 0 tokens, empty files and tables give no rows, repeated rows are documents of their own,
also where they share a doc_id, which may be null: documents are told apart by file and place, so nothing is tied. Very long
texts are encoded whole and may span any number of blocks. Text behind a file's last separator is a document without an end
(ended is false). Columns besides doc_id and text, of whatever name, are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import library_table, token_type, tokenizer_path

DTYPE = "<u2"
BLOCK, BLOCKS_A_TASK = 4 << 20, 64
#: Names that Hadoop has for a store, and the library's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "dbfs": "file"}


def open_store(path: str):
    """(filesystem, path in it): a local, HDFS or object store, by the URI, under Hadoop's names of them too."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme in SCHEMES:
        path = f"file:///dbfs/{rest.lstrip('/')}" if scheme == "dbfs" else f"{SCHEMES[scheme]}:{rest}"
    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, path: str, eod: int, folder: str, dtype: str | None = None, chars: int = 2_000_000) -> DataFrame:
    """A token file for each partition, in folder. Rows: file, ordinal, doc_id. The rows are written too, so a task that runs
    twice leaves a file that no row names. dtype: by default what the tokenizer's ids need; one too small is refused."""
    needed = token_type(path)
    dtype = dtype or needed
    if np.dtype(dtype).itemsize < np.dtype(needed).itemsize:
        raise ValueError(f"ids of {path} do not fit {dtype}")
    if eod >= 1 << (8 * np.dtype(dtype).itemsize):
        raise ValueError(f"{eod} does not fit {dtype}")

    def run(batches):
        table, n, store, out, name = library_table(path, as_text=True), 0, None, None, ""
        try:
            for batch in batches:
                texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                if texts and out is None:
                    store, inside = open_store(folder)
                    store.create_dir(inside, recursive=True)
                    name = f"{uuid.uuid4().hex}.tok"
                    out = store.open_output_stream(f"{inside}/{name}")
                for a, b in common.slices([len(x) for x in texts], chars):
                    flat, per = table.encode(texts[a:b])
                    out.write(np.insert(flat.astype(dtype), np.cumsum(per), eod).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(np.arange(n, n + len(texts), dtype=np.int64)), ids], ["file", "ordinal", "doc_id"])
                n += len(texts)
        finally:
            if out is not None:
                out.close()

    return common.materialize(docs.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long"), "token-order")


def scan(spark: SparkSession, folder: str, files: DataFrame, eod: int, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """files: rows with a distinct file (name in folder). Rows: file, ordinal, start, n_tokens, ended."""
    width = np.dtype(dtype).itemsize
    step = block // width * width

    def sizes(batches):
        store, inside = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                size = store.get_file_info(f"{inside}/{name}").size
                for at in range(0, size, step):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([min(step, size - at)], pa.int64())], ["file", "at", "size"])

    def read(batches):
        store, inside = open_store(folder)
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{inside}/{name}") as f:
                    ids = np.frombuffer(f.read_at(size, at), dtype)
                ends = (np.flatnonzero(ids == eod) + at // width).astype(np.int64)
                starts = pa.array(np.concatenate([[0], ends[:-1] + 1])[: len(ends)], pa.int64(), mask=np.arange(len(ends)) == 0)
                docs = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.StructArray.from_arrays([starts, pa.array(ends)], ["start", "end"]))
                last = pa.array([int(ends[-1]) if len(ends) else None], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // width], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), last, docs], ["file", "at", "size", "n", "last", "docs"])

    blocks = common.materialize(files.select("file").mapInArrow(sizes, "file string, at long, size long"), "token-spans")
    found = common.packed(blocks, blocks.count(), BLOCKS_A_TASK).mapInArrow(read, "file string, at long, size long, n long, last long, docs array<struct<start: long, end: long>>")
    found = common.materialize(found, "token-blocks")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("at").rowsBetween(1, 1)
    stitched = found.select("file", "at", "size", "n", "last", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("start"), F.max("at").over(after).alias("next"))
    inner = found.select("file", "at", "docs").join(stitched.select("file", "at", "ordinal", F.col("start").alias("carried")), ["file", "at"])
    inner = inner.select("file", "ordinal", "carried", F.posexplode("docs").alias("k", "doc"))
    inner = inner.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.coalesce("doc.start", "carried").alias("start"), "doc.end", F.lit(True).alias("ended"))
    rest = stitched.where("next is null").select("file", (F.col("ordinal") + F.col("n")).alias("ordinal"), F.coalesce(F.col("last") + 1, "start").alias("start"), (F.col("at") + F.col("size")).alias("end"), F.lit(False).alias("ended"))
    both = inner.unionByName(rest.where("end > start"))
    return both.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")


def op1(spark: SparkSession, sf_dir: str, path: str | None = None, eod: int = 50256, block: int = BLOCK) -> DataFrame:
    return count(common.documents(spark, sf_dir), path or tokenizer_path(), eod, block)


def count(docs: DataFrame, path: str, eod: int = 50256, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of each row: its texts are written to token files, and the files alone are scanned."""
    spark = docs.sparkSession
    common.small_batches(spark)
    folder = common.new_path(spark, "token-files")
    order = write_token_files(docs, path, eod, folder)
    spans = scan(spark, folder, order.select("file").distinct(), eod, token_type(path), block)
    common.remove(spark, folder)  # what scan() found is written
    return order.join(spans, ["file", "ordinal"]).select("doc_id", "n_tokens")
