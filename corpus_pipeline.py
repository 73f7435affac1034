"""A corpus pipeline: documents to the token ids of a mix, in five stages, each written before the next one reads it.

All stages but the last return the columns of documents, and of them only text and n_chars (line_dedup) and null values of lang
(language_id) are changed: columns of other tables, of whatever name, pass through. Null and empty texts, and texts without a
letter, have no language and end at the first stage; so do texts whose language is not told with a margin. A text of which every
line is repeated becomes empty and stays in later stages, where it is linked with nothing and mixed with size 0. Rows that share
doc_id and text are treated alike by every stage; null doc_ids are allowed. Very long texts are taken whole. Ties go to the
smaller doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, common, lang_id, line_dedup, mixing, near_dedup
from lodestone.llm.tokens import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; those without lang get it."""
    common.small_batches(spark)
    names = ("__lang_pred", "__lang_score", "__lang_rejected")
    told = lang_id.predict(docs, lang_id.learnt(docs), names=names).where(~F.col(names[2]))
    return told.select(*(F.coalesce("lang", names[0]).alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier one has."""
    return line_dedup.stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8)."""
    return near_dedup.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, whole."""
    return mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids (little-endian unsigned 32-bit integers) of each row."""
    common.small_batches(spark)
    out = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path())
    return out.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mix), ("bpe", encode)]

#: SQL expresses neither compression nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.drop(before)  # nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
