"""Answers from retrieved passages, with what they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = ("image", "text", "table", "chart", "audio")


def citations(hits: DataFrame, payloads: DataFrame) -> DataFrame:
    """hits (key, document_name, doc_type, content, score, ...) with the content that is shown: text and audio show their own,
    images, tables and charts the payload of their key; hits without any, or of other types, are left out."""
    rows = hits.where(F.col("doc_type").isin(*SHOWN)).join(payloads.select("key", F.col("content").alias("payload")), "key", "left")
    shown = F.when(F.col("doc_type").isin("text", "audio"), F.col("content")).otherwise(F.col("payload"))
    return rows.withColumn("content", shown).where(F.length("content") > 0).drop("payload")


# Fixed value: the answer of a guard that refuses.
REFUSAL = "I'm sorry, I can't respond to that."


def without_refused(answers: DataFrame, text: str = "answer", cited: str = "citations") -> DataFrame:
    """answers, of which refusals cite nothing."""
    none = F.array().cast(answers.schema[cited].dataType)
    return answers.withColumn(cited, F.when(F.col(text) == REFUSAL, none).otherwise(F.col(cited)))


def answer(ranked: DataFrame, top: int, sentence_chars: int = 200) -> DataFrame:
    """answer, n_citations, citations (document_id, score) of the top passages (pk, text, relevance_score)."""
    from .models import first_sentences

    best = ranked.orderBy(F.desc("relevance_score"), "pk").limit(top)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("relevance_score")).alias("s"), "pk", first_sentences(F.col("text"), sentence_chars).alias("t"))))
    rows = best.agg(ordered.alias("x"))
    cited = F.transform("x", lambda c: F.struct(c["pk"].alias("document_id"), F.round(-c["s"], 6).alias("score")))
    return rows.select(F.array_join(F.transform("x", lambda c: c["t"]), "\n").alias("answer"), F.size("x").cast("long").alias("n_citations"), cited.alias("citations"))
