"""Summaries of documents: single pass, a fold over chunks, and levels of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .chunking import token_length
from .models import Generator, first_sentences


def assemble(elements: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """by, text: elements' texts in order, joined by a blank."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return elements.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x[text]), " ").alias("text"))


def single_pass(docs: DataFrame, max_tokens: int, generate: Generator = first_sentences, max_chars: int = 200) -> DataFrame:
    """docs with summary, made of the whole text, or of its first 4 * max_tokens characters if it has more than max_tokens tokens."""
    text = F.col("text")
    over = (F.length(text) > max_tokens) & (token_length(text) > max_tokens)  # a token has a character at least
    return docs.withColumn("summary", generate(F.when(over, F.substring(text, 1, 4 * max_tokens)).otherwise(text), max_chars))


def iterative(chunks: DataFrame, by: str, generate: Generator = first_sentences, max_chars: int = 200) -> DataFrame:
    """by, summary: a fold over a document's chunks (chunk_no, chunk), summary and next chunk making the next summary."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    rows = chunks.groupBy(by).agg(ordered.alias("chunks"))
    return rows.select(by, F.aggregate("chunks", F.lit(""), lambda a, c: generate(F.concat_ws(" ", F.when(a != "", a), c["chunk"]), max_chars)).alias("summary"))


def batch_numbers(lengths: Column, most: int) -> Column:
    """The batch of each length: batches are filled in order while their sum is at most `most`; one item always fits."""
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, n: Column) -> Column:
        new = (F.size(a["out"]) > 0) & (a["sum"] + n > most)
        batch = F.when(new, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(batch.alias("batch"), F.when(new, n).otherwise(a["sum"] + n).cast("long").alias("sum"), F.concat(a["out"], F.array(batch)).alias("out"))

    return F.aggregate(lengths, start, step, lambda a: a["out"])


def combined(summaries: Column, most: int, generate: Generator, max_chars: int) -> Column:
    """The next level of an array of summaries: those of a batch, joined by blanks, make one."""
    batches = batch_numbers(F.transform(summaries, lambda x: F.length(x).cast("long")), most)

    def join(pairs: Column) -> Column:
        batch = lambda b: F.array_join(F.transform(F.filter(pairs, lambda p: p["batch"] == b), lambda p: p["s"]), " ")
        return F.transform(F.array_distinct(F.transform(pairs, lambda p: p["batch"])), lambda b: generate(batch(b), max_chars))

    return let(F.zip_with(summaries, batches, lambda s, b: F.struct(s.alias("s"), b.alias("batch"))), join)


def hierarchical(chunks: DataFrame, by: str, most: int, generate: Generator = first_sentences, max_chars: int = 200, levels: int = 8) -> DataFrame:
    """by, level, n_summaries, summary (null while there are several): each chunk is summarised, then batches of summaries, in
    order and of at most `most` characters, until one is left. The last level puts everything together, so it always ends.
    A document's summaries meet once; all levels are worked out inside its row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("chunk_no").cast("long").alias("n"), generate(F.col("chunk"), max_chars).alias("s"))))
    docs = chunks.groupBy(by).agg(F.transform(ordered, lambda x: x["s"]).alias("first"))

    def from_level(level: int, s: Column) -> Column:
        here = F.array(F.struct(F.lit(level).cast("long").alias("level"), F.size(s).cast("long").alias("n_summaries"), F.when(F.size(s) == 1, s[0]).alias("summary")))
        if level == levels - 1:
            return here
        limit = most if level < levels - 2 else 1 << 60
        return F.when(F.size(s) > 1, F.concat(here, let(combined(s, limit, generate, max_chars), lambda x: from_level(level + 1, x)))).otherwise(here)

    return docs.select(by, F.inline(let(F.col("first"), lambda x: from_level(0, x))))
