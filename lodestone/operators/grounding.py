"""Whether the sentences of an answer are supported by passages, without a model: by alignment.

A sentence of the answer is supported by a sentence of a passage as far as that has its words, each weighed by how few sentences of
the passage have it; words that the passage lacks weigh most. The sentences of an answer are aligned with those of a passage in order:
a later sentence is never supported by an earlier one of the passage than the sentence before it, and the sum of supports is the
largest possible. Of several passages the one that supports a sentence most counts. Sentences under a threshold are named as
unsupported.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .term_index import words

LEAST = 0.5


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.size(words(s)) > 0)


def supports(answer: list[list[str]], passage: list[list[str]]) -> np.ndarray:
    """A row for each sentence of the answer, a column for each of the passage: the weighted share of the row's words it has."""
    sets = [set(s) for s in passage]
    df = Counter(w for s in sets for w in s)
    weight = lambda w: math.log(1 + len(sets) / max(0.5, df[w]))
    out = np.zeros((len(answer), len(passage)))
    for i, s in enumerate(answer):
        own = {w: weight(w) for w in sorted(set(s))}
        whole = sum(own.values())
        for j, has in enumerate(sets):
            out[i, j] = sum(own[w] for w in own if w in has) / whole if whole else 0.0
    return out


def align(scores: np.ndarray) -> list[int]:
    """For each row a column, never falling, so that the sum of their scores is the largest: of equal ones the first columns."""
    n, m = scores.shape
    if not m:
        return [-1] * n
    best = np.zeros((n + 1, m))  # best[i, j]: the most of rows i and later from column j on
    for i in range(n - 1, -1, -1):
        here = scores[i] + best[i + 1]
        best[i] = np.maximum.accumulate(here[::-1])[::-1]
    out, j = [], 0
    for i in range(n):
        here = scores[i, j:] + best[i + 1, j:]
        j += int(np.argmax(here))
        out.append(j)
    return out


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs: answer_id, answer, passage_id, passage. answer_id, sentence_no, passage_id, passage_sentence_no, support: a row for each
    sentence of the answer and passage."""
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("answer_id", "passage_id"))
    split = lambda c: F.transform(sentences(F.coalesce(F.col(c), F.lit(""))), words)

    def run(batches):
        for batch in batches:
            for i, (answer, passage) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if not answer:
                    continue
                scores = supports(answer, passage)
                at = align(scores)
                which = pa.array([i] * len(at))
                support = [float(scores[n, j]) if j >= 0 else 0.0 for n, j in enumerate(at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(range(len(at)), pa.int64()), pa.array(at, pa.int64()), pa.array(support)], ["answer_id", "passage_id", "sentence_no", "passage_sentence_no", "support"])

    return pairs.select("answer_id", "passage_id", split("answer").alias("_a"), split("passage").alias("_p")).mapInArrow(run, f"{kinds}, sentence_no long, passage_sentence_no long, support double")


def grounding(answers: DataFrame, pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """answers: answer_id, answer; pairs: answer_id, passage_id, passage. answer_id, sentence_no, sentence, passage_id (of the passage
    that supports it most, of equal ones the smallest), passage_sentence_no, support, supported: a row for each sentence with words."""
    told = answers.select("answer_id", F.posexplode(sentences(F.col("answer"))).alias("sentence_no", "sentence")).withColumn("sentence_no", F.col("sentence_no").cast("long"))
    rows = aligned(pairs.join(answers.select("answer_id", "answer"), "answer_id")).where("passage_sentence_no >= 0")
    top = rows.groupBy("answer_id", "sentence_no").agg(F.max("support").alias("support"))
    best = rows.join(top, ["answer_id", "sentence_no", "support"]).groupBy("answer_id", "sentence_no", "support").agg(F.min(F.struct("passage_id", "passage_sentence_no")).alias("b"))
    out = told.join(best, ["answer_id", "sentence_no"], "left")
    support = F.coalesce("support", F.lit(0.0))
    return out.select("answer_id", "sentence_no", "sentence", "b.passage_id", "b.passage_sentence_no", support.alias("support"), (support >= least).alias("supported"))


def groundedness(rows: DataFrame) -> DataFrame:
    """rows: what grounding() gives. answer_id, groundedness (share of supported sentences), unsupported (the others, in order)."""
    mark = F.struct("sentence_no", "sentence")
    named = F.transform(F.array_sort(F.collect_list(F.when(~F.col("supported"), mark))), lambda x: x["sentence"])  # of one answer
    return rows.groupBy("answer_id").agg(F.avg(F.col("supported").cast("double")).alias("groundedness"), named.alias("unsupported"))
