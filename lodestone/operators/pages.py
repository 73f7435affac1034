"""The page that a ground-truth passage stands on.

Alike are two texts by their matching blocks: the longest common block, then the same on both sides of it; twice the signs in blocks
over the signs of both. No sign counts as junk, however often it comes. Which pages are compared with a passage follows from the
passage's rarest runs of words: those that the fewest pages have. A passage that shares no run of words with any page has no page.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shared import written
from .search import top_k
from .term_index import words

RUN, RAREST = 4, 6


def longest_block(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common block; of equal ones the first in a, then in b."""
    best, ends = 0, (0, 0)
    before = np.zeros(len(b) + 1, np.int32)
    now = np.zeros(len(b) + 1, np.int32)
    for i, x in enumerate(a):
        np.multiply(before[:-1] + 1, b == x, out=now[1:])
        k = int(now.argmax())
        if now[k] > best:
            best, ends = int(now[k]), (i + 1, k)
        before, now = now, before
    return ends[0] - best, ends[1] - best, best


def matching(a: np.ndarray, b: np.ndarray) -> int:
    """Signs in matching blocks."""
    todo, total = [(0, len(a), 0, len(b))], 0
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 < a1 and b0 < b1:
            i, j, k = longest_block(a[a0:a1], b[b0:b1])
            if k:
                total += k
                todo += [(a0, a0 + i, b0, b0 + j), (a0 + i + k, a1, b0 + j + k, b1)]
    return total


def ratio(a: str, b: str) -> float:
    """1 for two empty texts."""
    codes = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 2 * matching(codes(a), codes(b)) / (len(a) + len(b)) if a or b else 1.0


def ratios(pairs: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """pairs with ratio(a, b) in place of the two texts, null where one is null."""
    kept = [f for f in pairs.schema.fields if f.name not in (a, b, name)]

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in (a, b))
            found = [None if p is None or q is None else ratio(p, q) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, pa.float64())], [*(f.name for f in kept), name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pairs.select(*(f.name for f in kept), a, b).mapInArrow(run, f"{schema}, {name} double")


def word_runs(text: Column, n: int = RUN) -> Column:
    """Hashes of the distinct runs of n words; of shorter texts the whole."""

    def by_words(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " "))))

    return F.when(F.size(words(text)) > 0, let(words(text), by_words))


def candidates(passages: DataFrame, pages: DataFrame, rarest: int = RAREST) -> DataFrame:
    """passages: passage_id, text; pages: page_id, text. passage_id, page_id: each passage with the pages that have one of its rarest
    runs of words, of those that pages have at all."""
    asked = passages.select("passage_id", F.explode(word_runs(F.col("text"))).alias("run"))
    has = pages.select("page_id", F.explode(word_runs(F.col("text"))).alias("run")).join(asked.select("run").distinct(), "run", "left_semi")
    has = written(has, "runs")  # of few pages, of which all were read
    many = has.groupBy("run").agg(F.count("*").alias("n"))
    chosen = top_k(asked.join(many, "run"), "n", rarest, ["passage_id"], tie="run").select("passage_id", "run")
    return chosen.join(has, "run").select("passage_id", "page_id").distinct()


def best_pages(passages: DataFrame, pages: DataFrame, rarest: int = RAREST) -> DataFrame:
    """passage_id, page_id, ratio: the page most alike to each passage, of equal ones the first. Null and blank texts find nothing."""
    pairs = candidates(passages, pages, rarest)
    texts = pairs.join(passages.select("passage_id", F.col("text").alias("_a")), "passage_id").join(pages.select("page_id", F.col("text").alias("_b")), "page_id")
    return top_k(ratios(texts, "_b", "_a"), "ratio", 1, ["passage_id"], tie="page_id", descending=True).select("passage_id", "page_id", "ratio")
