"""Model-shaped steps behind small protocols, with offline defaults that always give the same."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let


class Generator(Protocol):
    def __call__(self, prompt: Column, max_chars: int) -> Column: ...


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    """The relevance of a text to a query, as a logit."""

    def __call__(self, query: Column, text: Column) -> Column: ...


def shared_words(query: Column, text: Column) -> Column:
    """A Reranker: ten times the share of the query's distinct words that text has, less five; -5 for a query without words."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return let(words(query), lambda q: F.when(F.size(q) > 0, 10.0 * F.size(F.array_intersect(q, words(F.coalesce(text, F.lit(""))))) / F.size(q) - 5.0).otherwise(-5.0))


def first_sentences(prompt: Column, max_chars: int = 200) -> Column:
    """The first sentences, up to the one that does not fit max_chars; at least the first."""
    sentences = F.filter(F.split(prompt, r"(?<=[.!?])\s+"), lambda s: s != "")

    def step(a: Column, s: Column) -> Column:
        first = a["text"] == ""
        fits = a["open"] & (first | (F.length(a["text"]) + F.length(s) + 1 <= max_chars))
        more = F.concat(a["text"], F.when(first, "").otherwise(" "), s)
        return F.struct(F.when(fits, more).otherwise(a["text"]).alias("text"), fits.alias("open"))

    return F.aggregate(sentences, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), step, lambda a: a["text"])


def first_sentences_sql(text: str, most: int = 200) -> str:
    """first_sentences as SQL: sentences are added while all of them, joined by blanks, fit."""
    sentences = f"list_filter(string_split(regexp_replace({text}, '([.!?])[ \\t\\n\\f\\r\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
    fitting = f"list_filter({sentences}, lambda s, i: i = 1 OR length(array_to_string({sentences}[1:i], ' ')) <= {most})"
    return f"array_to_string({fitting}, ' ')"


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """Counts of words by hash, brought to length 1."""
    slots = F.transform(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
