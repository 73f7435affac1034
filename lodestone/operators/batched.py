"""Models applied in batches: loaded once in each worker, rows of like length together, rows that fail tried again alone."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .search import confident, normalize, top_k

#: A model takes lists of its inputs, one value of each for a row, and gives a value for each row; it is made by a function that is
#: called once in each worker.
Model = Callable[..., list]
_loaded: dict[str, Model] = {}


def loaded(name: str, load: Callable[[], Model]) -> Model:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def batches(sizes: list[int], rows: int, most: int) -> list[list[int]]:
    """Places in sizes by falling size: at most rows of them, and at most `most` as the largest size times their number, or one."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if out and len(out[-1]) < rows and sizes[out[-1][0]] * (len(out[-1]) + 1) <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def apply(rows: DataFrame, inputs: dict[str, Column], name: str, load: Callable[[], Model], result: T.DataType, column: str = "result", batch: int = 32, signs: int = 200_000, tries: int = 2) -> DataFrame:
    """rows with column, what the model called name gives for inputs (strings), and column_error. A batch that fails is taken row by
    row; a row that fails tries times is null with the last error. signs bounds a batch's rows times its longest row."""
    kept = [f for f in rows.schema.fields if f.name not in (column, f"{column}_error")]
    schema = T.StructType([*kept, T.StructField(column, result), T.StructField(f"{column}_error", T.StringType())])
    kind, width = to_arrow_type(result), len(inputs)

    def run(arrow):
        model = loaded(name, load)

        def alone(row: list) -> tuple[Any, str | None]:
            error = ""
            for _ in range(tries):
                try:
                    return model(*([x] for x in row))[0], None
                except Exception as e:  # the model's own: told in the row
                    error = f"{type(e).__name__}: {e}"
            return None, error

        for part in arrow:
            values = [part.column(part.num_columns - width + i).to_pylist() for i in range(width)]
            out: list = [None] * part.num_rows
            for some in batches([sum(len(v[i] or "") for v in values) for i in range(part.num_rows)], batch, signs):
                asked = [[v[i] for i in some] for v in values]
                try:
                    found = model(*asked)
                    if len(found) != len(some):
                        raise ValueError(f"{len(found)} results for {len(some)} rows")
                    told = [(x, None) for x in found]
                except Exception:
                    told = [alone(list(row)) for row in zip(*asked)]
                for i, x in zip(some, told):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array([x for x, _ in out], kind), pa.array([e for _, e in out], pa.string())], schema.names)

    return rows.select(*(f.name for f in kept), *(c.alias(f"_input_{i}") for i, c in enumerate(inputs.values()))).mapInArrow(run, schema)


def word_sets(text: str | None) -> set[str]:
    return set("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def shared_words() -> Model:
    """The reranker of the same name in batches: ten times the share of a query's words that a text has, less five."""

    def scores(queries: list[str | None], texts: list[str | None]) -> list[float | None]:
        asked, has = [word_sets(q) for q in queries], [word_sets(t) for t in texts]
        size = np.array([len(q) for q in asked], np.float64)
        both = np.array([len(q & t) for q, t in zip(asked, has)], np.float64)
        return np.where(size > 0, 10.0 * both / np.maximum(size, 1) - 5.0, -5.0).tolist()

    return scores


def projected_words(dimensions: int = 64) -> Callable[[], Model]:
    """An embedder: the sum of a text's word vectors (signs by a hash), brought to length 1; zero for a text without words."""

    def load() -> Model:
        def embed(texts: list[str | None]) -> list[list[float]]:
            words = [sorted(word_sets(t)) for t in texts]
            flat = np.array([zlib.crc32(w.encode()) for x in words for w in x], np.uint64)
            spread = (flat[:, None] * np.arange(1, 2 * dimensions, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
            sums = np.zeros((len(words), dimensions))
            np.add.at(sums, np.repeat(np.arange(len(words)), [len(x) for x in words]), 1.0 - 2.0 * spread)
            norm = np.sqrt((sums**2).sum(1))
            return (sums / np.where(norm > 0, norm, 1)[:, None]).tolist()

        return embed

    return load


def rerank(queries: DataFrame, hits: DataFrame, k: int, threshold: float = 0.0, name: str = "shared-words", load: Callable[[], Model] = shared_words, **options) -> DataFrame:
    """search.rerank() with a model in batches; hits whose scoring failed count as scored 0, as hits without a score do."""
    pairs = hits.join(queries.select("query_id", "query"), "query_id")
    scored = apply(pairs, {"query": F.col("query"), "text": F.col("text")}, name, load, T.DoubleType(), "score", **options)
    return top_k(confident(normalize(scored), threshold), "relevance_score", k, ["query_id"], descending=True).drop("query", "score")


def embed(rows: DataFrame, text: str = "text", column: str = "embedding", name: str = "projected-words", load: Callable[[], Model] | None = None, **options) -> DataFrame:
    return apply(rows, {"text": F.col(text)}, name, load or projected_words(), T.ArrayType(T.DoubleType()), column, **options)
