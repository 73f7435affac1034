"""The registered queries and their SQL."""

from . import collections, filters, retrieval, streams, texts  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["rag_answer_extractive"](spark, sf_dir)
