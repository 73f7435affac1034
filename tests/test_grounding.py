import os
import time
from itertools import combinations_with_replacement

import numpy as np

from lodestone.jobs import catalogue
from lodestone.operators import grounding

from .conftest import SMALL


def test_alignment_against_all_of_them():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 5), rng.integers(1, 5)
        scores = rng.integers(0, 4, (n, m)) / 4
        every = [(sum(scores[i, j] for i, j in enumerate(c)), [-j for j in c]) for c in combinations_with_replacement(range(m), n)]
        assert [-j for j in max(every)[1]] == grounding.align(scores)
    assert grounding.align(np.zeros((2, 0))) == [-1, -1] and grounding.align(np.zeros((0, 3))) == []


def test_sentences_of_answers(spark):
    answers = spark.createDataFrame([(1, "The sun is hot. Cats fly at night! The moon is cold."), (2, None), (3, " ... "), (4, "No passages here.")], "answer_id long, answer string")
    passages = [(1, 10, "We know that the sun is hot. The moon is cold, they say."), (1, 11, "Cats sleep. The moon is a stone."), (1, 12, None), (2, 10, "x")]
    out = grounding.grounding(answers, spark.createDataFrame(passages, "answer_id long, passage_id long, passage string"))
    got = {(r["answer_id"], r["sentence_no"]): (r["passage_id"], r["passage_sentence_no"], r["supported"]) for r in out.collect()}
    assert got[1, 0] == (10, 0, True) and got[1, 2] == (10, 1, True) and not got[1, 1][2] and got[4, 0] == (None, None, False) and len(got) == 4
    told = {r["answer_id"]: (round(r["groundedness"], 3), r["unsupported"]) for r in grounding.groundedness(out).collect()}
    assert told == {1: (0.667, ["Cats fly at night!"]), 4: (0.0, ["No passages here."])}


def test_order_counts():
    passage = [["b", "b2"], ["a", "a2"]]
    scores = grounding.supports([["a", "a2"], ["b", "b2"]], passage)
    at = grounding.align(scores)
    assert at == sorted(at) and sum(scores[i, j] for i, j in enumerate(at)) == 1.0


def test_answers_are_grounded_without_shuffling_the_index(spark):
    """What the query shuffles stays under a few times the documents' own size, which an index that is dealt by term exceeds."""
    big = SMALL.replace("sf0.001", "sf0.01")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        time.sleep(1)  # for the listener
        every = store.executorList(True)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = shuffled()
    rows = catalogue.QUERIES["answer_groundedness"](spark, big).collect()
    assert rows and all(0 <= r["groundedness"] <= 1 for r in rows)
    assert shuffled() - before < 4 * os.path.getsize(f"{big}/documents.parquet")
