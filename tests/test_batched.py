import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import batched, models


def test_batches_hold_like_sizes():
    assert batched.batches([5, 1, 9, 2, 8], 2, 100) == [[2, 4], [0, 3], [1]]
    assert batched.batches([50, 40, 3, 3, 3], 10, 9) == [[0], [1], [2, 3, 4]]
    assert batched.batches([], 3, 9) == []


def test_scores_are_those_of_the_column(spark):
    texts = ["The quick brown fox", "fox FOX fox, é日本 12", "", None, "it's 10% of_all ... ΣΑΣ ½ Ⅷ", "straße STRASSE", " "]
    pairs = [(i, q, t) for i, (q, t) in enumerate((q, t) for q in texts for t in texts)]
    rows = spark.createDataFrame(pairs, "pk long, query string, text string").where("query is not null")
    out = batched.apply(rows, {"q": F.col("query"), "t": F.col("text")}, "shared-words", batched.shared_words, T.DoubleType(), "score", batch=5, signs=60)
    both = out.select("score", models.shared_words(F.col("query"), F.col("text")).alias("column")).collect()
    assert len(both) == 42 and all(abs(r["score"] - r["column"]) < 1e-12 for r in both)


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}", "w").close()
        return lambda texts: [len(t) for t in texts]

    rows = spark.range(4000).select("id", F.col("id").cast("string").alias("text")).repartition(40)
    out = batched.apply(rows, {"t": F.col("text")}, f"counting-{folder}", load, T.LongType(), "n")
    assert out.agg(F.sum("n")).first()[0] == sum(len(str(i)) for i in range(4000))
    pids = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(pids) == len(set(pids)) < 40


def test_rows_that_fail_are_tried_alone_and_told(spark, tmp_path):
    seen = str(tmp_path)

    def load():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            if "once" in texts and not os.path.exists(f"{seen}/once"):
                if len(texts) == 1:
                    open(f"{seen}/once", "w").close()
                raise RuntimeError("not yet")
            return [t.upper() for t in texts] if "short" not in texts or len(texts) == 1 else []

        return model

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "once", "short", "b"])], "id long, text string").coalesce(1)
    got = {r["text"]: (r["out"], r["out_error"]) for r in batched.apply(rows, {"t": F.col("text")}, f"failing-{seen}", load, T.StringType(), "out").collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: no"), "once": ("ONCE", None), "short": ("SHORT", None), "b": ("B", None)}


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "the old man"), (2, "THE man, old"), (3, "something else"), (4, ""), (5, None)], "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in batched.embed(rows).collect()}
    assert got[1].tolist() == got[2].tolist() != got[3].tolist() and len(got[1]) == 64
    assert got[1] @ got[1] == pytest.approx(1) and not got[4].any() and not got[5].any()
