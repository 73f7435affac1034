"""Small tables with the awkward cases that every operator meets."""

import random

AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1", 60),
    (2, "Alpha beta  gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1", 61),
    (3, None, None, None, None),
    (4, "", "en", "s2", 0),
    (5, " \n\t ", "de", "s2", 3),
    (6, "one", "fr", None, 3),
    (6, "one", "fr", None, 3),
    (None, "no id but some words here to count and to keep around", "en", "s1", 10),
    (7, "x " * 30_000, "en", "s3", 60_000),
    (8, "a b c d e a b c d e a b c d e f", "es", "s1", 31),
    (9, "<|endoftext|> é日本 😀 it's 1234!!", "fr", "s2", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A column of an operator's own names, which is to be overwritten or left out, never to clash.
CLASH = ("score", "kept", "ids", "size", "n", "part", "start", "hash", "_h", "digest", "host_rate", "_host", "rid", "_rid", "n_lines", "n_removed", "lines", "hosts", "rejected", "lang_pred", "epochs", "taken", "weight")


def awkward(spark, extra=False):
    rows = spark.createDataFrame(AWKWARD, SCHEMA)
    for name in CLASH if extra else ():
        from pyspark.sql import functions as F

        rows = rows.withColumn(name, F.lit("clash"))
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(n=120, seed=3):
    """(doc_id, text): random texts, near copies of some, exact copies, shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(300)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passage, out = text(60), []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.35:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        elif kind < 0.5:
            out.append(" ".join(text(rng.randint(5, 80)) + passage + text(rng.randint(5, 60))))
        else:
            out.append(" ".join(text(rng.randint(1, 120))))
    return list(enumerate(out))
