import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import divergence

from ..conftest import SMALL
from .fixtures import awkward, empty

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    count, df, out = Counter(), Counter(), []
    for lang, source, terms in docs:
        count.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    for lang in {x for x, *_ in docs}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        sources = sorted({s for x, s, _ in docs if x == lang})
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s, t] + 1) // (n[s] + len(kept)) for t in kept} for s in sources}
        whole = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[lang, s, t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def ours(out):
    return sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n, seed, sources):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghÉß日", k=rng.randint(1, 20))) for _ in range(60)] + ["Alpha", "alpha", "ÉCOLE", "verylongwordthatgoeson", "verylongwordthatgoeson2"]
    return [(" ".join(rng.choices(words, k=rng.randint(0, 40))).replace("a", rng.choice("aA")) + rng.choice(["", "\0", "!x", "\n"]), rng.choice(["en", "de", None]), f"s{min(rng.randrange(sources), rng.randrange(sources))}") for _ in range(n)]


@pytest.mark.parametrize("sizes", [(64, 4096), (2, 5), (3, 1)])
def test_against_brute_force(spark, sizes):
    rows = corpus(300, 4, 7) + [(None, "fr", "s1"), ("", "fr", "s2"), ("only twice", "es", "s"), ("only twice", "es", None), ("x", "pt", "alone")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    cells, groups = divergence.tables(docs, 3)
    out = divergence.pair_part(cells, groups, *sizes).unionByName(divergence.term_part(cells, groups, 200))
    assert ours(out) == brute(rows)


def test_sums_that_are_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 300)
    monkeypatch.setattr(divergence, "ROWS", 40)
    rows = corpus(200, 9, 3)
    assert ours(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").coalesce(2), 2, 5)) == brute(rows, 2, 5)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang", "source").collect()]
    assert ours(divergence.op11(spark, SMALL)) == brute(rows)


def test_sorted_runs():
    rng = random.Random(8)
    terms = ["".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(800)] + ["a" * 8, "a" * 9, "a" * 16, "a" * 17] * 2
    lens = np.array([len(t) for t in terms])
    order, run = divergence.sorted_runs(np.frombuffer("".join(terms).encode(), np.uint8), np.cumsum(lens) - lens, lens)
    assert [terms[i] for i in order] == sorted(terms)
    assert [run[k] == run[k - 1] for k in range(1, len(run))] == [terms[order[k]] == terms[order[k - 1]] for k in range(1, len(run))]


def test_views_of_sliced_arrays():
    data, at = divergence.text_bytes(pa.array(["skip", "ab", "", "é"]).slice(1))
    assert data.tobytes() == "abé".encode() and at.tolist() == [0, 2, 2, 4]


def test_awkward_rows(spark):
    assert ours(divergence.audit(empty(spark))) == []
    docs = awkward(spark, extra=True)
    assert ours(divergence.audit(docs, 1)) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 1)


def test_large_numbers_stay_exact(spark):
    from pyspark.sql import functions as F

    n = 10**13
    row = spark.range(1).select(divergence.probability(F.lit(n - 5).cast("long"), F.lit(n).cast("long"), F.lit(7).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n - 4) // (n + 7)
