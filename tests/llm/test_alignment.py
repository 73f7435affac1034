import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import alignment
from lodestone.llm.tokens import tokenizer_path

from ..conftest import SMALL
from .fixtures import awkward, empty

A, B = tokenizer_path(), tokenizer_path(alignment.PIECES)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, libraries):
    """(id, start, end) of A and of B by the libraries alone; none where they do not give back the text."""
    a, b = libraries
    if not text:
        return [], []
    raw, out = f" {text}".encode(), []
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    first = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    for found in (first, second):
        if b"".join(x for _, x in found) != raw:
            return [], []
        at, spans = 0, []
        for i, x in found:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(texts, libraries):
    found, counts = [], Counter()
    for text in texts:
        a, b = tokens(text, libraries)
        links, at = [], 0
        for i, s, e in a:
            while at < len(b) and b[at][2] <= s:
                at += 1
            k = at
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [",".join(str(i) for i, _, e in side if lo < e <= hi) for lo, hi in zip([0, *ends], ends) for side in (a, b)]
        whole = ";".join(f"{x}|{y}" for x, y in zip(groups[::2], groups[1::2]))
        found.append((len(a), len(b), len(ends), links, hashlib.sha256(whole.encode()).hexdigest() if a else ""))
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, n_g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), h) for n_a, n_b, n_g, links, h in found], counts, most


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def compare(docs, rows, libraries):
    rows = sorted(rows, key=repr)
    ours = sorted([(r["doc_id"], *(r[c] for c in COLUMNS)) for r in docs.collect()], key=repr)
    told, *_ = brute([t for _, t in rows], libraries)
    assert ours == sorted([(d, *x) for (d, _), x in zip(rows, told)], key=repr)


def test_against_the_libraries(spark, libraries):
    rng = random.Random(5)
    signs = ["a", "B", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "<s>", "<|endoftext|>", "'s", "123", "the ", " quick", " ", "\0", "ﬁ", "Ａ", "\r\n", "é", "​", "ß", " Straße"]
    rows = [(i, "".join(rng.choices(signs, k=rng.randint(1, 25)))) for i in range(600)] + [(1000, None), (1001, ""), (None, "x y"), (None, "x y"), (7, "x " * 20_000), (1002, " "), (1003, "a "), (1004, " a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(alignment.align_documents(docs)[0], rows, libraries)


def test_whole_table_against_the_libraries(spark, libraries):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    compare(alignment.op13(spark, SMALL), rows, libraries)


def test_pairs_and_partial_counts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 50)
    texts = [f"word number {i} of a longer sentence, Überraschung {i % 7}" for i in range(80)]
    docs, pairs = alignment.align_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    _, counts, most = brute(texts, libraries)
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {k: (n, n == most[k[1]]) for k, n in counts.items()}
    compare(docs, list(enumerate(texts)), libraries)


def test_gallop_finds_what_search_finds():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 1000):
        ends = np.cumsum(rng.integers(1, 9, n))
        want = rng.integers(1, ends[-1] + 1, 500)
        guess = rng.integers(0, n, 500)
        assert (alignment.gallop(want, ends, np.zeros(500, int), np.full(500, n), guess) == np.searchsorted(ends, want)).all()


def test_awkward_rows(spark):
    assert alignment.align_documents(empty(spark))[0].count() == 0
    out = alignment.align_documents(awkward(spark, extra=True), keep=("doc_id", "lang"))[0]
    assert out.columns[:2] == ["doc_id", "lang"] and out.count() == 11
    assert {r["n_a"] for r in out.where(F.col("doc_id").isin(3, 4)).collect()} == {0}
