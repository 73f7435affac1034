import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.operators import chunking

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["word", " other", " ", "  ", "\n", "\n\n", ". ", "!", "? ", "é", "日本", "😀", "x1", "\t", " \n \n", "_a", "-", "<|endoftext|>", " Überraschung"]


def texts():
    rng = random.Random(6)
    return ["one", " lead", "trail  ", "One two three. Four five six! Seven eight nine?\n\nThirteen " * 5, "😀" * 40] + ["".join(rng.choices(PIECES, k=rng.randint(1, 200))) for _ in range(40)]


def by_hand(text, ends, size, overlap):
    """The same rule, place by place."""
    least, start, out, n = max(1, int(size * 0.7)), 0, [], len(ends)

    def kind(stop):
        at = ends[stop - 1]
        head, tail = text[:at], text[at:]
        if head.endswith("\n") and "\n" in head[:-1] and not head[head[:-1].rindex("\n") : -1].strip(" \t\r\n"):
            last = [m.end() for m in chunking.LINES.finditer(text)]
            if at in last:
                return 4
        if head.endswith("\n"):
            return 3
        if head[-1:] in ".!?" and tail[:1] in tuple(" \t\n\r\f\x0b"):
            return 2
        return 1 if tail[:1] in tuple(" \t\n\r\f\x0b") and head[-1:] not in tuple(" \t\n\r\f\x0b") else 0

    while start < n:
        stop = n
        if start + size < n:
            best = max(range(start + least, start + size + 1), key=lambda e: (kind(e), e) if kind(e) > 0 else (0, e))
            stop = best if kind(best) > 0 else start + size
        out.append((start, stop))
        start = n if stop >= n else max(stop - overlap, start + 1)
    return out


@pytest.mark.parametrize("size, overlap", [(20, 5), (7, 0), (3, 1), (1, 0), (500, 20)])
def test_against_the_rule_place_by_place(spark, size, overlap):
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {}
    for r in chunking.chunk_by_tokens(docs, PATH, size, overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    for i, text in enumerate(texts()):
        ends = np.maximum.accumulate([e for _, e in model.encode(text, add_special_tokens=False).offsets]).tolist()
        ends[-1] = len(text)
        at = [0, *ends]
        want = [text[at[a] : at[b]] for a, b in by_hand(text, ends, size, overlap)]
        assert got.get(i, []) == (want if text.strip() else []), (i, text)


def test_ends_of_pieces_are_those_of_whole_texts():
    tokens = chunking.TokenEnds(PATH, most=50)
    assert tokens.cut
    for text in texts() * 2:
        whole = tokens.whole(text)
        whole[-1] = len(text)
        assert tokens.of(text).tolist() == whole, text


def test_nothing_is_lost(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    parts = chunking.chunk_by_tokens(docs, PATH, 9, 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c"))
    assert all("".join(x["chunk"] for x in r["c"]) == texts()[r["doc_id"]] for r in parts.collect())


def test_null_blank_and_long_texts_and_other_columns(spark):
    rows = [(1, None, "k"), (2, " \n", "k"), (3, "", "k"), (4, "word " * 30_000, "k")]
    out = chunking.chunk_by_tokens(spark.createDataFrame(rows, "doc_id long, text string, kept string"), PATH)
    assert out.columns == ["doc_id", "kept", "chunk_no", "chunk"]
    assert out.select("doc_id", "kept").distinct().collect() == [(4, "k")] and out.count() > 50
    with pytest.raises(ValueError):
        chunking.chunk_by_tokens(out, PATH, 0)
