import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe, common, token_binary, token_counts, tokens

from ..conftest import SMALL
from .fixtures import awkward, empty

PATH = tokens.tokenizer_path()
PIECES = [" ", "  ", "   ", "\n", "\t", "a", "b", "the", "'s", "'LL", "é", "日本", "1", "23", "!!", "<|endoftext|>", " ", "\x1c", "\x85", "😀", "é", "$$$", "aaaa", "\r\n", "　"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_both_encoders_agree_with_the_library(library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for encoder in (tokens.LibraryEncoder(PATH), bpe.MergeEncoder(PATH)):
        table = tokens.UnitTable(encoder, max_units=500)  # small, so that it is shrunk and cleared on the way
        got = []
        for k in range(0, len(texts), 100):
            flat, per = table.encode(texts[k : k + 100])
            ends = np.cumsum(per)
            got += [flat[e - n : e].tolist() for e, n in zip(ends, per)]
        assert got == want
    decode = bpe.encoder(PATH).decode
    for ids in want[:500]:
        assert decode(np.array(ids, np.uint32)).decode(errors="replace") == library.decode(ids, skip_special_tokens=False)


def test_rounds_merge_in_rank_order(library):
    for text in ["aaaaaaa", "abababab", "lllllllll" * 20, "hellohello", "x" * 5000]:
        assert bpe.MergeEncoder(PATH)([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_op2(spark, library):
    docs = awkward(spark, extra=True)
    rows = sorted(tuple(r) for r in bpe.digests(docs, PATH).where("doc_id is not null").collect())
    want = []
    for r in docs.where("doc_id is not null").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows == sorted(want)
    assert bpe.digests(empty(spark), PATH).count() == 0


def test_round_trip_keeps_columns(spark):
    out = bpe.decode(bpe.encode(awkward(spark, extra=True), PATH), PATH)
    assert out.where("coalesce(text, '') <> decoded").count() == 0
    assert out.select("kept").distinct().first()[0] == "clash" and dict(out.dtypes)["ids"] == "binary"


@pytest.mark.parametrize("block", [2, 6, 1000, token_counts.BLOCK])
def test_op1(spark, block):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    docs = awkward(spark, extra=True)
    if block == 2:
        docs = docs.where("doc_id not in (7)")
    want = sorted(((r["doc_id"] or -1), len(plain.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = sorted(((r["doc_id"] or -1), r["n_tokens"]) for r in token_counts.count(docs, PATH, block=block).collect())
    assert got == want
    assert token_counts.count(empty(spark), PATH).count() == 0


def test_scan_of_a_foreign_file(spark, tmp_path):
    ids = np.array([9, 1, 2, 9, 9, 3, 4, 5], "<u2")
    (tmp_path / "x.tok").write_bytes(ids.tobytes())
    (tmp_path / "e.tok").write_bytes(b"")
    files = spark.createDataFrame([("x.tok",), ("e.tok",)], "file string")
    for block in (2, 4, 64):
        rows = token_counts.scan(spark, f"file://{tmp_path}", files, 9, block=block).orderBy("ordinal").collect()
        assert [(r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in rows] == [(0, 0, 0, True), (1, 1, 2, True), (2, 4, 0, True), (3, 5, 3, False)]
    with pytest.raises(ValueError):
        token_counts.write_token_files(awkward(spark), PATH, 70_000, "file:///none")


def test_coding():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        raw = token_binary.pack(x)
        assert (token_binary.unpack(raw, n) == x).all() and len(raw) <= -(-n // 4) + 4 * n
    assert len(token_binary.pack(np.zeros(8, np.uint32))) == 2 + 8


def test_op9(spark, library):
    docs = awkward(spark, extra=True).repartition(3)
    folder = common.new_path(spark, "binary-test")
    files = token_binary.write(docs, folder, PATH)
    got = token_binary.read_files(files, folder, digest="crc32").orderBy("start").collect()
    want, at = [], 0
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for r in rows:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    raw = token_binary.read_files(files, folder).where("doc_id = 9").first()
    assert library.decode(np.frombuffer(raw["ids"], "<u4")[:-1].tolist(), skip_special_tokens=False) == "<|endoftext|> é日本 😀 it's 1234!!"
    assert token_binary.read_files(token_binary.write(empty(spark), common.new_path(spark, "none"), PATH), folder).count() == 0


def test_files_of_many_blocks_are_streams(spark, library):
    texts = ["w x y z " * (i % 7) * (50_000 if i == 20 else 1) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    folder = common.new_path(spark, "one")
    got = token_binary.read_files(token_binary.write(docs, folder, PATH), folder, "crc32").orderBy("doc_id").collect()
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    starts = np.cumsum([0, *map(len, want)])
    assert [tuple(r) for r in got] == [(i, starts[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)]
    assert starts[-1] > 17 * token_binary.BLOCK


def test_types_of_ids(spark, monkeypatch):
    assert tokens.token_type(PATH) == "<u2"
    monkeypatch.setattr(token_counts, "token_type", lambda path: "<u4")
    with pytest.raises(ValueError):
        token_counts.write_token_files(awkward(spark), PATH, 50256, "file:///none", "<u2")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in token_counts.count(docs, PATH).collect()} == {(1, len(Tokenizer.from_file(PATH).encode("some words", add_special_tokens=False).ids)), (2, 0)}


def test_units_are_bounded_by_their_characters(library):
    table = tokens.UnitTable(tokens.LibraryEncoder(PATH), max_chars=300)
    for k in range(40):
        text = " ".join(f"unit{k}x{j}" for j in range(20))
        assert table.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert table.chars < 600


def test_wide_ids(spark):
    rows = spark.createDataFrame([(0, 0, 1, bytearray(b"\1" + np.array([5, 70_000], "<u4").tobytes())), (0, 2, 2, bytearray(np.array([5], "<u2").tobytes()))], "part int, at long, doc_id long, ids binary")
    ranked = token_binary.ranking(rows, 10)
    assert ranked.tolist() == [5, 70_000]
    folder = common.new_path(spark, "wide")
    got = token_binary.read_files(token_binary.write_files(rows, ranked, folder), folder).orderBy("doc_id").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[5, 70_000], [5]]


def test_queries_agree_on_the_number_of_tokens(spark):
    one = {r["doc_id"]: r["n_tokens"] for r in token_counts.op1(spark, SMALL).collect()}
    two = {r["doc_id"]: r["n_tokens"] for r in bpe.op2(spark, SMALL).collect()}
    nine = token_binary.op9(spark, SMALL).orderBy("doc_id").collect()
    assert one == two == {r["doc_id"]: r["n_tokens"] - 1 for r in nine}
    assert [r["start"] for r in nine] == np.cumsum([0] + [r["n_tokens"] for r in nine])[:-1].tolist()


def test_ids_without_a_rank_are_refused(spark, tmp_path):
    rows = token_binary.encoded(spark.createDataFrame([(1, "the old man")], "doc_id long, text string"), PATH, 2)
    ranked = token_binary.ranking(rows, 50_258)
    assert len(ranked) == 4
    with pytest.raises(Exception, match="has no rank"):
        token_binary.write_files(rows, ranked[:-1], f"file://{tmp_path}/a").count()
    with pytest.raises(Exception, match="has no rank"):
        token_binary.write_files(rows, np.array([2], np.uint32), f"file://{tmp_path}/b").count()
    with pytest.raises(ValueError, match="more than the 3 ids"):
        token_binary.ranking(rows, 3)


def test_packed_bytes_of_every_length():
    x = np.array([1, 0x102, 0x10203, 0x1020304, 255, 256], np.uint32)
    raw = token_binary.pack(x)
    assert raw == bytes([0b11100100, 0b0100, 1, 2, 1, 3, 2, 1, 4, 3, 2, 1, 255, 0, 1])
    assert (token_binary.unpack(raw, 6) == x).all() and len(token_binary.unpack(token_binary.pack(x[:0]), 0)) == 0
