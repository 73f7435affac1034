"""Operator 2: BPE encoding and decoding by batched numpy merge rounds.

Symbols of many words lie in one flat array. A round finds each word's lowest-rank pair by binary search over sorted pair
keys, merges its occurrences in all words at once and drops the words that are done. Null texts count as empty, empty texts
have no ids, long ones are encoded whole; equal rows give equal results, extra columns are kept as they are (the result's
names win over columns of the same name), an empty table gives an empty one.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import UnitTable, _tables, tokenizer_path

NONE = np.iinfo(np.int32).max
# The words that the byte-level pattern takes, in its order.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class MergeEncoder:
    """Encodes lists of texts with the merges of a byte-level tokenizer file; decodes ids by table lookup."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.made = made  # by rank
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same token; rounds need them to be distinct")
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte_of = {c: b for b, c in enumerate(chars)}
        spelled = [b""] * self.n
        for token, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.out_len = np.array([len(x) for x in spelled], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(spelled), np.uint8)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        done_word, done_sym = [], []
        rank = np.full(len(sym), NONE, np.int32)  # of the pair that begins at a symbol
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lengths = np.diff(starts, append=len(sym))
            best = np.minimum.reduceat(rank, starts)
            best_here = np.repeat(best, lengths)
            active = best_here < NONE
            if not active.all():
                done_word.append(word[~active])
                done_sym.append(sym[~active])
                word, sym, rank, best_here = word[active], sym[active], rank[active], best_here[active]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best_here)
            run = np.diff(hit, prepend=-2) != 1  # of a pair of two like symbols, every second one in a run is taken
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            word, sym, rank = word[keep], sym[keep], rank[keep]
            near = np.zeros(len(sym), bool)
            near[at] = near[np.maximum(at - 1, 0)] = True
            again = np.flatnonzero(near)
            inside = again[again < len(sym) - 1]
            rank[again] = NONE
            inside = inside[word[inside] == word[inside + 1]]
            rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        if not done_word:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        return sym[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        of, per_text = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            n = len(of)
            for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]:
                if part in self.special:
                    of.append(-1 - self.special[part])
                else:
                    of.extend(number.setdefault(w.encode(), len(number)) for w in self.words.findall(part))
            per_text[i] = len(of) - n
        of = np.array(of, np.int64)
        flat, lens = self.merge(list(number))
        flat = np.concatenate([flat, np.arange(self.n, dtype=np.uint32)])  # special tokens stand for themselves
        starts = np.concatenate([np.cumsum(lens) - lens, len(flat) - self.n + np.arange(self.n)])
        lens = np.concatenate([lens, np.ones(self.n, np.int64)])
        of = np.where(of < 0, len(number) - 1 - of, of)
        each = lens[of]
        ends = np.cumsum(each)
        ids = flat[np.arange(each.sum()) + np.repeat(starts[of] - (ends - each), each)]
        sums = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(sums)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[ids < self.n]
        lens = self.out_len[ids]
        ends = np.cumsum(lens)
        return self.out[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.out_at[ids] - (ends - lens), lens)].tobytes()


@cache
def encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def _table(path: str) -> UnitTable:
    if ("merge", path) not in _tables:
        _tables["merge", path] = UnitTable(encoder(path))
    return _tables["merge", path]


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [f for f in df.schema.fields if f.name != name]
    return [f.name for f in kept], T.StructType([*kept, T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", chars: int = 2_000_000) -> DataFrame:
    """Adds ids: binary, little-endian unsigned 32-bit integers. chars bounds the text that a task encodes at once."""
    others, schema = _with(df, ids, T.BinaryType())

    def run(batches):
        table = _table(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in common.slices([len(x) for x in texts], chars):
                flat, per = table.encode(texts[a:b])
                ends = np.cumsum(per)
                raw = flat.astype("<u4")
                column = pa.array([raw[e - n : e].tobytes() for e, n in zip(ends, per)], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), column], [*others, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", size: int = 4_000_000) -> DataFrame:
    """Adds text from ids (null: empty), special tokens included; bytes that are no UTF-8 become replacement characters."""
    others, schema = _with(df, text, T.StringType())

    def run(batches):
        table = encoder(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            for a, b in common.slices([len(x or b"") for x in rows], size):
                out = [table.decode(np.frombuffer(x or b"", "<u4")).decode(errors="replace") for x in rows[a:b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(out, pa.string())], [*others, text])

    return df.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(common.documents(spark, sf_dir), path or tokenizer_path())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    common.small_batches(docs.sparkSession)
    out = decode(encode(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
