"""Operator 13: alignment of two tokenizers by galloping intersection of token ends.

A byte-level BPE (A) encodes a space and the text, a piece model (B) the text, to which it adds the space itself; where both give
back the bytes of space and text, their tokens are two ways of cutting the same bytes. The shorter list of end offsets drives: each
of its ends is looked for in the longer list by steps that double, from the place its rank suggests, and then by halving. Ends that
are in both cut the tokens into groups; the ranks found for two ends that follow one another give the range of tokens that overlap
the token between them, so links (overlapping pairs of tokens) are counted off, never searched.

How often an id pair is linked in the corpus comes back to the documents without a row for each link: a task adds up its pairs
before they are shuffled, and gets the corpus's counts of just the pairs that it has, as a table of its own in the shared folder
(at most the distinct pairs of one task, whatever the corpus). Ids are written between the two passes, links are not.

Null and empty texts, and texts that one of the tokenizers does not give back whole (U+2581 in a text, which pieces read as a
space), have no tokens: zeros and ''. Strings of special tokens are plain text. Texts of any length are encoded whole; repeated
rows count each for itself; null doc_ids stay; an empty table gives no rows; the columns named in keep pass through align_documents() and
must not bear the result's names; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import LibraryEncoder, UnitTable, tokenizer_path
from .token_counts import open_store

PIECES = "piece_bpe_32k.model"
MARK, OTHER, ODD = "▁", np.uint32(1 << 31), np.uint32((1 << 32) - 1)
MAX_UNITS, MAX_CHARS = 250_000, 5_000_000
PAIRS = 1_000_000  # distinct pairs that a task holds before it hands them on


class Pieces:
    """The piece model: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        if any(MARK in x.lstrip(MARK) for x in names):
            raise ValueError(f"{path}: pieces go on beyond a space, so texts can not be cut before spaces")
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(MARK, " ").encode() for i, x in zip(ids, names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class ByteLevel(LibraryEncoder):
    """The byte-level BPE, which takes strings of special tokens as text, and the bytes of each id."""

    def __init__(self, path: str):
        super().__init__(path, as_text=True)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        special = set(self.tokenizer.get_added_tokens_decoder())
        self.own = [x.encode() if i in special else bytes(byte[c] for c in x) for i, x in enumerate(names)]


class Both:
    """Encodes units (a space and what follows it) by A and B. Ids of B carry the highest bit; a unit whose bytes one of them does
    not give back has ODD before its ids."""

    #: Texts in which a space is not followed by a word, after a space's own bytes: cut before spaces, B or A would differ.
    WHOLE = re.compile(r"  |\s (?:\s|\Z)| \Z")

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.names = (self.a.own, self.b.bytes)
        self.lens = tuple(np.array([len(x) for x in names], np.int64) for names in self.names)

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        a, n_a = self.a(units)
        b = self.b.encode([u[1:] for u in units])
        ends = np.cumsum(n_a)
        out = []
        for unit, end, n, other in zip(units, ends.tolist(), n_a.tolist(), b):
            mine = a[end - n : end].tolist()
            raw = unit.encode()
            whole = b"".join(map(self.a.own.__getitem__, mine)) == raw and b"".join(map(self.b.bytes.__getitem__, other)) == raw
            out.append([*([] if whole else [int(ODD)]), *mine, *(i | 1 << 31 for i in other)])
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, n.sum()), n


_tables: dict = {}


def table(a_path: str, b_path: str) -> UnitTable:
    """The worker's own; workers are used again for later tasks."""
    if (a_path, b_path) not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tables[a_path, b_path] = UnitTable(Both(a_path, b_path), MAX_UNITS, MAX_CHARS, Both.WHOLE)
    return _tables[a_path, b_path]


def encode(texts: list[str | None], units: UnitTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of A, of each text; ids of B, of each text). Texts without tokens have none in both."""
    flat, per = units.encode([f" {x}" if x else "" for x in texts])
    of = np.repeat(np.arange(len(texts)), per)
    odd = np.zeros(len(texts), bool)
    for i in np.unique(of[flat == ODD]):
        ids = flat[of == i]
        ids = ids[ids != ODD]
        raw = f" {texts[i]}".encode()
        got = [b"".join(names[k] for k in part.tolist()) for names, part in zip(units.encoder.names, (ids[ids < OTHER], ids[ids >= OTHER] & (OTHER - np.uint32(1))))]
        odd[i] = got != [raw, raw]  # parts may make up for one another
    use = (flat != ODD) & ~odd[of]
    b = flat >= OTHER
    a_, b_ = use & ~b, use & b
    count = lambda x: np.bincount(of[x], minlength=len(texts))
    return flat[a_], count(a_), flat[b_] & (OTHER - np.uint32(1)), count(b_)


def gallop(want: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each number of want the first place in ends[low : high], which is sorted, whose number is not smaller; there is one.
    From guess on, steps double until the place is passed, then the stretch is halved."""
    at = np.arange(len(want))
    up = ends[guess] < want
    left, right = np.where(up, guess, low - 1), np.where(up, high - 1, guess)  # ends[left] < want <= ends[right]
    step, live = 1, at
    while len(live):
        rising = up[live]
        probe = np.where(rising, left[live] + step, right[live] - step)
        live, rising, probe = (x[(probe > left[live]) & (probe < right[live])] for x in (live, rising, probe))
        less = ends[probe] < want[live]
        left[live[less]], right[live[~less]] = probe[less], probe[~less]
        live = live[less == rising]
        step *= 2
    live = at[right - left > 1]
    while len(live):
        middle = (left[live] + right[live]) // 2
        less = ends[middle] < want[live]
        left[live[less]], right[live[~less]] = middle[less], middle[~less]
        live = live[right[live] - left[live] > 1]
    return right


def align(short: np.ndarray, n_short: np.ndarray, long: np.ndarray, n_long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """short, long: lengths in bytes of the tokens of some texts, n_: of each text, at most n_long in each. (common, i, j): whether
    a token of short ends where one of long does; the links, as places in short and long."""
    ends, other = np.cumsum(short), np.cumsum(long)  # over all texts, which have the same bytes in both
    low = np.repeat(np.cumsum(n_long) - n_long, n_short)
    high = low + np.repeat(n_long, n_short)
    rank = np.arange(len(short)) - np.repeat(np.cumsum(n_short) - n_short, n_short)
    place = gallop(ends, other, low, high, low + rank * (high - low) // np.repeat(n_short, n_short))
    common_ = other[place] == ends
    first = np.concatenate([[0], place[:-1] + common_[:-1]]) if len(place) else place
    many = place - first + 1
    i = np.repeat(np.arange(len(short)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return common_, i, j


def linked(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, lens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of some texts. (last, i, j, text): whether a token of A ends a group; links as places in a and b; the text of each link."""
    last = np.zeros(len(a), bool)
    of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    i, j = [], []
    for a_drives, texts in ((True, n_a <= n_b), (False, n_a > n_b)):  # the shorter list drives
        x, y = np.flatnonzero(texts[of_a]), np.flatnonzero(texts[of_b])
        size_a, size_b = lens[0][a[x]], lens[1][b[y]]
        if a_drives:
            last[x], k, m = align(size_a, n_a[texts], size_b, n_b[texts])
        else:
            ended, m, k = align(size_b, n_b[texts], size_a, n_a[texts])
            last[x[k[np.searchsorted(m, np.flatnonzero(ended), side="right") - 1]]] = True  # the last link of a token that ends a group
        i.append(x[k])
        j.append(y[m])
    i, j = np.concatenate(i), np.concatenate(j)
    return last, i, j, of_a[i]


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number under n its decimal digits and a comma, a row of bytes, and how many of them there are."""
    text = np.array([f"{i},".encode() for i in range(n)])
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(text).astype(np.int64)


def groups_digests(a, n_a, b, n_b, last, i, j, known) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2` of each text; '' where there are no tokens."""
    group_a = np.cumsum(last) - last
    group_b = np.empty(len(b), np.int64)
    group_b[j] = group_a[i]
    many = int(last.sum())
    each_a, each_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
    start = np.cumsum(each_a + each_b) - each_a - each_b
    at_a = np.arange(len(a)) - np.repeat(np.cumsum(each_a) - each_a, each_a) + np.repeat(start, each_a)
    at_b = np.arange(len(b)) - np.repeat(np.cumsum(each_b) - each_b, each_b) + np.repeat(start + each_a, each_b)
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    sign[start + each_a - 1], sign[start + each_a + each_b - 1] = ord("|"), ord(";")
    rows, size = known
    size = size[ids]
    ends = np.cumsum(size)
    flat = rows[ids][np.arange(rows.shape[1]) < size[:, None]]
    flat[ends - 1] = sign
    raw = flat.tobytes()
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class Tally:
    """Distinct pairs and how often they came, in sorted arrays; added up whenever PAIRS more have come."""

    def __init__(self):
        self.keys, self.n, self.held, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, pairs: np.ndarray) -> None:
        self.held.append(np.unique(pairs, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > PAIRS:
            self.settle()

    def settle(self) -> None:
        keys, place = np.unique(np.concatenate([self.keys, *(k for k, _ in self.held)]), return_inverse=True)
        self.n = np.bincount(place, np.concatenate([self.n, *(n for _, n in self.held)]), len(keys)).astype(np.int64)
        self.keys, self.held, self.size = keys, [], 0

    def take(self) -> pa.Table:
        self.settle()
        out = pa.table([self.keys, self.n], names=["pair", "n"])
        self.keys, self.n = self.keys[:0], self.n[:0]
        return out


OWN = T.StructType().add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long").add("groups_sha256", "string")
IDS = T.StructType().add("_a", "binary").add("_b", "binary").add("_pair", "long").add("_n", "long")
SUMS = T.StructType().add("n_best", "long").add("count_sum", "long")


def _slices(flat: np.ndarray, per: np.ndarray) -> pa.Array:
    ends = np.cumsum(per)
    return pa.array([flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), per.tolist())], pa.binary())


def aligned(docs: DataFrame, keep: list[str], a_path: str, b_path: str, chars: int = 1_000_000) -> DataFrame:
    """docs: keep, text. Rows of two kinds: keep, counts and ids of a document; a pair (_pair) and how often it is linked (_n) in a
    task's documents, perhaps in several rows."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *OWN.fields, *IDS.fields])

    def run(batches):
        units, tally = table(a_path, b_path), Tally()
        lens = units.encoder.lens
        kinds = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in lens]
        known = digits(max(map(len, lens)))

        def pairs():
            found = tally.take()
            n = len(found)
            return pa.RecordBatch.from_arrays([*(pa.nulls(n, batch.column(c).type) for c in keep), *(pa.nulls(n, t) for t in 4 * [pa.int64()] + [pa.string()] + 2 * [pa.binary()]), *(found.column(c).combine_chunks() for c in ("pair", "n"))], schema.names)

        batch = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for x, y in common.slices([len(t or "") for t in texts], chars):
                a, n_a, b, n_b = encode(texts[x:y], units)
                last, i, j, text = linked(a, n_a, b, n_b, lens)
                tally.add(a[i].astype(np.int64) * len(lens[1]) + b[j])
                many = lambda of: pa.array(np.bincount(of, minlength=y - x))  # noqa: B023, E731
                digest = pa.array(groups_digests(a, n_a, b, n_b, last, i, j, known), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(x, y - x) for c in keep), pa.array(n_a), pa.array(n_b), many(np.repeat(np.arange(y - x), n_a)[last]), many(text), digest,
                     _slices(a.astype(kinds[0]), n_a), _slices(b.astype(kinds[1]), n_b), pa.nulls(y - x, pa.int64()), pa.nulls(y - x, pa.int64())],
                    schema.names,
                )
                if len(tally.keys) > PAIRS:
                    yield pairs()
        if batch is not None:
            yield pairs()

    rows = docs.select(*keep, "text").mapInArrow(run, schema).withColumn("_part", F.spark_partition_id())
    return common.materialize(rows, "aligned")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """rows: what aligned() gives. Rows: pair, n (links in the corpus), best (no pair of this id of B has more). n_b: ids of B."""
    counts = rows.where("_pair is not null").groupBy(F.col("_pair").alias("pair")).agg(F.sum("_n").alias("n"))
    counts = common.materialize(counts.withColumn("b", F.col("pair") % n_b), "pair-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, keep: list[str], counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The documents of rows with the sums of their links' counts. Each part's pairs lie in a folder of their own, from which the
    tasks that meet the part take them."""
    folder = common.new_path(rows.sparkSession, "part-pairs")
    asked = rows.where("_pair is not null").select("_part", F.col("_pair").alias("pair"))
    asked.join(counts, "pair").repartition("_part").sortWithinPartitions("_part", "pair").write.partitionBy("_part").parquet(folder)
    fields = [rows.schema[c] for c in keep]

    def run(batches):
        from pyarrow import parquet

        lens = table(a_path, b_path).encoder.lens
        kinds = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in lens]
        store, inside = open_store(folder)
        at, pair, n, best = None, None, None, None
        for batch in batches:
            part = batch.column("_part").to_numpy()
            sizes = [x.as_py() + y.as_py() for x, y in zip(*(pc.binary_length(batch.column(c)) for c in ("_a", "_b")))]
            cuts = sorted({0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), *(x for x, _ in common.slices(sizes, 2_000_000)), len(part)})
            for x, y in zip(cuts[:-1], cuts[1:]):
                some = batch.slice(x, y - x)
                raw = [some.column(c).to_pylist() for c in ("_a", "_b")]
                (a, n_a), (b, n_b) = ((np.frombuffer(b"".join(v), k), np.array([len(q) // np.dtype(k).itemsize for q in v])) for v, k in zip(raw, kinds))
                if part[x] != at and len(a):
                    found = parquet.read_table(f"{inside}/_part={part[x]}", filesystem=store, columns=["pair", "n", "best"], partitioning=None)
                    pair, place = np.unique(found.column("pair").to_numpy(), return_index=True)
                    n, best, at = found.column("n").to_numpy()[place], found.column("best").to_numpy()[place], part[x]
                sums = [np.zeros(y - x, np.int64)] * 2
                if len(a):
                    _, i, j, text = linked(a, n_a, b, n_b, lens)
                    mine = np.searchsorted(pair, a[i].astype(np.int64) * len(lens[1]) + b[j])
                    ends = np.cumsum(np.bincount(text, minlength=y - x))  # links need not lie text by text
                    order = np.argsort(text, kind="stable")
                    total = np.concatenate([[0], np.cumsum(n[mine[order]])])
                    sums = [np.bincount(text[best[mine]], minlength=y - x), np.diff(total[np.concatenate([[0], ends])])]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in [*keep, *OWN.names]), *map(pa.array, sums)], [*keep, *OWN.names, *SUMS.names])

    return rows.where("_pair is null").select(*keep, *OWN.names, "_a", "_b", "_part").mapInArrow(run, T.StructType([*fields, *OWN.fields, *SUMS.fields]))


def align_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """docs: keep, text. (documents: keep, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; id pairs: a, b, n, best)."""
    a_path, b_path = a_path or tokenizer_path(), b_path or tokenizer_path(PIECES)
    n_b = len(Pieces(b_path).bytes)
    rows = aligned(docs, list(keep), a_path, b_path)
    counts = common.materialize(pair_counts(rows, n_b), "pairs")
    pairs = counts.select(F.floor(F.col("pair") / n_b).cast("int").alias("a"), (F.col("pair") % n_b).cast("int").alias("b"), "n", "best")
    return with_counts(rows, list(keep), counts, a_path, b_path), pairs


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(common.documents(spark, sf_dir))[0]
