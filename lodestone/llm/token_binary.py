"""Operator 9: token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in frequency over the whole corpus, so that frequent ones take one byte. Four ids share a
control byte (two bits each: their bytes less one), control bytes and data bytes lie apart, and numpy decodes them by a table
of the 256 control bytes. Documents lie in ascending doc_id order. A file is a row of blocks and, at its end, its documents' ids
and lengths and the number of ids before it in the whole corpus, so it is written and read as a stream: no task holds more than
some blocks, whatever the size of files.

Null texts count as empty and have the end id alone; null doc_ids come first; rows that share a doc_id lie side by side, in the
order of a hash of their texts; long texts are encoded whole and may span blocks; an empty table gives no files and no rows;
other columns, of whatever name, are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import open_store
from .tokens import library_table, tokenizer_path

MAGIC, BLOCK, FILE, FILES_A_TASK = b"LSVB0002", 1 << 16, 1 << 26, 8
MORE = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8)  # bytes of each id after its first


def pack(ranks: np.ndarray) -> bytes:
    """Control bytes, then data bytes, of unsigned 32-bit numbers."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    more = code[: len(r)]
    for least in (0xFF, 0xFFFF, 0xFFFFFF):
        more += r > least
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    at = np.cumsum(more, dtype=np.int64) - more + np.arange(len(r))
    data = np.empty(len(r) + int(more.sum(dtype=np.int64)), np.uint8)
    data[at] = r.astype(np.uint8)
    for k in (1, 2, 3):
        longer = np.flatnonzero(more >= k)
        data[at[longer] + k] = (r[longer] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes() + data.tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    control = np.frombuffer(raw, np.uint8, -(-n // 4))
    more = MORE[control].reshape(-1)[:n]
    at = np.cumsum(more, dtype=np.int64) - more + np.arange(n)
    data = np.frombuffer(raw, np.uint8, n + int(more.sum(dtype=np.int64)), len(control))
    out = data[at].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(more >= k)
        out[longer] |= data[at[longer] + k].astype("<u4") << np.uint32(8 * k)
    return out


def encoded(docs: DataFrame, path: str, end: int, chars: int = 2_000_000) -> DataFrame:
    """part, at (ids of the part before), doc_id, ids (16 or 32 bits each), in ascending doc_id order within and across parts."""

    def run(batches):
        table, at = library_table(path), 0
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in common.slices([len(x) for x in texts], chars):
                flat, per = table.encode(texts[a:b])
                raw = np.insert(flat, np.cumsum(per), end).astype("<u4")
                ends = np.cumsum(per + 1)
                ids = pa.array([raw[e - n : e].astype("<u2").tobytes() if not n or raw[e - n : e].max() <= 0xFFFF else b"\1" + raw[e - n : e].tobytes() for e, n in zip(ends, per + 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at + ends - per - 1), batch.column(0).slice(a, b - a), ids], ["at", "doc_id", "ids"])
                at += int(ends[-1])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return common.materialize(dealt.mapInArrow(run, "at long, doc_id long, ids binary").withColumn("part", F.spark_partition_id()), "encoded")


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return len({*t.get_vocab().values(), *t.get_added_tokens_decoder()})


def ranking(rows: DataFrame, vocabulary: int) -> np.ndarray:
    """Ids by falling frequency, ties by id. There are no more than the vocabulary has, which bounds what the driver gets; more are
    refused."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids = np.concatenate([_ids(raw) for raw in batch.column(0).to_pylist()] or [np.zeros(0, "<u2")])
            n = np.bincount(ids, minlength=len(total))
            n[: len(total)] += total
            total = n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], ["id", "n"])

    counts = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "id").limit(vocabulary + 1).collect()
    if len(top) > vocabulary:
        raise ValueError(f"more than the {vocabulary} ids of the vocabulary are in use")
    return np.array([r["id"] for r in top], np.uint32)


def write_files(rows: DataFrame, ranked: np.ndarray, folder: str) -> DataFrame:
    """A file for each run of documents that one task meets. Rows: file, n_docs. folder/ranks holds the ids by rank."""
    spark = rows.sparkSession
    store, inside = open_store(folder)
    store.create_dir(inside, recursive=True)
    with store.open_output_stream(f"{inside}/ranks") as f:
        f.write(ranked.astype("<u4").tobytes())
    sums = rows.groupBy("part").agg(F.max(F.col("at") + F.when(F.length("ids") % 2 == 1, (F.length("ids") - 1) / 4).otherwise(F.length("ids") / 2)).cast("long").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each part

    def run(batches):
        store, inside = open_store(folder)
        ranks = np.frombuffer(store.open_input_stream(f"{inside}/ranks").read(), "<u4")
        rank_of = np.full(int(ranks.max(initial=0)) + 1, -1, np.int64)
        rank_of[ranks] = np.arange(len(ranks))

        def ranks_of(ids):
            found = rank_of[ids] if ids.max(initial=0) < len(rank_of) else np.full(1, -1)
            if found.min(initial=0) < 0:
                raise ValueError("an id has no rank")
            return found

        class Writer:
            """Documents whose ids follow one another, as one file."""

            def __init__(self, start):
                self.start, self.name = start, f"{start:020d}-{uuid.uuid4().hex}.lsvb"
                self.docs, self.lens, self.held, self.n, self.size = [], [], [], 0, 0
                self.file = store.open_output_stream(f"{inside}/{self.name}")
                self.file.write(MAGIC)

            def add(self, doc, ids):
                self.docs.append(doc)
                self.lens.append(len(ids))
                self.held.append(ids)
                self.n += len(ids)
                self.size += len(ids)
                if self.n >= 16 * BLOCK:
                    self.flush(BLOCK)

            def flush(self, least):
                """Writes whole blocks, and with least 1 the rest too."""
                flat = np.concatenate(self.held)
                while len(flat) >= least:
                    raw = pack(ranks_of(flat[:BLOCK]))
                    self.file.write(np.array([len(raw)], "<i8").tobytes() + raw)
                    flat = flat[BLOCK:]
                self.held, self.n = [flat], len(flat)

            def close(self):
                self.flush(1)
                known = np.array([d is not None for d in self.docs], np.uint8)
                tail = known.tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lens, "<i8").tobytes()
                self.file.write(tail + np.array([len(self.docs), self.start], "<i8").tobytes())
                self.file.close()
                return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([len(self.docs)], pa.int64())], ["file", "n_docs"])

        now = None
        for batch in batches:
            for start, doc, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if now and (start != now.start + now.size or now.size > FILE):
                    yield now.close()
                    now = None
                now = now or Writer(start)
                now.add(doc, _ids(raw))
        if now:
            yield now.close()

    placed = rows.join(F.broadcast(bases), "part").select((F.col("at") + F.col("base")).alias("start"), "doc_id", "ids")
    return common.materialize(placed.mapInArrow(run, "file string, n_docs long"), "token-binaries")


def read_files(files: DataFrame, folder: str, digest=None) -> DataFrame:
    """Rows: doc_id, start, n_tokens and, as digest is None, ids (unsigned 32-bit, binary), or ids_crc32."""

    def run(batches):
        store, inside = open_store(folder)
        ranks = np.frombuffer(store.open_input_stream(f"{inside}/ranks").read(), "<u4")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{inside}/{name}") as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{name} is no token file")
                    n, start = (int(x) for x in np.frombuffer(f.read_at(16, f.size() - 16), "<i8"))
                    tail = f.read_at(17 * n, f.size() - 16 - 17 * n)
                    known, docs, lens = np.frombuffer(tail, np.uint8, n), np.frombuffer(tail, "<i8", n, n), np.frombuffer(tail, "<i8", n, 9 * n)
                    f.seek(len(MAGIC))
                    ends, left, held, done, before = np.cumsum(lens), int(lens.sum()), [], 0, 0
                    while done < n:
                        size = 0  # of what is read of documents from done on
                        while left and size < 16 * BLOCK + int(lens[done]):
                            raw = f.read(int(np.frombuffer(f.read(8), "<i8")[0]))
                            held.append(ranks[unpack(raw, min(BLOCK, left))])
                            left -= len(held[-1])
                            size = sum(map(len, held))
                        flat = np.concatenate(held) if held else np.zeros(0, "<u4")
                        to = int(np.searchsorted(ends, before + len(flat), side="right"))
                        parts = [flat[e - k - before : e - before].astype("<u4").tobytes() for e, k in zip(ends[done:to], lens[done:to])]
                        out = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array(parts, pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(docs[done:to], mask=known[done:to] == 0), pa.array(start + ends[done:to] - lens[done:to]), pa.array(lens[done:to]), out], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                        held, done = [flat[ends[to - 1] - before :]], to
                        before = int(ends[to - 1])

    last = "ids_crc32 long" if digest else "ids binary"
    return common.packed(files.select("file"), files.count(), FILES_A_TASK).mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def write(docs: DataFrame, folder: str, path: str, end: int = 2) -> DataFrame:
    """docs: doc_id, text. Writes folder; rows: file, n_docs."""
    common.small_batches(docs.sparkSession)
    rows = encoded(docs, path, end)
    files = write_files(rows, ranking(rows, vocabulary_size(path) + 1), folder)  # the end id may be one of its own
    common.drop(rows)
    return files


def op9(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = common.new_path(spark, "token-binary")
    return read_files(write(common.documents(spark, sf_dir), folder, path or tokenizer_path()), folder, digest="crc32")
