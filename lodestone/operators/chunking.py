"""Chunks of texts.

A text is a row of units: a word or a sign, with the white space behind it; a unit counts as a token. A chunk takes units up to
size, and ends, if the text goes on, behind the strongest kind of boundary in the last SNAP of it: an empty line, a line's end,
a sentence's end, a blank, else anywhere; of equal ones the last. The next chunk starts overlap units before that end. So chunks
cover every unit, none lies inside another, and joined without their overlaps they are the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r" \t\n\r\f\x0B"
UNIT = rf"[\p{{L}}\p{{N}}_]+[{SPACE}]*|[^\p{{L}}\p{{N}}_{SPACE}][{SPACE}]*|[{SPACE}]+"
SNAP = 0.3
#: Kinds of boundaries, the strongest first: what the unit before one matches.
BOUNDARIES = (r"\n[ \t\r]*\n", r"\n", rf"^[.!?][{SPACE}]", rf"[{SPACE}]$")
BLANKS, BLANK_LINE = tuple(" \t\n\r\f\x0b"), re.compile(BOUNDARIES[0])
LINES, LINE, SENTENCE, GAP = re.compile(r"\n[ \t\r]*\n"), re.compile(r"\n"), re.compile(rf"[.!?](?=[{SPACE}])"), re.compile(rf"[{SPACE}]+")


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def token_length(text: Column) -> Column:
    return F.size(units(text)).cast("long")


def strength(unit: str) -> int:
    """The kind of boundary behind a unit: one of BOUNDARIES, the strongest the highest, or 0. Patterns told in plain signs."""
    if "\n" in unit:
        return 4 if BLANK_LINE.search(unit) else 3
    if len(unit) > 1 and unit[0] in ".!?" and unit[1] in BLANKS:
        return 2
    return 1 if unit[-1:] in BLANKS else 0


def spans(text: str, ends: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of the chunks of a text whose units end at ends. Only units in the last SNAP of a chunk are looked at."""
    least, n, start, out = max(1, int(size * (1 - SNAP))), len(ends), 0, []
    at = [0, *ends.tolist()]
    while start < n:
        stop = n
        if start + size < n:
            best = -1
            for e in range(start + size, start + least - 1, -1):
                kind = strength(text[at[e - 1] : at[e]])
                if kind > best:
                    best, stop = kind, e
                    if kind == len(BOUNDARIES):
                        break
        out.append((start, stop))
        start = n if stop >= n else max(stop - overlap, start + 1)
    return out


def pieces(rows: DataFrame, others: list[str], cut: Callable[[], Callable[[list, list], list[list[str]]]]) -> DataFrame:
    """rows: others and some columns for cut, of which the last is the text. others with chunk_no and chunk: cut() is called once in
    each task and gives the chunks of each text of a batch."""
    fields = [rows.schema[c] for c in others]
    schema = T.StructType([*fields, T.StructField("chunk_no", T.LongType()), T.StructField("chunk", T.StringType())])

    def run(batches):
        cutter = cut()
        for batch in batches:
            found = cutter(*(batch.column(i) for i in range(len(others), batch.num_columns)))
            for a in range(0, len(found), 200):
                some = found[a : a + 200]
                which = pa.array(np.repeat(np.arange(a, a + len(some)), [len(x) for x in some]))
                numbers = pa.array([i for x in some for i in range(len(x))], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(which) for i in range(len(others))), numbers, pa.array([c for x in some for c in x], pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def chunk(docs: DataFrame, size: int = 1024, overlap: int = 150, text: str = "text", blanks: bool = False) -> DataFrame:
    """docs without text, with chunk_no and chunk: a row for each chunk; texts that are null or blank have none. Overlaps of more
    than half of size count as half. blanks: a blank text has a row too, chunk_no 0 with a chunk that is null."""
    if size <= 0 or overlap < 0:
        raise ValueError("size is positive, overlap not negative")
    overlap = min(overlap, size // 2)
    others = [c for c in docs.columns if c not in (text, "chunk_no", "chunk")]
    lengths = F.transform(units(F.col(text)), F.length)
    rows = docs.where(F.col(text).isNotNull() if blanks else F.col(text).rlike(rf"[^{SPACE}]")).select(*others, lengths.alias("_lengths"), F.col(text).alias("_text"))

    def cut():
        def of(lengths, texts):
            found = []
            for n, t in zip(lengths, texts):
                t, ends = t.as_py(), np.cumsum(n.values.to_numpy())
                if blanks and not t.strip("".join(BLANKS)):
                    found.append([None])
                    continue
                at = [0, *ends.tolist()]
                found.append([t[at[a] : at[b]] for a, b in spans(t, ends, size, overlap)])
            return found

        return of

    return pieces(rows, others, cut)


def boundaries(text: str) -> list[np.ndarray]:
    """Places in a text before which a chunk may end, the strongest kind first: behind empty lines, behind lines, behind the sign that
    ends a sentence, and before blanks."""
    kinds = [[m.end() for m in LINES.finditer(text)], [m.end() for m in LINE.finditer(text)], [m.end() for m in SENTENCE.finditer(text)], [m.start() for m in GAP.finditer(text)]]
    return [np.array(x, np.int64) for x in kinds]


def token_spans(ends: np.ndarray, places: list[np.ndarray], size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) in tokens, which end at ends: a chunk ends behind the last place of the strongest kind in its last SNAP at which
    a token ends, else anywhere. The next one starts overlap tokens before."""
    least, n, start, out = max(1, int(size * (1 - SNAP))), len(ends), 0, []
    places = [p[np.isin(p, ends)] for p in places]
    while start < n:
        stop = n
        if start + size < n:
            stop, low, high = start + size, ends[start + least - 1], ends[start + size - 1]
            for p in places:
                i = int(np.searchsorted(p, high, side="right")) - 1
                if i >= 0 and p[i] >= low:
                    stop = min(start + size, int(np.searchsorted(ends, p[i], side="right")))
                    break
        out.append((start, stop))
        start = n if stop >= n else max(stop - overlap, start + 1)
    return out


class TokenEnds:
    """Where the tokens of texts end, in signs. A byte-level pattern never joins what stands on both sides of a blank between other
    signs than white space, so with such a tokenizer a text is cut before its blanks, and each new piece is encoded once."""

    #: Texts in which a blank stands after white space and before white space or the end are encoded whole.
    WHOLE = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        self.cut = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer")
        self.known, self.most = {}, most

    def whole(self, text: str) -> list[int]:
        ends = [e for _, e in self.model.encode(text, add_special_tokens=False).offsets]
        return np.maximum.accumulate(np.array(ends, np.int64)).tolist()  # offsets leave blanks out, so an end may fall back

    def of(self, text: str) -> np.ndarray:
        """The ends of a text's tokens; the last one is the text's."""
        if self.cut and not self.WHOLE.search(text):
            first, *rest = text.split(" ")
            pieces = [first, *(" " + x for x in rest)]
            known, at, ends = self.known, 0, []
            for piece in pieces:
                if piece not in known:
                    if len(known) >= self.most:
                        known.clear()
                    known[piece] = self.whole(piece)
                ends += [at + e for e in known[piece]]
                at += len(piece)
        else:
            ends = self.whole(text)
        ends = np.array(ends, np.int64)
        ends[-1:] = len(text)
        return ends


def chunk_by_tokens(docs: DataFrame, tokenizer: str, size: int = 512, overlap: int = 150, text: str = "text") -> DataFrame:
    """chunk() by the tokens of a tokenizer (a file of the tokenizers library, without special tokens), whose offsets cut the text
    itself: no sign is lost or changed, and no chunk has more than size tokens of the text's."""
    if size <= 0 or overlap < 0:
        raise ValueError("size is positive, overlap not negative")
    overlap = min(overlap, size // 2)
    others = [c for c in docs.columns if c not in (text, "chunk_no", "chunk")]
    rows = docs.where(F.col(text).rlike(rf"[^{SPACE}]")).select(*others, F.col(text).alias("_text"))

    def cut():
        tokens = TokenEnds(tokenizer)

        def of(texts):
            found = []
            for t in texts.to_pylist():
                ends = tokens.of(t)
                at = [0, *ends.tolist()]
                found.append([t[at[a] : at[b]] for a, b in token_spans(ends, boundaries(t), size, overlap)])
            return found

        return of

    return pieces(rows, others, cut)


def chunk_sql(size: int, overlap: int, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """The same chunks as a query: key, chunk_no, chunk."""
    least = max(1, int(size * (1 - SNAP)))
    kind = "CASE " + " ".join(f"WHEN regexp_matches(u, '{p}') THEN {len(BOUNDARIES) - i}" for i, p in enumerate(BOUNDARIES)) + " ELSE 0 END"
    best = f"list_max(list_transform(range(stop0 - {size - least}, stop0 + 1), lambda e: CAST(kinds[e] AS BIGINT) * 1000000000 + e)) % 1000000000"
    stop = f"CASE WHEN stop0 >= n THEN n ELSE {best} END"
    return f"""WITH RECURSIVE parts AS (SELECT {key}, regexp_extract_all({text}, '{UNIT}') AS parts FROM {table} WHERE regexp_matches({text}, '[^{SPACE}]')),
kinds AS (SELECT {key}, parts, list_transform(parts, lambda u: {kind}) AS kinds, len(parts) AS n FROM parts),
walk AS (
  SELECT {key}, 0 AS chunk_no, CAST(0 AS BIGINT) AS start, {stop} AS stop, n FROM (SELECT *, {size} AS stop0 FROM kinds)
  UNION ALL
  SELECT {key}, chunk_no + 1, start, {stop}, n FROM (
    SELECT w.{key}, w.chunk_no, greatest(w.stop - {overlap}, w.start + 1) AS start, greatest(w.stop - {overlap}, w.start + 1) + {size} AS stop0, k.n, k.kinds
    FROM walk w JOIN kinds k ON w.{key} = k.{key} WHERE w.stop < w.n))
SELECT w.{key}, CAST(chunk_no AS BIGINT) AS chunk_no, array_to_string(parts[start + 1:stop], '') AS chunk FROM walk w JOIN kinds k ON w.{key} = k.{key}"""


def page_groups(pages: DataFrame, per: int = 16, page: str = "page_number") -> DataFrame:
    """Pages with part_no: per pages make a part, so that long files are read in parallel."""
    return pages.withColumn("part_no", F.floor((F.col(page) - 1) / per))
