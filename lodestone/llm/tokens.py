"""Texts to token ids in a task: a text is cut before its spaces into units, each new unit is encoded once.

The byte-level pattern never joins what stands on both sides of a space that follows or precedes other than white space, so
the ids of a text are those of its units one after another. Texts with longer runs of white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
MAX_UNITS, MAX_CHARS = 1_200_000, 24_000_000
RUN = re.compile(r"\s (?:\s|\Z)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Index(dict):
    """From a unit to its number; unknown ones get the next number and wait to be encoded."""

    def __init__(self, owner: UnitTable, prefix: str):
        self.owner, self.prefix = owner, prefix

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self.owner.lens) + len(self.owner.waiting)
        self.owner.chars += len(key)
        self.owner.waiting.append(self.prefix + key)
        return n


class UnitTable:
    """Ids of units in one flat array. encoder: list of texts -> (flat ids, ids of each). Bounded: past max_units units or max_chars
    characters of them only the units that were met again stay, and none if those are over half of either. whole: texts in which it
    finds something are encoded as they are."""

    def __init__(self, encoder, max_units: int = MAX_UNITS, max_chars: int = MAX_CHARS, whole: re.Pattern = RUN):
        self.encoder, self.max_units, self.max_chars, self.whole = encoder, max_units, max_chars, whole
        self.clear()

    def clear(self) -> None:
        self.first, self.rest, self.waiting = _Index(self, ""), _Index(self, " "), []
        self.flat, self.lens, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.chars = np.zeros(0, np.int64), 0

    def _shrink(self) -> None:
        stay = np.flatnonzero(self.used > 1)
        if 2 * len(stay) > self.max_units:
            return self.clear()
        new = np.full(len(self.lens), -1, np.int64)
        new[stay] = np.arange(len(stay))
        for index in (self.first, self.rest):
            kept = [(k, new[n]) for k, n in index.items() if new[n] >= 0]
            index.clear()
            index.update((k, int(n)) for k, n in kept)
        self.chars = sum(map(len, self.first)) + sum(map(len, self.rest))
        if 2 * self.chars > self.max_chars:
            return self.clear()
        self.starts, self.lens, self.used = self.starts[stay], self.lens[stay], np.zeros(len(stay), np.int64)
        ends = np.cumsum(self.lens)
        self.flat = self.flat[np.arange(self.lens.sum()) + np.repeat(self.starts - (ends - self.lens), self.lens)]
        self.starts = ends - self.lens

    def _settle(self) -> None:
        if self.waiting:
            flat, lens = self.encoder(self.waiting)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
            self.flat, self.lens, self.waiting = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens]), []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, ids of each text)."""
        if len(self.lens) > self.max_units or self.chars > self.max_chars:
            self._shrink()
        numbers, per_text = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.whole.search(text) or len(text) < 2:
                numbers.append(np.array([len(self.lens) + len(self.waiting)], np.int64))
                self.waiting.append(text)
            else:
                units = text.split(" ")
                found = np.fromiter(map(self.rest.__getitem__, units[1:]), np.int64, len(units) - 1)
                numbers.append(np.concatenate([[self.first[units[0]]], found]))
            per_text[i] = len(numbers[-1])
        self._settle()
        if not numbers:
            return np.zeros(0, np.uint32), per_text
        number = np.concatenate(numbers)
        self.used = np.concatenate([self.used, np.zeros(len(self.lens) - len(self.used), np.int64)]) + np.bincount(number, minlength=len(self.lens))
        lens = self.lens[number]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1]) + np.repeat(self.starts[number] - (ends - lens), lens)
        sums = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.flat[at], np.diff(sums)


class LibraryEncoder:
    """Units through the tokenizers library. Clean units are joined to longer texts and parted again by the bytes of each id."""

    def __init__(self, path: str, as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = as_text
        n = self.tokenizer.get_vocab_size()
        special = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes = np.array([len(special[i].encode()) if i in special else len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)

    def _batch(self, texts: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens, starts, flat, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [], 0
        clean = np.fromiter(map(self.clean, units), bool, len(units))
        alone, joined = np.flatnonzero(~clean), np.flatnonzero(clean)
        for k in range(0, len(alone), 500):
            some = alone[k : k + 500]
            found = self._batch([units[i] for i in some])
            lens[some] = n = np.fromiter(map(len, found), np.int64, len(found))
            starts[some] = size + np.cumsum(n) - n
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, n.sum()))
            size += n.sum()
        for k in range(0, len(joined), 20_000):
            some = joined[k : k + 20_000]
            mine = [units[i] for i in some]
            found = self._batch(["".join(mine[j : j + 400]) for j in range(0, len(mine), 400)])
            ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
            ends = np.cumsum(np.fromiter((len(u.encode()) for u in mine), np.int64, len(mine)))
            cuts = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
            lens[some] = n = np.diff(cuts, prepend=0)
            starts[some] = size + cuts - n
            flat.append(ids)
            size += len(ids)
        whole = np.concatenate(flat)
        ends = np.cumsum(lens)
        return whole[np.arange(ends[-1]) + np.repeat(starts - (ends - lens), lens)], lens

    @staticmethod
    def clean(unit: str) -> bool:
        return unit[:1] == " " and len(unit.strip()) == len(unit) - 1


def token_type(path: str) -> str:
    """The unsigned integers that hold all of a tokenizer's ids: two bytes, or four."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return "<u2" if max([*t.get_vocab().values(), *t.get_added_tokens_decoder()]) < 1 << 16 else "<u4"


_tables: dict = {}


def library_table(path: str, as_text: bool = False) -> UnitTable:
    """The worker's own table; workers are used again for later tasks."""
    key = ("library", path, as_text)
    if key not in _tables:
        _tables[key] = UnitTable(LibraryEncoder(path, as_text))
    return _tables[key]
