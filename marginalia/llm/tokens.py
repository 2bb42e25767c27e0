"""Token ids of whole texts, the same as the tokenizers library gives, at a fraction of its cost.

The pre-tokenizers of both vocabularies cut a text at places that don't depend on what stands further off. Texts are
cut there (and only at places where the cut is certain), each distinct chunk is encoded once by the library, and its ids
are kept in a table of fixed size. Chunks are told apart by 64-bit hashes of their bytes and length, not by the bytes: among the
2^21 chunks that a table holds two fall together with a chance of about 1e-7. Texts for which the cuts are not certain are encoded whole by the library.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from marginalia.llm import textbytes as tb

_LETTER = tb.byte_class(bytes([*range(65, 91), *range(97, 123)]))
_PUNCT = tb.byte_class(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
#: Lead bytes of white space outside ASCII, and control characters that some libraries count as white space.
_ODD_LEAD = tb.byte_class(b"\xc2\xe1\xe2\xe3")
_ODD = tb.byte_class(bytes(range(0x1C, 0x20)))
_ODD_PAIRS = np.array([0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380, 0x3C7C], np.uint16)

SLOTS = 1 << 21
KEEP_IDS = 1 << 23


class Encoder:
    """ids of each text plus one end id; encode() takes an Arrow string column.

    Strings of special tokens inside a text are ordinary text. A null text is an empty one.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            form = {k: v for k, v in json.load(f).items() if k in ("normalizer", "pre_tokenizer")}
        pre = form["pre_tokenizer"] or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not form["normalizer"]:
            self.mode = "spaces kept"
        elif [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.mode = "spaces dropped"
        else:
            self.mode = "whole"
        self.end_id = end_id
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.slots = np.full(SLOTS, -1, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.flat[0] = self.end_id
        self.used = 1
        self.begin = np.zeros(1 << 14, np.int32)
        self.count = np.zeros(1 << 14, np.int32)
        self.count[0] = 1  # entry 0 is the end id
        self.entries = 1

    def _add(self, lists: list[list[int]]) -> None:
        flat = np.fromiter((i for x in lists for i in x), np.int32)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.entries + len(lists) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[self.entries : self.entries + len(lists)] = self.used + np.cumsum(sizes) - sizes
        self.count[self.entries : self.entries + len(lists)] = sizes
        self.used += len(flat)
        self.entries += len(lists)

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entry of each chunk; unknown chunks are encoded and entered."""
        h = tb.hashes_between(data, starts, ends, tb.PLAIN if self.mode == "spaces kept" else tb.FOLDED)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        entry = np.where(self.keys[slot] == h, self.slots[slot], -1)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            number = self.entries + np.arange(len(new), dtype=np.int32)
            self._add([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            entry[missing] = number[back]
            slot = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            self.keys[slot], self.slots[slot] = new, number
        return entry

    def _cuts(self, data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks."""
        space = tb.SPACE[data]
        begins = np.zeros(len(data), bool)
        after_letter = _LETTER[data[:-1]] & _PUNCT[data[1:]]
        if self.mode == "spaces kept":
            begins[1:] = (space[1:] & ~space[:-1]) | after_letter
            alone = space & (data != 32)  # a single line end or tab is a token of its own
            alone[1:] &= ~space[:-1]
            alone[firsts] = (space & (data != 32))[firsts]
            begins[1:] |= alone[:-1] & ~space[1:]
            begins[firsts] = True
            starts = np.flatnonzero(begins)
            return starts, np.append(starts[1:], len(data))
        on = ~space
        begins[1:] = on[1:] & (space[:-1] | after_letter)
        begins[firsts] = on[firsts]
        starts = np.flatnonzero(begins)
        stops = np.zeros(len(data) + 1, bool)
        stops[1:-1] = on[:-1] & (space[1:] | begins[1:])
        stops[firsts[firsts > 0]] = on[firsts[firsts > 0] - 1]
        stops[-1] = on[-1]
        return starts, np.flatnonzero(stops)

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows in which a cut may not be certain."""
        at = np.flatnonzero(_ODD_LEAD[data] | (data == 0x3C))
        at = at[at + 1 < len(data)]
        at = at[np.isin(data[at].astype(np.uint16) << np.uint16(8) | data[at + 1], _ODD_PAIRS)]
        at = np.append(at, np.flatnonzero(_ODD[data]))
        return np.unique(np.searchsorted(offsets, at, "right") - 1)

    def encode(self, column: pa.Array):
        """Yields (first row, row places, ids): the ids of row i are ids[places[i] : places[i + 1]], the end id last."""
        data, offsets = tb.column_bytes(column)
        for lo, hi in tb.row_spans(offsets):
            if self.used > KEEP_IDS:
                self._reset()
            yield lo, *self._encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        whole = np.arange(n) if self.mode == "whole" else self._odd_rows(data, offsets)
        whole = whole[offsets[whole + 1] > offsets[whole]]
        if n == 1 and (len(whole) or len(data) > 8 * tb.PIECE):
            return self._by_library(data)
        if len(whole):
            return self._apart(data, offsets, whole)
        firsts = np.unique(offsets[:-1][offsets[:-1] < len(data)])
        if len(data):
            starts, ends = self._cuts(data, firsts)
            entry = self._entries(data, starts, ends)
        else:
            starts, entry = np.zeros(0, np.int64), np.zeros(0, np.int32)
        rows = np.searchsorted(starts, offsets[1:], "left")
        entry = np.insert(entry, rows, 0)
        size, begin = self.count[entry].astype(np.int64), self.begin[entry].astype(np.int64)
        stop = np.cumsum(size)
        total = int(stop[-1])
        ids = self.flat[np.repeat(begin - (stop - size), size) + np.arange(total)]
        places = np.zeros(n + 1, np.int64)
        places[1:] = stop[rows + np.arange(n)]
        return places, ids

    def _by_library(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.tokenizer.encode(data.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
        ids = np.array([*ids, self.end_id], np.int32)
        return np.array([0, len(ids)]), ids

    def _apart(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some rows by the library, the runs of rows between them by chunks."""
        parts, sizes, lo, n = [], [], 0, len(offsets) - 1
        for row in [*whole.tolist(), n]:
            if row > lo:
                places, ids = self._encode(data[offsets[lo] : offsets[row]], offsets[lo : row + 1] - offsets[lo])
                parts.append(ids)
                sizes.append(np.diff(places))
            if row < n:
                _, ids = self._by_library(data[offsets[row] : offsets[row + 1]])
                parts.append(ids)
                sizes.append(np.array([len(ids)]))
            lo = row + 1
        places = np.zeros(n + 1, np.int64)
        places[1:] = np.cumsum(np.concatenate(sizes))
        return places, np.concatenate(parts)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, end_id)
    return _ENCODERS[key]
