"""Words of many texts at once: numpy passes over the UTF-8 bytes of an Arrow string column.

A word's hash is a polynomial over its bytes, taken from one running sum, so the cost is a few passes over the
bytes and not a Python step for each word. Long texts are worked off in pieces cut before a separator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        m = max(n, PIECE + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(m, base)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: A random value for each byte; folded gives A-Z the values of a-z.
PLAIN = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
ALNUM = byte_class(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_spans(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def hashes_between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], which must be short enough for one running sum."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _words(data: np.ndarray, firsts: np.ndarray, inside: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and start positions; firsts are places where a text begins."""
    on = inside[data]
    begins = on.copy()
    begins[1:] &= ~on[:-1]
    firsts = firsts[firsts < len(data)]
    begins[firsts] = on[firsts]
    stops = on.copy()
    stops[:-1] &= ~on[1:]
    ends_at = firsts[firsts > 0] - 1
    stops[ends_at] = on[ends_at]
    starts = np.flatnonzero(begins)
    return hashes_between(data, starts, np.flatnonzero(stops) + 1, values), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of the rows, in order, and the rows' places in that list (len(rows) + 1 of them)."""
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in row_spans(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        while a < b:
            stop = b
            if b - a > PIECE:  # one long text: cut before a byte that is in no word
                breaks = np.flatnonzero(~inside[data[a + PIECE // 2 : a + PIECE]])
                if not len(breaks):
                    breaks = np.flatnonzero(~inside[data[a + PIECE : b]][:1 << 26]) + PIECE // 2
                stop = a + PIECE // 2 + int(breaks[-1] if breaks[-1] < PIECE // 2 else breaks[0]) if len(breaks) else b
                stop = min(max(stop, a + 1), b)
            firsts = offsets[lo:hi] - a
            h, at = _words(data[a:stop], firsts[firsts >= 0], inside, values)
            parts.append(h)
            if hi - lo == 1:
                counts[lo] += len(h)
            else:
                edges = np.searchsorted(at, offsets[lo : hi + 1] - a)
                counts[lo:hi] += np.diff(edges)
            a = stop
    places = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=places[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), places


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(words: np.ndarray, places: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; fewer words make one shingle, none an empty set."""
    runs = words.copy()
    for i in range(1, k):
        runs[: len(words) - i] = runs[: len(words) - i] * _STEP + words[i:] if len(words) > i else 0
    runs = mix(runs)
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _STEP + w
            yield mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on; the last k - 1 places hold no gram."""
    runs = words[: max(0, len(words) - k + 1)].copy()
    for i in range(1, k):
        runs = runs * _STEP + words[i : i + len(runs)]
    return mix(runs)
