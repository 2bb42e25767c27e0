"""Benchmark passages in training texts: word pairs as seeds, then local alignment.

A score of t or more leaves traces that no corpus can hide. Let an item have L words, of which an alignment matches m,
with e words replaced, left out or put in between. With 2 m - e >= 2 t L, at most m - t L of the m - 1 gaps between words
matched one after the other hold two edits or more. So at least t L - 1 of the item's words are matched and followed, with
at most one edit between, by a match: each such word and the next or the one after it stand in the text side by side
or one word apart. And since m + e is bounded, all of it stands in (3 - 2 t) L words of the text.

Of these L - 1 places an item needs t L - 1, so that its most frequent ones can be left out of the search: any c of those
needed are still found if all but t L - 1 - c are looked for. A text in which c of them stand close enough is aligned
there by Smith-Waterman. That depends on the text and the item alone, not on how many texts hold the passage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm import textbytes as tb
from marginalia.llm.storage import written

MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds of an item that must stand close to each other (fewer where it needs fewer), and places of items looked at in one go.
TOGETHER, HITS = 3, 1 << 19
#: Bytes of whole texts (or one longer text) whose words are held at once.
AT_ONCE = 1 << 22
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _apart(words: np.ndarray, step: int) -> np.ndarray:
    """The hash of each word with the one step places on."""
    return tb.mix(words[: max(0, len(words) - step)] * _STEP + words[step:])


class Items:
    """A block of benchmark items as word hashes, with the seeds that find every alignment at or above the threshold."""

    def __init__(self, ids: list[int], words: list[np.ndarray], threshold: float):
        self.ids, self.words = ids, words
        sizes = np.array([len(w) for w in words])
        needed = np.maximum(1, np.ceil(threshold * sizes - 1 - 1e-9)).astype(np.int64)
        self.together = np.minimum(needed, TOGETHER)
        self.span = np.ceil((3 - 2 * threshold) * sizes).astype(np.int64) + 1
        gram, item, place = [], [], []
        for i, w in enumerate(words):
            for step in (1, 2):
                g = _apart(w, step)
                gram.append(g)
                item.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
        gram, item, place = np.concatenate(gram), np.concatenate(item), np.concatenate(place)
        # how often a place's seeds stand in the block says how common they are
        _, which, often = np.unique(gram, return_inverse=True, return_counts=True)
        starts = np.cumsum([0, *(sizes - 1)])
        load = np.bincount(starts[item] + place, weights=often[which], minlength=starts[-1])
        wanted = np.zeros(len(load), bool)
        for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            wanted[lo + np.argsort(load[lo:hi], kind="stable")[: hi - lo - needed[i] + self.together[i]]] = True
        keep = np.flatnonzero(wanted[starts[item] + place])
        order = keep[np.argsort(gram[keep], kind="stable")]
        gram, self.item, self.place = gram[order], item[order], place[order]
        self.seeds, first = np.unique(gram, return_index=True)
        self.first = np.append(first, len(gram))
        self.mask = np.uint64((1 << max(20, min(24, int(len(self.seeds)).bit_length() + 4))) - 1)
        self.near = np.zeros(int(self.mask) + 1, bool)  # by the low bits; most pairs of a text end here
        self.near[(self.seeds & self.mask).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in a word list at which a seed begins, how many words on it ends, and which seed."""
        out = []
        for step in (1, 2):
            gram = _apart(words, step)
            at = np.flatnonzero(self.near[(gram & self.mask).astype(np.int64)])
            seed = np.searchsorted(self.seeds, gram[at])
            ok = self.seeds[np.minimum(seed, len(self.seeds) - 1)] == gram[at]
            out.append((at[ok], np.full(int(ok.sum()), step), seed[ok]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def align(items: list[np.ndarray], windows: list[np.ndarray], cells: int = 1 << 20) -> np.ndarray:
    """The Smith-Waterman score of each item against its window, as a share of the item's score against itself."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: (len(windows[i]), len(items[i])))
    lo = 0
    while lo < len(order):
        hi, width = lo, 0
        while hi < len(order) and (hi == lo or (hi - lo + 1) * max(width, len(windows[order[hi]])) <= cells):
            width = max(width, len(windows[order[hi]]))
            hi += 1
        part = order[lo:hi]
        text = np.zeros((len(part), width), np.uint64)
        query = np.zeros((max(len(items[i]) for i in part), len(part)), np.uint64)
        valid = np.zeros(query.shape, bool)
        for row, i in enumerate(part):
            text[row, : len(windows[i])] = windows[i]
            query[: len(items[i]), row] = items[i]
            valid[: len(items[i]), row] = True
        inside = text != 0
        slope = np.arange(width, dtype=np.int32)
        above = np.zeros((len(part), width), np.int32)
        best = np.zeros(len(part), np.int32)
        for word, on in zip(query, valid, strict=True):
            now = np.where((text == word[:, None]) & inside, MATCH, MISMATCH).astype(np.int32)
            now[:, 1:] += above[:, :-1]
            np.maximum(now, above + GAP, out=now)
            np.maximum(now, 0, out=now)
            now = np.maximum.accumulate(now - GAP * slope, axis=1) + GAP * slope
            now[~on] = 0
            above = now
            np.maximum(best, now.max(axis=1, initial=0), out=best)
        out[part] = best / np.array([MATCH * max(1, len(items[i])) for i in part])
        lo = hi
    return out


def _windows(items: Items, words: np.ndarray, places: np.ndarray):
    """Stretches of texts (those between places) in which enough of an item's seeds stand together: text, item, from, to."""
    at, step, seed = items.hits(words)
    row = np.searchsorted(places, at, "right") - 1
    inside = at + step < places[row + 1]
    order = np.flatnonzero(inside)[np.argsort(at[inside], kind="stable")]
    at, seed, row = at[order], seed[order], row[order]
    many = items.first[seed + 1] - items.first[seed]
    until = np.cumsum(many)
    lo = 0
    while lo < len(at):  # whole texts, as many as have HITS places of items between them
        hi = int(np.searchsorted(until, (until[lo - 1] if lo else 0) + HITS, "right"))
        hi = int(np.searchsorted(row, row[max(lo, min(hi, len(at) - 1))], "left")) if hi < len(at) else hi
        if hi <= lo:
            hi = int(np.searchsorted(row, row[lo], "right"))
        n = many[lo:hi]
        owner = np.repeat(items.first[seed[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pos, text, item, place = np.repeat(at[lo:hi], n), np.repeat(row[lo:hi], n), items.item[owner], items.place[owner]
        order = np.lexsort((place, pos, item, text))
        pos, text, item, place = pos[order], text[order], item[order], place[order]
        new = np.ones(len(pos), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(pos) != 0) | (np.diff(place) != 0)
        pos, text, item = pos[new], text[new], item[new]
        last = np.arange(len(pos)) + items.together[item] - 1
        ok = last < len(pos)
        last = np.minimum(last, len(pos) - 1)
        span = items.span[item]
        ok &= (text[last] == text) & (item[last] == item) & (pos[last] - pos < span)
        pos, end, text, item, span = pos[ok], pos[last][ok], text[ok], item[ok], span[ok]
        left, right = np.maximum(end - span, places[text]), np.minimum(pos + span + 1, places[text + 1])
        # both ends rise within a text and item; stretches that meet are one
        apart = np.ones(len(pos), bool)
        apart[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (left[1:] > right[:-1])
        first = np.flatnonzero(apart)
        final = np.append(first[1:], len(pos)) - 1 if len(first) else first
        yield text[first], item[first], left[first], right[final]
        lo = hi


def _leaks(items: Items, column: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts the row, item and score of each alignment at or above the threshold."""
    data, offsets = tb.column_bytes(column)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first, end in tb.row_spans(offsets, AT_ONCE):
        words, places = tb.word_hashes(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], tb.ALNUM, tb.FOLDED)
        for text, item, left, right in _windows(items, words, places):
            for lo in range(0, len(text), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                scores = align([items.words[i] for i in item[part]], [words[a:b] for a, b in zip(left[part], right[part], strict=True)])
                good = scores >= threshold
                out.append((text[part][good] + first, item[part][good], scores[good]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _words(column: pa.Array):
    data, offsets = tb.column_bytes(column)
    return tb.word_hashes(data, offsets, tb.ALNUM, tb.FOLDED)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int, threshold: float, block_words: int):
    """The benchmark's items in blocks of bounded size, as the driver streams over them."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("id", "text")
    ids, words, size = [], [], 0
    for row in rows.toLocalIterator():
        w, _ = _words(pa.array([row.text]))
        if len(w) < least:
            continue
        if ids and size + len(w) > block_words:
            yield Items(ids, words, threshold)
            ids, words, size = [], [], 0
        ids.append(row.id)
        words.append(w)
        size += len(w)
    if ids:
        yield Items(ids, words, threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, n: int = 3, threshold: float = 0.5, block_words: int = 1 << 20) -> DataFrame:
    """(id_col, item_col, score): each text and item of which at least threshold stands in the text.

    Words are runs of ASCII letters and digits and of all other characters outside ASCII, with A-Z lower-cased. score is the alignment's score over the item's score
    against itself: 1 for an exact copy. Every pair that reaches the threshold is found, however many texts hold the item.
    The benchmark is a set of queries, met with all texts in blocks of block_words words, so what is sent to the
    executors is bounded.

    Items that are null, empty or shorter than n words match nothing; null and empty texts match nothing, as does a null
    id; repeated texts and items count once; other columns are ignored; an empty table on either side gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, n, threshold, block_words):
        found = _block(rows, items, threshold)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "id long, item long, score double")
    best = out.groupBy("id", "item").agg(F.max("score").alias("score"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score")


def _block(rows: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)  # of block_words words at most

    def leaks(batches):
        own = shared.value
        ids = np.array(own.ids, np.int64)
        for batch in batches:
            row, item, score = _leaks(own, batch.column(1), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(ids[item]), pa.array(score)], ["id", "item", "score"])

    return rows.mapInArrow(leaks, "id long, item long, score double")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, n: int = 3, threshold: float = 0.5, block_words: int = 1 << 20) -> DataFrame:
    """docs without the rows whose own text holds an item, as contaminated finds them; ids play no part."""
    for at, items in enumerate(_blocks(benchmark, item_col, item_text_col, n, threshold, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        # each block is a pass of its own: tasks with several would hold all their blocks at once
        docs = _unleaked(written(docs, "unleaked") if at else docs, shared, text_col, threshold)
    return docs


def _unleaked(docs: DataFrame, shared, text_col: str, threshold: float) -> DataFrame:
    def clean(batches):
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[_leaks(shared.value, batch.column(text_col), threshold)[0]] = False
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(clean, docs.schema)
