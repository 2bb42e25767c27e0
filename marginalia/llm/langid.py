"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds (multiplies) the
vectors of its letters, permuted (rolled) by their place; a text's vector bundles (adds) those of its trigrams; a
language's prototype bundles those of its training texts. A text's language is the one with the nearest prototype by
cosine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

DIM = 1024
PER_LANGUAGE = 1000
#: Trigrams whose vectors are held at once, and the largest table that counts a batch's trigrams without sorting them.
SLICE, TABLE = 8192, 1 << 22
_BITS = 21  # of a code point


@lru_cache
def _folded() -> np.ndarray:
    """The lower-case code point of each letter, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def _vector(code_point: int, dim: int) -> np.ndarray:
    return np.random.default_rng(code_point).integers(0, 2, dim, np.int8) * np.int8(2) - np.int8(1)


class Profiler:
    """Vectors of texts. Each letter's own is drawn when it is first met (those of letters at once)."""

    def __init__(self, letters: Iterable[int] = (), dim: int = DIM):
        self.dim = dim
        self.row = np.full(sys.maxunicode + 1, -1, np.int32)
        self.rows = np.zeros((64, dim), np.int8)
        self.known = 0
        self.letters(np.array([0, *letters], np.int64))

    def letters(self, points: np.ndarray) -> np.ndarray:
        """The vector of each code point."""
        new = np.unique(points[self.row[points] < 0])
        while self.known + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for c in new.tolist():
            self.rows[self.known] = _vector(c, self.dim)
            self.row[c] = self.known
            self.known += 1
        return self.rows[self.row[points]]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct trigrams of the texts (around each letter; what is no letter is one boundary), as three code points of
        21 bits each; of each place the trigram, by its number, and the text."""
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        seq = _folded()[points]
        keep = seq > 0
        keep[1:] |= seq[:-1] > 0
        keep[0] = True
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        row = np.searchsorted(starts, np.flatnonzero(keep), "right") - 1
        seq = seq[keep]
        used = np.flatnonzero(np.bincount(seq))
        place = np.zeros(int(used[-1]) + 1, np.int64)
        place[used] = np.arange(len(used))
        seq, n = place[seq], len(used)
        letter = seq[1:-1] > 0  # place 0 is the boundary, with which the texts begin
        code = ((seq[:-2] * n + seq[1:-1]) * n + seq[2:])[letter]
        if n**3 <= TABLE:
            seen = np.flatnonzero(np.bincount(code, minlength=1))
            number = np.zeros(n**3, np.int64)
            number[seen] = np.arange(len(seen))
            which = number[code]
        else:
            seen, which = np.unique(code, return_inverse=True)
        distinct = used[seen // (n * n)] << 2 * _BITS | used[seen // n % n] << _BITS | used[seen % n]
        return distinct, which, row[1:-1][letter]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row for each trigram."""
        low = (1 << _BITS) - 1
        first, second, third = (self.letters(grams >> shift & low) for shift in (2 * _BITS, _BITS, 0))
        return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The vector of each text; zero where a text has no letter."""
        distinct, which, row = self.grams(texts)
        out = np.zeros((len(texts), self.dim), np.float32)
        for lo in range(0, len(distinct), SLICE):
            part = distinct[lo : lo + SLICE]
            here = slice(None) if len(distinct) <= SLICE else (which >= lo) & (which < lo + SLICE)
            counts = np.bincount(row[here] * len(part) + which[here] - lo, minlength=len(texts) * len(part))
            out += counts.reshape(len(texts), -1).astype(np.float32) @ self.vectors(part).astype(np.float32)
        return out

    def total(self, texts: list[str]) -> np.ndarray:
        """The sum of the vectors of all texts."""
        distinct, which, _ = self.grams(texts)
        n = np.bincount(which, minlength=len(distinct)).astype(np.float64)
        out = np.zeros(self.dim)
        for lo in range(0, len(distinct), SLICE):
            out += n[lo : lo + SLICE] @ self.vectors(distinct[lo : lo + SLICE]).astype(np.float64)
        return out


def _chunks(column: pa.Array, chars: int = 1 << 20, rows: int = 512):
    """Lists of texts of bounded size; null is empty."""
    part, size = [], 0
    for text in column:
        text = text.as_py() or ""
        if part and (size + len(text) > chars or len(part) == rows):
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


class Model:
    """Languages and their unit prototypes."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages, self.prototypes = languages, prototypes


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", *, per_language: int = PER_LANGUAGE, dim: int = DIM) -> Model:
    """Fit on about per_language texts of each language (all, where there are fewer), taken by a hash of the id.

    That bound is the only one: the sampled texts count whole, with every letter of every script. Rows without a language
    or text are left out. What reaches the driver are the prototypes, dim numbers for each language.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < F.least(F.lit(1.0), F.lit(per_language) / F.col("n")) * (1 << 32)
    # a row for each language, of which the driver holds a prototype anyway; else all texts would be shuffled by language
    sample = rows.join(F.broadcast(sizes), "lang").filter(chance).select("lang", "text")

    def totals(batches):
        own, sums = Profiler(dim=dim), {}
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                mine = batch.filter(pc.equal(batch.column(0), lang))
                for texts in _chunks(mine.column(1)):
                    sums[lang] = sums.get(lang, 0) + own.total(texts)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim)), pa.array(v.astype(np.int64))], ["lang", "i", "n"])

    sums = sample.mapInArrow(totals, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    prototypes = np.zeros((len(languages), dim))
    for i, lang in enumerate(languages):
        mine = sums[sums["lang"] == lang]
        prototypes[i, mine["i"].to_numpy()] = mine["n"].to_numpy(np.float64)
    return Model(languages, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12))


_PROFILERS: dict[int, Profiler] = {}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score): the nearest language of each whole text and its cosine, 0 where that is negative.

    `und` with score 0 where a text is null, empty or has no letter, and everywhere if nothing was learned. Ties go to the
    language that sorts first; repeated rows come out once each; other columns are ignored.
    """

    def work(batches):
        for batch in batches:
            for at, lang, score in _languages(batch.column(1), model):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lang)), pa.array([x or "und" for x in lang], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def told(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose own text is `und`; ids play no part. If nothing was learned all texts with a letter stay."""

    def work(batches):
        for batch in batches:
            stays = [x != "und" for _, lang, _ in _languages(batch.column(text_col), model) for x in lang]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def _languages(column: pa.Array, model: Model):
    """Runs of texts: the first one's row, the language of each (`und` without a letter, None if nothing was learned), its score."""
    dim, at = model.prototypes.shape[1], 0
    own = _PROFILERS.setdefault(dim, Profiler(dim=dim))
    for texts in _chunks(column):
        v = own.bundle(texts)
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        letters = v.any(1)
        if len(model.languages):
            cos = (v @ model.prototypes.T.astype(np.float32)) / np.maximum(norm, 1e-12)[:, None]
            best, score = cos.argmax(1), np.clip(cos.max(1), 0, 1)
            lang = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        else:
            score, lang = np.zeros(len(texts)), [None if ok else "und" for ok in letters.tolist()]
        yield at, lang, np.where(letters, score, 0.0).astype(np.float64)
        at += len(texts)


def held_out(id_col: str = "doc_id"):
    """Documents that never count as labelled: a quarter, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
