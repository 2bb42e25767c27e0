"""Differences between two versions of a text, as segments; pairs of versions are rows and Spark deals them out.

Longer texts are compared by paragraphs, as tables of segments: see marginalia.operators.revisions.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from marginalia.session import checkpoint_dir

SEGMENTS = "array<struct<op: string, text: string>>"
#: Rows whose results are Python objects at once; those of the rest of a batch are Arrow's.
PIECE = 128


def in_pieces(call, a: pa.Array, b: pa.Array, kind: pa.DataType) -> pa.Array:
    """call of each pair of values, as an array of kind. A batch has thousands of rows, and as dicts their segments take many times their size."""
    parts = [pa.array([call(x, y) for x, y in zip(a.slice(n, PIECE).to_pylist(), b.slice(n, PIECE).to_pylist(), strict=True)], kind) for n in range(0, len(a), PIECE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def segments_type() -> pa.DataType:
    return pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())]))


def word_segments(old: str | None, new: str | None, cap: int | None = None, keep_breaks: bool = False) -> list[dict[str, str]]:
    """equal, delete and insert segments of words, all of them unless a caller wants the first few; paragraph breaks count as words where they are kept."""
    cut = (lambda t: re.findall(r"\n\n|(?:(?!\n\n)\s)+|\S+", t)) if keep_breaks else str.split
    a, b = ([w for w in cut(x or "") if w == "\n\n" or w.strip()] for x in (old, new))
    joined = lambda words: re.sub(" ?\n\n ?", "\n\n", " ".join(words))
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if op == "equal":
            out.append({"op": "equal", "text": joined(a[i:j])})
            continue
        out += [{"op": kind, "text": joined(part)} for kind, part in (("delete", a[i:j]), ("insert", b[k:m])) if part]
    return out[:cap]


def word_diff(old: Column, new: Column, keep_breaks: bool = False) -> Column:
    @arrow_udf(SEGMENTS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_pieces(lambda x, y: word_segments(x, y, None, keep_breaks), a, b, segments_type())

    return run(old, new)


def sequence_ratio(old: Column, new: Column) -> Column:
    """Twice the matching words over all words, 1 for two empty texts."""
    return _ratio(old, new, str.split)


def letter_ratio(old: Column, new: Column) -> Column:
    """Twice the matching characters over all characters, 1 for two empty texts."""
    return _ratio(old, new, str)


def _ratio(old: Column, new: Column, cut) -> Column:
    @arrow_udf("double")  # of the kind that word_diff has, so that a task takes one Python worker for both
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_pieces(lambda x, y: 1.0 if x == y else difflib.SequenceMatcher(None, cut(x or ""), cut(y or "")).ratio(), a, b, pa.float64())

    return run(old, new)


def letter_bound(old: Column, new: Column) -> Column:
    """No letter_ratio is above this: twice the shorter length over both."""
    a, b = F.length(old), F.length(new)
    return F.coalesce(F.try_divide(2 * F.least(a, b), a + b), F.lit(1.0))


def greedy_match(scores: DataFrame, group: str | list[str], threshold: float) -> DataFrame:
    """Rows of a score table (group, left, right, score) that greedy one-to-one matching takes in each group: by falling score,
    then by left, then by right.

    Rounds of joins: a pair that is the best left of both its sides is one that the greedy way takes; the pairs of those sides go,
    and the next round looks among the rest. No group has to fit into a task. Rows that repeat a pair count as one.
    """
    checkpoint_dir(scores.sparkSession)
    keys = [group] if isinstance(group, str) else list(group)
    rows = scores.filter(F.col("score") >= threshold).dropDuplicates([*keys, "left", "right"]).checkpoint()
    rest, taken = rows.select(*keys, "left", "right", "score"), None
    while not rest.isEmpty():
        best = lambda one, other: rest.groupBy(*keys, one).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(other).alias("x"))).getField("x").alias(other))  # noqa: E731, B023
        found = best("left", "right").join(best("right", "left"), [*keys, "left", "right"]).checkpoint()
        taken = found if taken is None else taken.unionByName(found)
        rest = rest.join(found.select(*keys, "left"), [*keys, "left"], "left_anti").join(found.select(*keys, "right"), [*keys, "right"], "left_anti").select(*keys, "left", "right", "score").checkpoint()
    return rows.limit(0) if taken is None else rows.join(taken, [*keys, "left", "right"], "left_semi")
