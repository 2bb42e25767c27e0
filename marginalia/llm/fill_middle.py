"""Fill-in-the-middle transformation over ropes.

A text is cut into units (runs of ASCII letters, and every other code point by itself). A rope is a tree over its pieces: each leaf
holds a piece that begins and ends between units and caches its numbers of units and of code points, each inner node the
sums of its children. Splitting at two ranks gives prefix, middle and suffix as subtrees; the output joins them in their new order
with sentinels between. The inverse makes a rope of the output, splits it where the sentinels stand and joins the parts in
their old order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and of the others' that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
LEAF = 4096  # code points, or one longer unit

_LETTER = np.zeros(128, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _begins(text: str) -> np.ndarray:
    """Whether a unit begins at each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(points, 127)]
    out = ~letter
    out[:1] = True
    out[1:] |= ~letter[:-1]
    return out


class Leaf:
    """A piece of text with its numbers of units and code points."""

    __slots__ = ("text", "units", "chars")

    def __init__(self, text: str, units: int | None = None):
        self.text, self.chars = text, len(text)
        self.units = int(_begins(text).sum()) if units is None else units


class Node:
    """Two subtrees one after the other."""

    __slots__ = ("left", "right", "units", "chars")

    def __init__(self, left: Leaf | Node, right: Leaf | Node):
        self.left, self.right = left, right
        self.units, self.chars = left.units + right.units, left.chars + right.chars


Rope = Leaf | Node


def rope(text: str, leaf: int = LEAF) -> Rope:
    """A balanced rope of a text."""
    begins = _begins(text)
    if len(text) <= leaf:
        return Leaf(text, int(begins.sum()))
    starts = np.flatnonzero(begins)
    at = np.searchsorted(starts, np.arange(0, len(text), leaf), "right") - 1  # the unit that each cut falls into
    at = np.unique(at)
    cuts, numbers = [*starts[at].tolist(), len(text)], [*at.tolist(), len(starts)]
    level: list[Rope] = [Leaf(text[a:b], n - m) for a, b, m, n in zip(cuts[:-1], cuts[1:], numbers[:-1], numbers[1:], strict=True)]
    while len(level) > 1:
        pairs = [Node(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[2 * len(pairs) :]
    return level[0]


def joined(*parts: Rope) -> Rope:
    """Ropes one after the other; empty ones take no node."""
    out: Rope = Leaf("", 0)
    for part in parts:
        if part.chars:
            out = Node(out, part) if out.chars else part
    return out


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units (or chars) of a rope, and the rest."""
    path = []
    while isinstance(tree, Node):
        here = getattr(tree.left, by)
        right = rank >= here
        path.append((tree, right))
        tree, rank = (tree.right, rank - here) if right else (tree.left, rank)
    if rank <= 0:
        left, right_part = Leaf("", 0), tree
    elif rank >= getattr(tree, by):
        left, right_part = tree, Leaf("", 0)
    else:
        at = int(np.flatnonzero(_begins(tree.text))[rank]) if by == "units" else rank
        left, right_part = Leaf(tree.text[:at]), Leaf(tree.text[at:])
    for node, went_right in reversed(path):
        if went_right:
            left = joined(node.left, left)
        else:
            right_part = joined(right_part, node.right)
    return left, right_part


def leaves(tree: Rope) -> Iterator[str]:
    """The pieces of a rope from left to right."""
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, Node):
            stack += [node.right, node.left]
        else:
            yield node.text


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """The four numbers that decide a document's form and cuts; a null id draws like an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def transformed(text: str, numbers: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    tree = rope(text)
    first, second, plain, order = numbers
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or plain % 100 >= 100 - PLAIN:
        return tree.units, "plain", None, None, text
    low, high = sorted((first % (tree.units + 1), second % (tree.units + 1)))
    front, suffix = split(tree, high)
    prefix, middle = split(front, low)
    mark = {s: Leaf(s) for s in (PREFIX, SUFFIX, MIDDLE)}
    if order % 100 < SUFFIX_FIRST:
        form, out = "spm", joined(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    else:
        form, out = "psm", joined(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    return tree.units, form, prefix.chars, middle.chars, "".join(leaves(out))


def restored(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    head, between = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    # the text holds no sentinel, so the first of each kind behind the head is the one that was put there
    second = output.index(between, len(head))
    third = output.index(MIDDLE, second + len(between))
    rest, middle = split(rope(output), third, "chars")
    rest, latter = split(rest, second, "chars")
    former = split(rest, len(head), "chars")[1]
    latter, middle = split(latter, len(between), "chars")[1], split(middle, len(MIDDLE), "chars")[1]
    prefix, suffix = (latter, former) if form == "spm" else (former, latter)
    return "".join(leaves(joined(prefix, middle, suffix)))


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text; form is plain, psm or spm.

    A null text is an empty one and plain, as is a text that holds a sentinel; prefix_chars and middle_chars are null then. Null
    ids draw their numbers like an empty id; rows that repeat, or share an id, come out once each; other columns are ignored; an
    empty table gives an empty one. A task holds one text and its rope besides its batch.
    """

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for rows in _parts(batch.column(1)):
                found = [transformed(text.as_py() or "", draws(ids[i].as_py())) for i, text in rows]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(rows[0][0], len(rows)), *columns], [x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, _OUT)


def undo(outputs: DataFrame) -> DataFrame:
    """outputs with a column restored: the text rebuilt from the columns output and form alone. A null output gives null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema if f.name != "restored") + ", restored string"
    out = outputs.drop("restored")

    def work(batches):
        for batch in batches:
            forms = batch.column("form")
            for rows in _parts(batch.column("output")):
                texts = [None if text.as_py() is None else restored(text.as_py(), forms[i].as_py()) for i, text in rows]
                part = batch.slice(rows[0][0], len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "restored"])

    return out.mapInArrow(work, schema)


def _parts(column: pa.Array, chars: int = 1 << 22) -> Iterator[list[tuple[int, pa.Scalar]]]:
    """Runs of rows of bounded size, or one longer text."""
    part, size = [], 0
    for i, text in enumerate(column):
        n = text.as_buffer().size if text.is_valid else 0
        if part and size + n > chars:
            yield part
            part, size = [], 0
        part.append((i, text))
        size += n
    if part:
        yield part


def digest(outputs: DataFrame) -> DataFrame:
    """Numbers, form and SHA-256 of the output and of the text rebuilt from it."""
    found = undo(outputs)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
