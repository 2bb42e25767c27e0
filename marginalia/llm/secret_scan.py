"""Secrets in texts by regular expressions, behind a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived that every matching text satisfies. The index is
partitioned by document: each Arrow batch is a segment with its own postings, so nothing is shuffled and a lost
executor costs no more than its tasks. A rule runs only over the texts its query leaves; a rule without mandatory
trigrams runs over all texts. The pattern's syntax tree is the one of Python's own re package, whose parser modules are not
part of its documented interface.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm import textbytes as tb


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, whether case counts, and the least length of the match or of one of its groups."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base rules of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    Rule("hex", r"[0-9a-f]+", False, 0, 32),
)
# Published formats of keys and tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

#: A query is True (any text), a trigram of UTF-8 bytes with A-Z lower-cased, or ("and" | "or", queries).
MOST_STRINGS = 64


def _all_of(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _low(code_point: int) -> str:
    """A character with A-Z lower-cased, as the index has it."""
    return chr(code_point + 32 if 65 <= code_point <= 90 else code_point)


def _of_strings(strings: set[str]) -> object:
    """Any text that holds one of the strings."""
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(x.encode("utf-8", "surrogatepass") for x in strings)])


def _strings(node) -> set[str] | None:
    """All strings that a node can match, lower-cased, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {_low(arg)}
    if op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) <= 8:
        return {_low(x[1]) for x in arg}
    if op is sre.SUBPATTERN:
        return _joined(arg[3])
    if op is sre.BRANCH:
        each = [_joined(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op is sre.MAX_REPEAT and arg[1] != sre.MAXREPEAT and arg[1] <= 5:
        one = _joined(arg[2])
        if one is None:
            return None
        out, now = set(), {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                out |= now
            now = {a + b for a in now for b in one}
            if len(now) > MOST_STRINGS:
                return None
        return out
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes) -> object:
    parts, run = [], {""}
    for node in [*nodes, None]:
        more = None if node is None else _strings(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(_of_strings(run))
        run = more or {""}
        if more is None and node is not None:
            op, arg = node
            if op is sre.SUBPATTERN:
                parts.append(_query(arg[3]))
            elif op is sre.BRANCH:
                parts.append(_any_of([_query(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(_query(arg[2]))
    return _all_of(parts)


@lru_cache
def trigram_query(pattern: str) -> object:
    """The query over lower-case trigrams that each text with a match of the pattern satisfies."""
    return _query(sre_parser.parse(pattern))


def _trigrams(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def code(trigram: bytes) -> int:
    a, b, c = trigram
    return a << 16 | b << 8 | c


@lru_cache
def _wanted(codes: frozenset[int]) -> np.ndarray:
    out = np.zeros(1 << 24, bool)
    out[list(codes)] = True
    return out


def postings(data: np.ndarray, offsets: np.ndarray, codes: frozenset[int]) -> dict[int, np.ndarray]:
    """For each trigram code the sorted rows that hold it."""
    low = _LOWER[data]
    grams = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(data) > 2 else np.zeros(0, np.uint32)
    at = np.flatnonzero(_wanted(codes)[grams])
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[row + 1]
    n = len(offsets)
    pair = np.unique(grams[at[inside]].astype(np.int64) * n + row[inside])
    gram, row = pair // n, pair % n
    edges = np.flatnonzero(np.diff(gram)) + 1
    return {int(g[0]): r for g, r in zip(np.split(gram, edges), np.split(row, edges), strict=True) if len(g)}


def matching_rows(query: object, index: dict[int, np.ndarray], rows: int) -> np.ndarray:
    """Rows that satisfy a query."""
    if query is True:
        return np.arange(rows)
    if isinstance(query, bytes):
        return index.get(code(query), np.zeros(0, np.int64))
    parts = [matching_rows(q, index, rows) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    out = parts[0]
    for p in sorted(parts[1:], key=len):
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def find(rule: Rule, text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Spans of a rule in a text: leftmost, not overlapping, in code points; matches that are too short are dropped."""
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _at_least(rule: Rule) -> re.Pattern:
    """The rule's pattern; one that is a single greedy class with a least length looks for that length at once."""
    if rule.group == 0 and rule.least > 1 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        rule = Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", rule.any_case)
    return rule.compiled()


def _found(column: pa.Array, rules: tuple[Rule, ...]):
    """Runs of texts: the first one's row, and for each the (start, rule, end) found in it."""
    compiled = [_at_least(r) for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    codes = frozenset(code(t) for q in queries for t in _trigrams(q))
    data, offsets = tb.column_bytes(column)
    for lo, hi in tb.row_spans(offsets):
        index = postings(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], codes)
        texts = column.slice(lo, hi - lo).to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, pattern, query) in enumerate(zip(rules, compiled, queries, strict=True)):
            for row in matching_rows(query, index, hi - lo).tolist():
                if texts[row]:
                    found[row] += [(a, n, b) for a, b in find(rule, texts[row], pattern)]
        yield lo, found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id_col, spans): for each row the list of (kind, start, end) found in its whole text, by start and then by rule.

    Offsets are code points, the end exclusive. Null and empty texts have no spans; rows that repeat come out once each;
    other columns are ignored; an empty table gives an empty one.
    """

    def work(batches):
        for batch in batches:
            for lo, found in _found(batch.column(1), rules):
                spans = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in sorted(f)] for f in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(found)), pa.array(spans, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a checksum of their spans, and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select(id_col, *(of(r.kind) for r in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows in which a secret was found."""
    hits = found.filter(F.size("spans") > 0).select(id_col).distinct()
    return docs.join(hits, id_col, "left_anti")


def clean_rows(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs without the rows whose own text holds a secret; ids play no part."""

    def clean(batches):
        for batch in batches:
            stays = [not f for _, found in _found(batch.column(text_col), rules) for f in found]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
