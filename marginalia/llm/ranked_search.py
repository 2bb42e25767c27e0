"""Ranked lexical search: an inverted index in shards of documents, searched by WAND.

The index is a table with a row for each shard: the terms (64-bit hashes of their bytes) with the places and counts of
their documents, and the documents with their lengths. It is written once, in one pass over the texts and without a
shuffle. A search reads it twice: once for the document frequencies of the queries' terms, once to search each shard.

WAND in a shard: each term of a query has a cursor in its postings and a maximum impact there, the most that it adds to any
score. Cursors go on by runs of documents. A document is a pivot if the maxima of the terms found in it exceed the score
of the heap's last document; only pivots are scored, all others are skipped, and so is a run at once if the maxima of all
terms found in it don't get there. The pivots of a run are selected together, in numpy: with a step of Python for each pivot a
shard of 25 MB took 50 ms a query, this takes a few. A task keeps one merged heap for each query, whose threshold carries
over to its next shard; the tasks' heaps are merged last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marginalia.llm import textbytes as tb
from marginalia.llm.storage import written

#: Bytes of text in a shard (or one longer document), and terms of queries that are searched at once (or one longer query).
SHARD_BYTES, BLOCK_TERMS = 16 << 20, 1 << 20
SCALE = 1_000_000_000

#: Documents scored before a shard is searched, for a threshold to begin with; documents of a run.
FIRST, RUN = 256, 2048

#: Columns of a shard's row. ids, known (not null) and lengths: its documents; terms and counts: its terms, and the documents
#: that hold each; places and times: those documents' numbers in the shard, and how often the term stands in them.
_KINDS = {"ids": np.int64, "known": np.bool_, "lengths": np.int64, "terms": np.uint64, "counts": np.int32, "places": np.int32, "times": np.int32}
_SCHEMA = "docs long, words long, " + ", ".join(f"{name} binary" for name in _KINDS)


def _index_shard(ids: pa.Array, words: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """One row: documents in ascending id (null ids last), distinct terms with the documents that hold them and how often."""
    given = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((given, null))
    lengths = np.diff(places)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    by = np.argsort(words, kind="stable")
    doc = np.repeat(rank, lengths)[by]
    words = words[by]
    fresh = np.append(True, words[1:] != words[:-1]) if len(words) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    by = np.argsort(group * len(lengths) + doc, kind="stable") if len(words) else group
    doc, group = doc[by], group[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])) if len(words) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(words))).astype(np.int32)
    terms = words[fresh]
    counts = np.bincount(group[at], minlength=len(terms)).astype(np.int32)
    arrays = (given[order], ~null[order], lengths[order].astype(np.int64), terms, counts, doc[at].astype(np.int32), times)
    row = [pa.array([int((lengths > 0).sum())]), pa.array([len(words)]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
    return pa.RecordBatch.from_arrays(row, ["docs", "words", *_KINDS])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs, a written table with one row for each shard; every row is a document of its own.

    Terms are the runs of ASCII letters and digits and of all characters outside ASCII, with A-Z in lower case. Null and
    empty texts have none. Ids may be null or repeat; an empty table gives an empty index.
    """

    def work(batches):
        ids, words, sizes, size = [], [], [], 0
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            for lo, hi in tb.row_spans(offsets, shard_bytes):
                h, places = tb.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], tb.ALNUM, tb.FOLDED)
                more = int(offsets[hi] - offsets[lo])
                if size and size + more > shard_bytes:
                    yield _index_shard(pa.concat_arrays(ids), np.concatenate(words), np.append(0, np.cumsum(np.concatenate(sizes))))
                    ids, words, sizes, size = [], [], [], 0
                ids.append(batch.column(0).slice(lo, hi - lo))
                words.append(h)
                sizes.append(np.diff(places))
                size += more
        if ids:
            yield _index_shard(pa.concat_arrays(ids), np.concatenate(words), np.append(0, np.cumsum(np.concatenate(sizes))))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # small row groups: a reader holds one at a time
    return written(rows.mapInArrow(work, _SCHEMA), "postings", **{"parquet.block.size": 2 * shard_bytes, "compression": "zstd"})


def _rows(batches) -> Iterator[dict[str, np.ndarray]]:
    """Shards one by one, as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: np.frombuffer(batch.column(at)[i].as_buffer(), _KINDS[name]) for at, name in enumerate(batch.schema.names)}


def _find(terms: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted hashes stand among a shard's terms, and where."""
    at = np.searchsorted(terms, vocabulary)
    here = np.flatnonzero(at < len(terms))
    here = here[terms[at[here]] == vocabulary[here]]
    return here, at[here]


def weight(df: int, n: int) -> int:
    """A term's weight; df of n documents hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def saturations(times: np.ndarray, lengths: np.ndarray, n: int, words: int) -> np.ndarray:
    """What a term's weight is multiplied by: times it stands in a document of so many words; n documents have words in all."""
    most = 90 * n * int(lengths.max(initial=0))
    part = 90 * lengths * n // words if most < 1 << 63 else np.array([90 * x * n // words for x in lengths.tolist()], np.int64)
    return SCALE * times // (1000 * times + 8 * (10 + part))


def wand(lists: list[tuple[np.ndarray, np.ndarray, int]], k: int, floor: int = 1, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents by falling score and rising place; those under floor aren't asked for.

    lists: of each term the ascending places of its documents, the term's impact on each, and the largest of these.
    """
    heap_at, heap_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    over = floor - 1  # a document must score more; places ascend, so a later equal one doesn't get in
    edges = np.arange(0, max((int(places[-1]) for places, *_ in lists), default=-1) + 1 + run, run)
    cursors = [np.searchsorted(places, edges).tolist() for places, *_ in lists]
    for r, lo in enumerate(edges[:-1].tolist()):
        here = [(t, c[r], c[r + 1]) for t, c in enumerate(cursors) if c[r] < c[r + 1]]
        if sum(lists[t][2] for t, *_ in here) <= over:
            continue  # no document of the run can be a pivot
        at = np.concatenate([lists[t][0][a:b] for t, a, b in here]) - lo
        bound = np.zeros(run, np.int64)
        np.add.at(bound, at, np.repeat(np.array([lists[t][2] for t, *_ in here]), [b - a for _, a, b in here]))
        pivots = bound > over
        if not pivots.any():
            continue
        stands = pivots[at]
        score = np.zeros(run, np.int64)
        np.add.at(score, at[stands], np.concatenate([lists[t][1][a:b] for t, a, b in here])[stands])
        better = np.flatnonzero(score > over)
        heap_at, heap_score = np.append(heap_at, better + lo), np.append(heap_score, score[better])
        best = np.lexsort((heap_at, -heap_score))[:k]
        heap_at, heap_score = heap_at[best], heap_score[best]
        if len(heap_at) == k:
            over = max(over, int(heap_score[-1]))
    return heap_at, heap_score


def first_floor(lists: list[tuple[np.ndarray, np.ndarray, int]], k: int, some: int = FIRST) -> int:
    """A score that k documents reach: the k-th best among some documents on which the strongest terms have most impact."""
    picked, size = [], 0
    for places, impacts, _ in sorted(lists, key=lambda x: -x[2]):
        best = np.argpartition(-impacts, k)[:k] if len(impacts) > k else slice(None)
        picked.append(places[best])
        size += len(picked[-1])
        if size >= some:
            break
    some_docs = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
    if len(some_docs) < k:
        return 1
    scores = np.zeros(len(some_docs), np.int64)
    for places, impacts, _ in lists:
        at = np.minimum(np.searchsorted(places, some_docs), len(places) - 1)
        scores += np.where(places[at] == some_docs, impacts[at], 0)
    return max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))


class _Block:
    """Queries that are searched at once: their names, their distinct terms (sorted) and weights, and each query's terms."""

    def __init__(self, names: list, terms: list[np.ndarray]):
        self.names = names
        self.vocabulary = np.unique(np.concatenate(terms))
        self.terms = [np.searchsorted(self.vocabulary, t) for t in terms]
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def best(self, shard: dict[str, np.ndarray], heaps: list[list[tuple]], k: int, n: int, words: int) -> None:
        """Merge what a shard has for each query into heaps: sorted lists of (-score, id is null, id)."""
        here, at = _find(shard["terms"], self.vocabulary)
        ends = np.cumsum(shard["counts"], dtype=np.int64)
        slot = np.full(len(self.vocabulary), -1)
        slot[here] = np.arange(len(here))
        cut: list[tuple | None] = [None] * len(here)

        def postings(i: int) -> tuple[np.ndarray, np.ndarray, int]:
            if cut[i] is None:
                lo, hi = int(ends[at[i]] - shard["counts"][at[i]]), int(ends[at[i]])
                places = shard["places"][lo:hi]
                impacts = self.weights[here[i]] * saturations(shard["times"][lo:hi].astype(np.int64), shard["lengths"][places], n, words)
                cut[i] = places, impacts, int(impacts.max())
            return cut[i]

        for q, terms in enumerate(self.terms):
            lists = [x for x in (postings(i) for i in slot[terms].tolist() if i >= 0) if x[2] > 0]
            floor = first_floor(lists, k)
            if len(heaps[q]) == k:
                floor = max(floor, -heaps[q][-1][0])
            places, scores = wand(lists, k, floor)
            if len(places):
                found = zip((-scores).tolist(), (~shard["known"][places]).tolist(), shard["ids"][places].tolist(), strict=True)
                heaps[q] = sorted([*heaps[q], *found])[:k]


def _blocks(queries: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[_Block]:
    """Blocks of queries that have a term; the driver holds a block and a partition's terms at a time."""

    def distinct(batches):
        for batch in batches:
            words, places = tb.word_hashes(*tb.column_bytes(batch.column(1)), tb.ALNUM, tb.FOLDED)
            own = [np.unique(words[a:b]).tobytes() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["id", "terms"]).filter(pa.array([len(x) > 0 for x in own], pa.bool_()))

    names, lists, size = [], [], 0
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for r in rows.mapInArrow(distinct, "id long, terms binary").toLocalIterator():
        own = np.frombuffer(r.terms, np.uint64)
        if size and size + len(own) > most:
            yield _Block(names, lists)
            names, lists, size = [], [], 0
        names.append(r.id)
        lists.append(own)
        size += len(own)
    if names:
        yield _Block(names, lists)


def _weigh(index: DataFrame, block: _Block, n: int) -> None:
    """Give the block's terms weights by the documents that hold them, added up over the shards."""
    vocabulary = index.sparkSession.sparkContext.broadcast(block.vocabulary)  # block_terms hashes at most, or one query's

    def held(batches):
        total = np.zeros(len(vocabulary.value), np.int64)
        for shard in _rows(batches):
            here, at = _find(shard["terms"], vocabulary.value)
            total[here] += shard["counts"][at]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    found = index.select("terms", "counts").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    for term, df in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        block.weights[term] = weight(df, n)
    vocabulary.unpersist()


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", *, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(id_col, rank, doc_id, score): the k best documents of an index for each row of queries.

    Rank counts from 1; equal scores go by ascending doc_id, null ids last. Documents that score 0 don't count, so a query
    without a term (null, empty or nothing but signs), or with none that is rarer than the rule of weights asks, has no rows,
    nor has any on an empty index. Queries that repeat come out once each; other columns are ignored. Long
    queries are searched whole.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    out = spark.createDataFrame([], "query long, name long, doc_id long, score long")
    start = 0
    for block in _blocks(queries, id_col, text_col, block_terms) if total.words else ():
        _weigh(index, block, total.n)
        out = out.unionByName(_searched(index, block, k, total.n, total.words, start))
        start += len(block.names)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("name").alias(id_col), "rank", "doc_id", "score")


def _searched(index: DataFrame, block: _Block, k: int, n: int, words: int, start: int) -> DataFrame:
    """(query, name, doc_id, score): the merged heaps of each task."""
    shared = index.sparkSession.sparkContext.broadcast(block)  # block_terms hashes at most, or one query's

    def work(batches):
        own = shared.value
        heaps: list[list[tuple]] = [[] for _ in own.names]
        for shard in _rows(batches):
            own.best(shard, heaps, k, n, words)
        rows = [(start + q, own.names[q], None if null else doc, -score) for q, heap in enumerate(heaps) for score, null, doc in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query", "name", "doc_id", "score"])

    return index.select(*_KINDS).mapInArrow(work, "query long, name long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best of docs (doc_id, text) for each of queries (item_id, text), through an index that is built for it.

    The index stays until the session's folder of intermediate tables is cleared, since the result reads it.
    """
    return search(build_index(docs), queries, k)
