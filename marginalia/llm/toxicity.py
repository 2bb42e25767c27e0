"""Toxicity of texts by a convolutional classifier over hashed word embeddings, trained in numpy.

A word's hash picks a row of an embedding table. Filters of several widths run over the rows of a text; their answers are
pooled by maximum over windows of words, and over a text's windows by mean and by maximum, so a text is judged alike at any
length. A logistic layer turns the pooled answers into a logit. What logit counts as toxic is calibrated for each
language, which is told from the text by the profiles of langid and never read from a column.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from marginalia.llm import langid, storage, textbytes as tb

WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 8
BUCKETS, WINDOW = 1 << 18, 128
#: Characters and texts for each label of the sample that the network starts from, and the longest text in it.
CHARS, TEXTS, LONGEST = 6_000_000, 20_000, 1_000_000
EPOCHS, BATCH, RATE = 2, 32, 0.1
#: Rounds over all labelled texts but the calibrating ones after that, and about how many characters a shard of them has.
ROUNDS, SHARD = 1, 16_000_000
#: Share of the labelled texts that calibrates, and how many toxic texts of a language count as much as those of all languages.
CALIBRATE, SHRINK = 5, 20
_PAD = BUCKETS  # the row after the last bucket: no word
_SPAN = 1 << 16  # words that are convolved at once
_UNIT, _BINS, _FAR = 1 << 24, 256, 64  # steps in which shards' changes are added up, bins of a logit and its bound for these


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all texts, and the texts' places in that list."""
    data, offsets = tb.column_bytes(column)
    words, places = tb.word_hashes(data, offsets, tb.ALNUM, tb.FOLDED)
    return (words & np.uint64(BUCKETS - 1)).astype(np.int32), places


class Network:
    """The classifier: an embedding table, filters, and the output layer over two poolings of each filter."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        self.table[_PAD] = 0
        self.filters = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.1, 2 * len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def answers(self, words: np.ndarray) -> np.ndarray:
        """The answer of every filter from each word on; words past the end are none."""
        rows = self.table[np.append(words, np.full(max(WIDTHS) - 1, _PAD, np.int32))]
        n, parts = len(words), []
        for k, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            out = rows[:n] @ w[0]
            for j in range(1, k):
                out += rows[j : j + n] @ w[j]
            parts.append(out + b)
        return np.concatenate(parts, axis=1)

    def pooled(self, words: np.ndarray) -> np.ndarray:
        """The two poolings of one text of any length: mean and maximum of its windows' maxima; zero without words."""
        width = len(WIDTHS) * FILTERS
        if not len(words):
            return np.zeros(2 * width, np.float32)
        total, top, windows = np.zeros(width), np.full(width, -np.inf, np.float32), 0
        for lo in range(0, len(words), _SPAN):  # a multiple of WINDOW
            beyond = words[lo : lo + _SPAN + max(WIDTHS) - 1]
            answers = self.answers(beyond)[: min(_SPAN, len(words) - lo)]
            maxima = np.maximum.reduceat(answers, np.arange(0, len(answers), WINDOW))
            total += maxima.sum(0)
            top = np.maximum(top, maxima.max(0))
            windows += len(maxima)
        return np.concatenate([(total / windows).astype(np.float32), top])

    def logits(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """One logit a text; the texts' words stand one after the other."""
        out = np.zeros((len(places) - 1, 2 * len(WIDTHS) * FILTERS), np.float32)
        lo, n = 0, len(places) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(places, places[lo] + _SPAN, "right")) - 1)
            if hi == lo + 1:
                out[lo] = self.pooled(words[places[lo] : places[hi]])
            else:
                flat, firsts, starts, owner = _windows(words, places[lo : hi + 1])
                if len(starts):
                    maxima = _maxima(self.answers(flat), starts, firsts[owner + 1] - (max(WIDTHS) - 1))
                    out[lo:hi] = _pool(maxima, owner, hi - lo)
            lo = hi
        return out @ self.out + self.shift


def _windows(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a gap of no words behind each, their first places there, the windows' starts and their texts."""
    gap, size = max(WIDTHS) - 1, np.diff(places)
    firsts = np.append(0, np.cumsum(size + gap))
    flat = np.full(int(firsts[-1]), _PAD, np.int32)
    row = np.repeat(np.arange(len(size)), size)
    flat[np.arange(int(size.sum())) + (firsts[:-1] - (places[:-1] - places[0]))[row]] = words[places[0] : places[-1]]
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return flat, firsts, firsts[owner] + number * WINDOW, owner


def _maxima(answers: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The maximum of each window; stops are the ends of the windows' texts."""
    ends = np.minimum(starts + WINDOW, stops)
    edges = np.stack([starts, np.minimum(ends, len(answers) - 1)], axis=1).ravel()
    return np.maximum.reduceat(answers, edges)[::2]


def _pool(maxima: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 2 * maxima.shape[1]), np.float32)
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    out[owner[at]] = np.concatenate([np.add.reduceat(maxima, at) / np.diff(np.append(at, len(owner)))[:, None], np.maximum.reduceat(maxima, at)], axis=1)
    return out


def _odds(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Smoothed log odds of buckets that held texts of each label hold, of sizes texts; those in few texts are drawn to zero."""
    share = (held + 0.5) / (sizes[:, None] + 1.0)
    return np.log(share[1] / share[0]) * np.minimum(1, held.sum(0) / 8)


def _first(net: Network, held: np.ndarray, sizes: np.ndarray) -> None:
    """One coordinate of each embedding starts at the smoothed log odds of its bucket; buckets never met stay at zero.

    held are the texts of each label that hold a bucket, sizes those of each label.
    """
    net.table[:BUCKETS, 0] = _odds(held, sizes)
    net.table[:BUCKETS][held.sum(0) == 0] = 0
    for w in net.filters:
        w[:, 0, : FILTERS // 2] = np.abs(w[:, 0, : FILTERS // 2])
    net.out[:] = np.abs(net.out) * np.sign(np.tile(np.concatenate([w.sum(0)[0] for w in net.filters]), 2))


def _holding(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The texts of each label that hold each bucket."""
    held = np.zeros((2, BUCKETS), np.int64)
    for words, label in zip(texts, labels, strict=True):
        held[int(label), np.unique(words)] += 1
    return held


def _best(net: Network, flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in each window each filter answers most, and these answers; about _SPAN words at once."""
    best, maxima, lo = [], [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _SPAN)))
        answers = net.answers(flat[starts[lo] : stops[hi - 1] + max(WIDTHS) - 1])
        first = int(starts[lo])
        at = np.stack([a - first + answers[a - first : b - first].argmax(0) for a, b in zip(starts[lo:hi].tolist(), stops[lo:hi].tolist(), strict=True)])
        best.append(at + first)
        maxima.append(np.take_along_axis(answers, at, 0))
        lo = hi
    return np.concatenate(best), np.concatenate(maxima)


def _epoch(net: Network, squares: list[np.ndarray], texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int, rate: float) -> None:
    """Once over the texts, none of them without words, in batches, by Adagrad."""

    def step(at: int, values: np.ndarray, gradient: np.ndarray) -> None:
        squares[at] += gradient * gradient
        values -= rate * gradient / np.sqrt(squares[at])

    sizes = np.array([len(t) for t in texts])
    order = rng.permutation(len(texts))
    ends = np.unique(np.append(np.searchsorted(np.cumsum(sizes[order]), np.arange(0, sizes.sum(), batch * 256), "right"), np.append(np.arange(0, len(order), batch), len(order))))
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        mine = order[lo:hi]
        places = np.append(0, np.cumsum(sizes[mine]))
        flat, firsts, starts, owner = _windows(np.concatenate([texts[i] for i in mine]), places)
        stops = np.minimum(starts + WINDOW, firsts[owner + 1] - (max(WIDTHS) - 1))
        best, maxima = _best(net, flat, starts, stops)
        both = _pool(maxima, owner, len(mine))
        p = 1 / (1 + np.exp(-np.clip(both @ net.out + net.shift, -30, 30)))
        d = ((p - labels[mine]) * weight[mine] / len(mine)).astype(np.float32)
        width = maxima.shape[1]
        windows = np.bincount(owner, minlength=len(mine))
        back = d[owner, None] * net.out[:width] / windows[owner, None]  # of the mean
        first = np.searchsorted(owner, np.arange(len(mine)))
        top = first[:, None] + np.stack([maxima[a : a + c].argmax(0) for a, c in zip(first.tolist(), windows.tolist(), strict=True)])
        back[top, np.arange(width)] += d[:, None] * net.out[width:]
        grads = [np.zeros_like(w) for w in net.filters]
        touched, pushes = [], []
        for i, k in enumerate(WIDTHS):
            at, g = best[:, i * FILTERS : (i + 1) * FILTERS], back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(k):
                words = flat[np.minimum(at + j, len(flat) - 1)]
                grads[i][j] = np.einsum("nfd,nf->df", net.table[words], g)
                touched.append(words.ravel())
                pushes.append((g[:, :, None] * net.filters[i][j].T[None]).reshape(-1, DIM))
        rows, where = np.unique(np.concatenate(touched), return_inverse=True)
        push = np.zeros((len(rows), DIM), np.float32)
        np.add.at(push, where, np.concatenate(pushes))
        push[rows == _PAD] = 0
        squares[0][rows] += push * push
        net.table[rows] -= rate * push / np.sqrt(squares[0][rows])
        for i, g in enumerate(grads):
            step(1 + i, net.filters[i], g)
        step(-3, net.bias, back.sum(0).reshape(net.bias.shape))
        step(-2, net.out, both.T @ d)
        step(-1, net.shift, d.sum(keepdims=True))


def _weights(labels: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weights by which both labels count the same, sizes being the texts of each."""
    return (0.5 * sizes.sum() / np.maximum(1, sizes))[labels.astype(int)].astype(np.float32)


def fit_network(texts: list[np.ndarray], labels: np.ndarray, *, held: np.ndarray | None = None, sizes: np.ndarray | None = None, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> Network:
    """Train on lists of word buckets with labels 0 and 1, by Adagrad on batches in which both labels weigh the same.

    The gradient of a maximum goes to the place that it was taken from, so a step touches few rows of the table. The embeddings
    start from held and sizes, the texts of each label that hold a bucket and all of each label, where these are given.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    texts, labels = [t for t in texts if len(t)], np.array([y for t, y in zip(texts, labels, strict=True) if len(t)], np.float32)
    net.squares = [np.full_like(x, 1e-4) for x in (net.table, *net.filters, net.bias, net.out, net.shift)]
    if not len(texts) or labels.min() == labels.max():
        net.out[:] = 0
        return net
    own = np.array([(labels == 0).sum(), (labels == 1).sum()])
    _first(net, *((_holding(texts, labels), own) if held is None else (held, sizes)))
    for _ in range(epochs):
        _epoch(net, net.squares, texts, labels, _weights(labels, own), rng, batch, rate)
    return net


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Shard, texts with words and labels of rows (shard, label, words) in which a shard's rows stand together."""
    shard, texts, labels = None, [], []
    for batch in batches:
        lists = batch.column(2)
        places, flat = lists.offsets.to_numpy(), np.asarray(lists.values)
        for n, label, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
            if n != shard and texts:
                yield shard, texts, np.array(labels, np.float32)
                texts, labels = [], []
            shard = n
            if b > a:
                texts.append(flat[a:b])
                labels.append(label)
    if texts:
        yield shard, texts, np.array(labels, np.float32)


def _counted(learned: DataFrame) -> np.ndarray:
    """The texts of each label that hold each bucket, of rows (shard, label, words)."""

    def work(batches):
        held = np.zeros((2, BUCKETS), np.int64)
        for _, texts, labels in _shards(batches):
            held += _holding(texts, labels)
        at = np.flatnonzero(held.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[0, at]), pa.array(held[1, at])], ["k", "n0", "n1"])

    rows = learned.mapInArrow(work, "k int, n0 long, n1 long").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # BUCKETS rows at most
    held = np.zeros((2, BUCKETS), np.int64)
    for i in (0, 1):
        held[i, rows.column("k").to_numpy()] = rows.column(f"n{i}").to_numpy()
    return held


def _small(net: Network) -> np.ndarray:
    """All parameters but the table, in rows as wide as the table's."""
    flat = np.concatenate([x.ravel() for x in (*net.filters, net.bias, net.out, net.shift)])
    return np.append(flat, np.zeros(-len(flat) % DIM, np.float32)).reshape(-1, DIM)


def _round(net: Network, learned: DataFrame, sizes: np.ndarray, seed: int) -> None:
    """One epoch over all of learned (shard, label, words): each shard goes on from net by itself, then net takes the mean of their
    changes, by texts and, for a row of the table, of the shards that changed it. Changes are added up as whole numbers, so
    in any order alike."""
    shared, names = learned.sparkSession.sparkContext.broadcast(net), [f"v{i}" for i in range(DIM)]

    def work(batches):
        for shard, texts, labels in _shards(batches):
            own = copy.deepcopy(shared.value)
            _epoch(own, own.squares, texts, labels, _weights(labels, sizes), np.random.default_rng([seed, shard]), BATCH, RATE)
            change = np.concatenate([own.table, _small(own)]) - np.concatenate([shared.value.table, _small(shared.value)])
            at = np.flatnonzero(change.any(1))
            units = np.rint(change[at].astype(np.float64) * len(texts) * _UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), len(texts), np.int64)), *map(pa.array, np.ascontiguousarray(units.T))], ["k", "w", *names])

    changes = learned.mapInArrow(work, "k int, w long, " + ", ".join(f"{x} long" for x in names))
    rows = changes.groupBy("k").agg(*[F.sum(x).alias(x) for x in ("w", *names)]).toArrow()  # a row for each of the table's, and some
    whole = np.concatenate([net.table, _small(net)]).astype(np.float64)
    whole[rows.column("k").to_numpy()] += np.stack([rows.column(x).to_numpy() for x in names], 1) / rows.column("w").to_numpy()[:, None] / _UNIT
    net.table, flat = whole[: BUCKETS + 1].astype(np.float32), whole[BUCKETS + 1 :].astype(np.float32).ravel()
    lo = 0
    for x in (*net.filters, net.bias, net.out, net.shift):
        x[:] = flat[lo : lo + x.size].reshape(x.shape)
        lo += x.size
    shared.unpersist()


class Classifier:
    """A trained network, the languages' profiles, and the logit that counts as toxic in each language."""

    def __init__(self, network: Network, languages: langid.Model, thresholds: dict[str, float], general: float):
        self.network, self.languages, self.thresholds, self.general = network, languages, thresholds, general

    def scores(self, column: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """Runs of texts: the first one's row, the languages told and the scores."""
        for at, lang, _ in langid._languages(column, self.languages):
            part = column.slice(at, len(lang))
            logit = self.network.logits(*word_buckets(part)).astype(np.float64)
            logit -= np.array([self.thresholds.get(x or "und", self.general) for x in lang])
            yield at, [x or "und" for x in lang], 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the labels with the best F1, in the middle of the gap it lies in; 0 where a label is missing."""
    return _cut(logits, logits, labels, np.ones(len(labels), np.int64))


def _cut(low: np.ndarray, top: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """threshold() of groups of texts that stay together: their least and greatest logits, the toxic ones among them, their number."""
    if not len(n) or toxic.sum() in (0, n.sum()):
        return 0.0
    order = np.argsort(-top, kind="stable")
    low, top, toxic, n = low[order], top[order], toxic[order], n[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    f1[:-1][low[:-1] == top[1:]] = -1  # no cut between equal logits
    at = int(f1.argmax())
    return float((low[at] + top[at + 1]) / 2 if at + 1 < len(n) else low[at] - 1)


def _thresholds(network: Network, languages: langid.Model, rest: DataFrame) -> tuple[dict[str, float], float]:
    """The logits that count as toxic in each language and in general, of all of rest (label, lang, words).

    Logits are counted in bins of 1 / _BINS, of which the least and the greatest are kept.
    """
    shared = rest.sparkSession.sparkContext.broadcast(network)

    def work(batches):
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            logit = shared.value.logits(np.asarray(lists.values), offsets).astype(np.float64)
            spot = np.floor(np.clip(logit, -_FAR, _FAR) * _BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spot), pa.array(logit)], ["label", "lang", "spot", "logit"])

    logits = rest.mapInArrow(work, "label int, lang string, spot int, logit double")
    rows = logits.groupBy("lang", "spot").agg(F.min("logit").alias("low"), F.max("logit").alias("top"), F.sum("label").alias("toxic"), F.count("*").alias("n")).toArrow()  # of languages by bins
    low, top, toxic, n = (rows.column(x).to_numpy() for x in ("low", "top", "toxic", "n"))
    lang, spot = np.array(rows.column("lang").to_pylist(), object), rows.column("spot").to_numpy()
    _, whose = np.unique(spot, return_inverse=True)
    count = int(whose.max()) + 1 if len(whose) else 0
    least, most, hits, number = np.full(count, np.inf), np.full(count, -np.inf), np.zeros(count, np.int64), np.zeros(count, np.int64)
    np.minimum.at(least, whose, low)
    np.maximum.at(most, whose, top)
    np.add.at(hits, whose, toxic)
    np.add.at(number, whose, n)
    general, found = _cut(least, most, hits, number), {}
    for x in sorted(set(lang)):
        mine = lang == x
        most_toxic = int(toxic[mine].sum())
        found[str(x)] = (most_toxic * _cut(low[mine], top[mine], toxic[mine], n[mine]) + SHRINK * general) / (most_toxic + SHRINK)
    return found, general


def train(docs: DataFrame, labels: DataFrame, languages: langid.Model, label_col: str = "label", text_col: str = "text", id_col: str = "doc_id", *, chars: int = CHARS, texts: int = TEXTS, longest: int = LONGEST, shard: int = SHARD) -> Classifier:
    """Fit on all labelled texts, whole: the buckets' log odds, ROUNDS epochs of the network in shards of about so many characters,
    whose changes are averaged, and the languages' thresholds, which a fifth of the texts calibrates and is learned from afterwards.

    The network only starts from a sample at the driver, of about so many characters and texts of each label 0 and 1 (all, where
    there are fewer), none over longest characters, taken by a hash of id and text. docs without a label (or with a
    null text or id) are left out, an id with both labels is toxic, rows that repeat id and text count once. Without texts of both
    labels every score is 0.5. Texts are joined with their labels as word buckets, 4 bytes a word, and written once.
    """

    def buckets(batches):
        for batch in batches:
            for lo, hi in tb.row_spans(tb.column_bytes(batch.column(1))[1], 16 * tb.PIECE):
                part = batch.slice(lo, hi - lo)
                column, told = part.column(1), np.full(hi - lo, None, object)
                calibrates = np.flatnonzero(part.column(3).to_numpy() == 0)
                few = column.take(pa.array(calibrates))
                for at, lang, _ in langid._languages(few, languages):
                    told[calibrates[at : at + len(lang)]] = [x or "und" for x in lang]
                words, places = word_buckets(column)
                lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(told.tolist(), pa.string()), lists], ["id", "h", "fold", "chars", "lang", "words"])

    drawn = lambda what: F.pmod(F.xxhash64("id", "h", F.lit(what)), F.lit(1 << 32))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).filter(F.col("text").isNotNull() & F.col("id").isNotNull())
    size = rows.agg(F.sum(F.length("text")).alias("chars")).first().chars or 0
    cut = rows.select("id", "text", "h", (drawn("fold") % CALIBRATE).cast("int").alias("fold"), F.length("text").cast("long").alias("chars")).mapInArrow(buckets, "id long, h long, fold int, chars long, lang string, words array<int>")
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    n = max(1, -(-size // shard))
    both = cut.repartition(n, "id").join(marks.repartition(n, "id").hint("merge"), "id").dropDuplicates(["id", "h"])
    known = storage.written(both.withColumn("shard", F.spark_partition_id()).sortWithinPartitions("id", "h"), "labelled")
    every = known.select("shard", "label", "words")
    learned = known.filter("fold > 0").select("shard", "label", "words")
    sums = {r.label: r for r in known.groupBy("label").agg(F.sum(F.when(F.col("chars") <= longest, F.col("chars"))).alias("chars"), F.count_if(F.col("chars") <= longest).alias("n"), F.count_if((F.col("fold") > 0) & (F.size("words") > 0)).alias("learned"), F.count_if(F.size("words") > 0).alias("every")).collect()}  # two rows
    sizes, most = (np.array([sums[y][name] if y in sums else 0 for y in (0, 1)]) for name in ("learned", "every"))
    rest = known.filter("fold = 0").select("label", "lang", "words")
    if not sizes.all():
        network, found, general = fit_network([], np.zeros(0)), {}, 0.0
    else:
        shares = {y: min(1.0, chars / max(1, r.chars or 0), texts / max(1, r.n)) for y, r in sums.items()}
        share = F.when(F.col("label") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
        sample = known.filter((F.col("fold") > 0) & (F.col("chars") <= longest) & (drawn("sample") < share * (1 << 32))).select("id", "h", "label", "words").toArrow()
        sample = sample.take(pc.sort_indices(sample, [("id", "ascending"), ("h", "ascending")]))  # in one order, whatever the partitions
        held = _counted(learned)
        network = fit_network([np.asarray(x.values) for x in sample.column("words")], sample.column("label").to_numpy(), held=held, sizes=sizes)
        for seed in range(ROUNDS):
            _round(network, learned, sizes, seed)
        found, general = _thresholds(network, languages, rest)
        network.table[:BUCKETS, 0] += (_odds(_counted(every), most) - _odds(held, sizes)).astype(np.float32)
        _round(network, every, most, ROUNDS)  # what has calibrated is learned from as well
    network.squares = []
    storage.dropped(known)
    return Classifier(network, languages, found, general)


def score_texts(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_told, score, predicted): the toxicity of every whole text from 0 to 1; predicted is 1 from 0.5 on.

    A null or empty text, or one without a word, has the score of no words. Rows that repeat come out once each, null ids
    as well; ties have equal scores; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # of fixed size: the embedding table

    def work(batches):
        own = shared.value
        for batch in batches:
            for at, lang, score in own.scores(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lang)), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_told", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(work, "id long, lang_told string, score double")
    return out.select(F.col("id").alias(id_col), "lang_told", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are never learned: a fifth, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
