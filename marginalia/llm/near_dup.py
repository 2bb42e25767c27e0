"""Near-duplicate texts: fast similarity sketches, banding, exact verification.

The sketch is the one of Dahlgaard, Knudsen and Thorup ("Fast Similarity Sketching", FOCS 2017). In round i < t every
element of a set is hashed to one of t bins and offers the value i + v, in round t + j every element goes to bin j; a bin
keeps its least value, and the rounds end once all bins are filled. All t coordinates are filled after 2 t rounds at
most (about t ln t / |set| are expected), two sets agree in a coordinate with a probability of their Jaccard
similarity, and the number of agreeing coordinates is concentrated as with t independent hash functions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm import textbytes as tb
from marginalia.llm.components import connected_components, smallest_ids
from marginalia.llm.runs import forest, runs
from marginalia.llm.storage import dropped, written

WORD_BYTES = ~tb.SPACE
ROWS = 5
#: How likely a pair right at the threshold may share no band key.
MISS = 3e-7
BLOCK_SHINGLES = 500_000
#: What a text counts as at least, so that a block of short texts holds BLOCK_SHINGLES / LEAST_SHINGLES of them at most.
LEAST_SHINGLES = 1000
#: Pairs of blocks that a further round of stars has to be able to save.
ROUND = 4096
_ROUND = np.uint64(0x9FB21C651E98DF25)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """The least number of bands with which a pair at percent shares none of them with a probability of miss at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The t coordinates of each set, one row for each; an empty set gives zeros."""
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    todo = sizes > 0
    items = np.concatenate([*sets, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    for i in range(2 * t):
        if not todo.any():
            break
        h = tb.mix(items ^ np.uint64((i + 1) * int(_ROUND) % (1 << 64)))
        value = (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16))
        place = (h & np.uint64(0xFFFF)).astype(np.int64) * t >> 16 if i < t else np.full(len(items), i - t)
        np.minimum.at(out, row * t + place, value)
        filled = (out.reshape(-1, t) != np.iinfo(np.uint64).max).all(1)
        if (filled & todo).any():
            todo &= ~filled
            stay = todo[row]
            items, row = items[stay], row[stay]
    out[out == np.iinfo(np.uint64).max] = 0
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sketch), np.uint64(b + 1))
        for r in range(rows):
            h = tb.mix(h * _ROUND + sketch[:, b * rows + r])
        keys[:, b] = h
    return keys


def _sets(column: pa.Array, k: int):
    """Batches of shingle sets: (first row, list of sets)."""
    data, offsets = tb.column_bytes(column)
    for lo, hi in tb.row_spans(offsets):
        words, places = tb.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD_BYTES, tb.FOLDED)
        yield list(tb.shingle_sets(words, places, k))


def _list_column(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _prints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sizes of sets and a 128-bit fingerprint of each, in two columns."""
    with np.errstate(over="ignore"):
        fp1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
        fp2 = np.array([tb.mix(s ^ _ROUND).sum(dtype=np.uint64) for s in sets], np.uint64)
    return [np.fromiter(map(len, sets), np.int64, len(sets)), fp1.view(np.int64), fp2.view(np.int64)]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h): h tells texts under one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))


def features(docs: DataFrame, id_col: str, text_col: str, shingle: int, rows: int, bands: int) -> DataFrame:
    """(id, h, n_shingles, fp1, fp2, bands): a hash of the text, its set's size, a 128-bit fingerprint of it, its band keys."""

    def work(batches):
        for batch in batches:
            at = 0
            for sets in _sets(batch.column(1), shingle):
                keys = band_keys(sketches(sets, rows * bands), rows, bands)
                lists = _list_column(keys.ravel(), np.full(len(sets), bands))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), batch.column(2).slice(at, len(sets)), *map(pa.array, _prints(sets)), lists], ["id", "h", "n_shingles", "fp1", "fp2", "bands"])
                at += len(sets)

    return _texts(docs, id_col, text_col).mapInArrow(work, "id long, h long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def full_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(cls, shingles): the sorted distinct shingle hashes of each class, from rows (text, cls, n_shingles, fp1, fp2).

    Texts of another set than their class says are passed over; of several texts of a class a task keeps the first.
    """

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            classes, wanted, at = batch.column(1).to_pylist(), np.stack([c.to_numpy() for c in batch.columns[2:]]), 0
            for sets in _sets(batch.column(0), shingle):
                n = len(sets)
                right = (np.stack(_prints(sets)) == wanted[:, at : at + n]).all(0)
                keep = [i for i in np.flatnonzero(right).tolist() if classes[at + i] not in seen and not seen.add(classes[at + i])]
                chosen = [sets[i] for i in keep]
                sizes = np.fromiter(map(len, chosen), np.int64, len(chosen))
                yield pa.RecordBatch.from_arrays([pa.array([classes[at + i] for i in keep], pa.int64()), _list_column(np.concatenate([*chosen, np.zeros(0, np.uint64)]), sizes)], ["cls", "shingles"])
                at += n

    return texts.select("text", "cls", "n_shingles", "fp1", "fp2").mapInArrow(work, "cls long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs of classes those with 100 |A & B| >= percent |A | B|."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(right, "b").join(left, "a").withColumn("both", both).filter(F.col("both") * (100 + percent) >= F.lit(percent) * (F.size("sa") + F.size("sb"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 85, rows: int = ROWS, bands: int | None = None, stars: int = 2) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row for each row of docs.

    Texts are lower-cased (A-Z), cut into words at white space, and stand as sets of distinct shingles (64-bit hashes). Texts
    with equal sets form a class with a key of its own. Classes that share a band key are candidates; they link if their
    full sets pass percent. Each bucket first compares its members with its smallest one, and those left with the smallest
    of them; this goes on while it shrinks buckets of several blocks and over ROUND pairs of blocks are left. Buckets that are still in several
    components are worked off in pairs of blocks, by matrix products over full sets, which return no more than the
    links that join components. So no link inside a bucket is lost, and no pairs are emitted. Unless bands is given, there are
    as many as leave a pair right at percent without a common key with a probability of MISS at most: 26 at 0.85, 38 at 0.8.

    Every row is a node, whatever its id: rows that repeat an id have the component of their own set. component_id is the
    smallest id of the rows reachable, kept is id = component_id. Null and empty texts have an empty set and link with
    nothing; rows with a null id join no others and keep a null component_id; other columns are ignored; an empty table
    gives an empty one.
    """
    bands = bands or bands_for(percent, rows)
    feats = written(features(docs, id_col, text_col, shingle, rows, bands), "features")
    solid = feats.filter("n_shingles > 0 AND id IS NOT NULL")
    # A written table: keys stay as they are, and the join of all rows with it, at the end, reads two plain shuffles, so that Spark can split a hot class.
    classes = solid.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("id", "h")).alias("rep"), F.any_value("bands").alias("bands"))
    classes = classes.select("fp1", "fp2", "n_shingles", F.col("rep.id").alias("least"), F.col("rep.h").alias("h"), "bands", F.monotonically_increasing_id().alias("cls"))
    classes = written(classes, "classes")
    # a bucket's lead is the class of the smallest id: of copies that came one after the other the likely original
    keyed = classes.select("cls", "least", "n_shingles", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min_by("cls", "least").alias("lead"), F.count("*").alias("m")).filter("m > 1").select("key", "lead")
    buckets = written(keyed.join(shared, "key").select("key", "cls", "least", "n_shingles", "lead"), "buckets")

    touched = classes.join(buckets.select("cls").distinct(), "cls").select("cls", "fp1", "fp2", "n_shingles", F.col("least").alias("id"), "h")
    sets = written(full_sets(_texts(docs, id_col, text_col).join(touched, ["id", "h"]), shingle), "sets")

    links, label, mixed, left = None, None, None, math.inf
    while True:
        if label is None:
            pairs = buckets.filter("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b"))
        else:  # the members outside their lead's component meet the smallest of them
            apart = _apart(buckets, label).filter("comp <> lead_comp").select("key", "cls", "least")
            second = written(apart.groupBy("key").agg(F.min_by("cls", "least").alias("second")), "second")  # written, so that a hot bucket can be split in the join
            pairs = apart.join(second, "key").filter("cls <> second").select(F.least("second", "cls").alias("a"), F.greatest("second", "cls").alias("b"))
        links, label = _grown(links, _verified(pairs.distinct(), sets, percent), label)
        stars -= 1
        if stars > 0:
            continue
        dropped(mixed)
        apart = _apart(buckets, label)
        mixed = apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.greatest("n_shingles", F.lit(LEAST_SHINGLES))).alias("size")).filter("lo < hi")
        mixed = written(mixed.select("key", F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("blocks")), "mixed")
        now = mixed.filter("blocks > 1").agg(F.coalesce(F.sum(F.expr("blocks * (blocks + 1L) / 2")), F.lit(0.0))).first()[0]
        if now <= ROUND or now > 0.9 * left:
            break
        left = now
    rest = apart.join(mixed, "key")
    rest = rest.select("key", "cls", "comp", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rest = rest.select("key", "cls", "comp", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(sets, "cls")
    rest = rest.select("key", "i", "j", "mine", "cls", "comp", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls")
    links, label = _grown(links, rest.mapInArrow(_block_links(percent), "a long, b long").distinct(), label)

    found = classes.join(smallest_ids(label, classes), "cls", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component_id", "least").alias("component_id"))
    out = feats.select("id", "fp1", "fp2", "n_shingles").join(found, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))
    for table in (sets, buckets, mixed, links):
        dropped(table)
    return out


def _block_links(percent: int):
    """Links between different components among the rows of a bucket, or of two blocks of one."""

    def work(batches):
        for table in runs(batches, ("key", "i", "j")):
            ids, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
            left = table.column("mine").to_numpy() == table.column("i")[0].as_py()
            a = np.flatnonzero(left)
            b = a if left.all() else np.flatnonzero(~left)
            if len(a) and len(b) and (comp[a].min() != comp[b].max() or comp[a].max() != comp[b].min()):
                lists = table.column("shingles").combine_chunks()
                both, sizes = _overlaps(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), a, b)
                x, y = np.nonzero((both * (100 + percent) >= percent * (sizes[a][:, None] + sizes[b][None, :])) & (comp[a][:, None] != comp[b][None, :]))
                at, to = forest(a[x], b[y], len(ids))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[to]), pa.array(ids[at])], ["a", "b"])

    return work


def _overlaps(flat: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each set of a shares with each of b, by products of 0/1 matrices over a few columns at a time."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one set is shared by none
    column, row = column[often], row[often]
    column = np.cumsum(np.diff(column, prepend=-1) > 0) - 1
    both = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [lo, lo + width]))
        m = np.zeros((len(sizes), width), np.float32)
        m[row[part], column[part] - lo] = 1
        both += m[a] @ m[b].T
    return both.astype(np.int64), sizes


def _apart(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Buckets with the components of each member and of the bucket's smallest member."""
    lead = label.select(F.col("id").alias("lead"), F.col("component_id").alias("lead_comp"))
    mine = label.select(F.col("id").alias("cls"), F.col("component_id").alias("comp"))
    return buckets.join(mine, "cls", "left").join(lead, "lead", "left").withColumns({"comp": F.coalesce("comp", "cls"), "lead_comp": F.coalesce("lead_comp", "lead")})


def _grown(links: DataFrame | None, new: DataFrame, label: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    both = written(new if links is None else links.unionByName(new), "links")
    dropped(links)
    dropped(label)
    return both, written(connected_components(both, "a", "b"), "labels")
