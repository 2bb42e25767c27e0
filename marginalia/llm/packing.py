"""Best-fit packing of documents into sequences of a fixed number of tokens, improved by local search.

Documents longer than a sequence are cut; all other pieces stay whole. Pieces are dealt by a hash into shards of about
shard_items, which are packed apart from one another: best fit by falling size, then exchanges between underfull bins.
The emptiest bins of each shard are then packed again, together with those of other shards, up to a single group.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.storage import written
from marginalia.llm.tokens import encoder

#: Bins of a shard that may be found stuck before its search ends.
PATIENCE = 8
PIECE_SCHEMA = "id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first one may be shorter than capacity."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its token ids where they are asked for."""

    def work(batches):
        enc = encoder(tokenizer_path, end_id)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, places, ids in enc.encode(batch.column(1)):
                rows, crc, raw = [], [], memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                edge = places.tolist()
                for i in range(len(edge) - 1):
                    for piece, (start, length) in enumerate(cut(edge[i + 1] - edge[i], capacity)):
                        a = edge[i] + start
                        rows.append((doc_ids[lo + i], piece, start, length))
                        crc.append(zlib.crc32(raw[4 * a : 4 * (a + length)]))
                cols = [*zip(*rows, strict=True)]
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = np.zeros(len(rows) + 1, np.int32)
                    np.cumsum(cols[3], out=ends[1:])
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


class Bins:
    """Bins of one shard; items are numbers with a size."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.of = np.full(len(sizes), -1, np.int64)
        self._best_fit()
        self.fill = np.array([sum(int(sizes[i]) for i in b) for b in self.items], np.int64)

    def _best_fit(self) -> None:
        """Largest first, each into the fullest bin that still has room."""
        room: list[tuple[int, int]] = []
        for i in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[i])
            at = bisect.bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = self.capacity, len(self.items)
                self.items.append([])
            self.items[b].append(i)
            self.of[i] = b
            if left > size:
                bisect.insort(room, (left - size, b))

    def least(self) -> int:
        return -(-int(self.sizes.sum()) // self.capacity)

    def search(self, patience: int = PATIENCE) -> None:
        """Empty the emptiest bins by exchanges that move fill into fuller ones, as long as a bin can be emptied.

        Every exchange takes tokens from the emptiest bin to a bin at least as full, so the sum of squared fills grows
        with each and the search ends; it also ends once patience bins, from the emptiest on, let no exchange out.
        """
        stuck: set[int] = set()
        while sum(1 for b in self.items if b) > self.least():
            live = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist()
            sources = [b for b in live if b not in stuck]
            if len(live) < 2 or not sources:
                return
            source = min(sources, key=lambda b: self.fill[b])
            while self.items[source] and self._exchange(source):
                stuck.clear()  # what did not fit before may do so now
            if self.items[source]:
                stuck.add(source)
                if len(stuck) >= patience:
                    return

    def _exchange(self, a: int) -> bool:
        """The exchange out of bin a that brings the most tokens into another bin; False if there is none."""
        room = self.capacity - self.fill
        room[a] = 0
        room[self.fill == 0] = 0
        room[self.fill < self.fill[a]] = 0
        goal = int(room.max(initial=0))
        if goal <= 0:
            return False
        best: tuple[int, tuple[int, ...], tuple[int, ...], int] = (0, (), (), -1)
        mine = self.items[a]
        give = [(int(self.sizes[i]), (i,)) for i in mine] + [(int(self.sizes[i] + self.sizes[j]), (i, j)) for n, i in enumerate(mine) for j in mine[n + 1 :]]
        open_items = np.flatnonzero((room > 0)[self.of])
        back, rooms = self.sizes[open_items], room[self.of[open_items]]
        for size, out in give:
            fits = np.flatnonzero(room >= size)  # a move
            if len(fits):
                b = int(fits[np.argmin(room[fits])])
                if size > best[0]:
                    best = (size, out, (), b)
            gain = size - back  # one or two for one
            gain[(gain <= 0) | (gain > rooms)] = 0
            if len(gain) and (n := int(gain.argmax())) >= 0 and gain[n] > best[0]:
                best = (int(gain[n]), out, (int(open_items[n]),), int(self.of[open_items[n]]))
            if best[0] == goal:
                break
        if not best[0]:  # one for two
            for b in np.flatnonzero(room > 0).tolist():
                theirs = self.items[b]
                for n, i in enumerate(theirs):
                    for j in theirs[n + 1 :]:
                        two = int(self.sizes[i] + self.sizes[j])
                        for x in mine:
                            gain = int(self.sizes[x]) - two
                            if best[0] < gain <= room[b]:
                                best = (gain, (x,), (i, j), b)
        if not best[0]:
            return False
        gain, out, into, b = best
        for moved, src, dst in ((out, a, b), (into, b, a)):
            for i in moved:
                self.items[src].remove(i)
                self.items[dst].append(i)
                self.of[i] = dst
        self.fill[a] -= gain
        self.fill[b] += gain
        return True


def pack(lengths: np.ndarray, capacity: int, patience: int = PATIENCE) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its place there."""
    sizes = np.asarray(lengths, np.int64)
    bin_of, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    part = np.flatnonzero(sizes < capacity)
    full = np.flatnonzero(sizes >= capacity)
    bins = Bins(sizes[part], capacity)
    bins.search(patience)
    number = 0
    for b in bins.items:
        at = 0
        for i in b:
            bin_of[part[i]], place[part[i]] = number, at
            at += int(bins.sizes[i])
        number += bool(b)
    bin_of[full] = number + np.arange(len(full))
    return bin_of, place


def _packer(capacity: int, level: int, reopen: int, patience: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        shard = table.column("shard")[0].as_py()
        lengths = table.column("length").to_numpy()
        bin_of, place = pack(lengths, capacity, patience)
        fill = np.bincount(bin_of, lengths)
        weak = np.argsort(fill, kind="stable")[:reopen]
        weak = weak[fill[weak] < capacity]
        for name, values in (("sequence_id", (level << 56) + (shard << 20) + bin_of), ("offset", place), ("weak", np.isin(bin_of, weak))):
            table = table.append_column(name, pa.array(values))
        return table

    return work


def packed(cut_pieces: DataFrame, capacity: int = 1024, *, shard_items: int = 2000, merge: int = 64, reopen: int = 6, patience: int = PATIENCE) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (id, piece, length, ...), which must be cheap to read again.

    Pieces are dealt to shards by a hash of id, piece and place, so that null and repeated ids are spread too. The reopen
    emptiest bins of each shard are packed again together with those of merge - 1 other shards, and so on. A shard's
    search ends after patience stuck bins: none of these numbers drops a piece, they only bound the work on the last bins.
    """
    count = cut_pieces.count()
    shards = max(1, -(-count // shard_items))
    todo = cut_pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema.fields) + ", sequence_id long, offset long, weak boolean"
    done, level = [], 0
    while True:
        level_out = written(todo.groupBy("shard").applyInArrow(_packer(capacity, level, reopen, patience), schema), "packed")
        if shards == 1:
            done.append(level_out)
            break
        done.append(level_out.filter("NOT weak"))
        shards = -(-shards // merge)
        todo = level_out.filter("weak").drop("sequence_id", "offset", "weak").withColumn("shard", F.pmod("shard", F.lit(shards)))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("shard", "weak")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row for each piece.

    A document is its token ids and end_id. A null or empty text is the end id alone; a null id is kept; repeated rows are
    packed once each; other columns are ignored; an empty table gives an empty one. ids, if asked for, has the piece's
    token ids: sorted by (sequence_id, offset) they are the training sequences.
    """
    cut_pieces = written(pieces(docs, id_col, text_col, tokenizer_path, end_id, capacity, with_ids), "pieces")
    return packed(cut_pieces, capacity).withColumnRenamed("id", id_col)
