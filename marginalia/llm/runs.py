"""Groups of sorted rows inside a task, as they stream by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches, keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of two or more rows with equal keys, of batches that are sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        edges = _edges(held, keys)
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            if b - a > 1:
                yield held.slice(a, b - a)
        held = held.slice(edges[-2]).combine_chunks() if len(edges) > 1 else None
    if held is not None and held.num_rows > 1:
        yield held


def _edges(table: pa.Table, keys: tuple[str, ...]) -> list[int]:
    same = np.ones(max(0, table.num_rows - 1), bool)
    for name in keys:
        values = table.column(name).to_numpy()
        same &= values[1:] == values[:-1]
    return [0, *(np.flatnonzero(~same) + 1).tolist(), table.num_rows] if table.num_rows else []


def forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of n items to the least item of its component among the links (x, y)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[x], low[y])
        nxt = low.copy()
        np.minimum.at(nxt, x, m)
        np.minimum.at(nxt, y, m)
        nxt = nxt[nxt]
        if (nxt == low).all():
            break
        low = nxt
    at = np.flatnonzero(low < np.arange(n))
    return at, low[at]
