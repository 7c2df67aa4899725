"""Streaming over rows clustered by a key, and small union-find in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with more underscores in front where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys; the input is sorted by the keys (integers).

    At most one run is held at a time.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys], 1)
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            now = tuple(k[lo].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterable[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole runs of equal ``key`` (a longer run comes as one)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= rows:
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            before = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            other = np.flatnonzero(k != before)
            if len(other):
                cut = int(other[0])
                if cut:
                    held.append(b.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, n = [], 0
                b = b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the edges a-b connect."""
    if not len(a):
        return a[:0], b[:0]
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            nxt = new[new]
            if (nxt == new).all():
                break
            new = nxt
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]
