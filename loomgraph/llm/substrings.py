"""Removal of repeated passages: a count-min prefilter, then exact grouping of the windows it lets by.

Documents are dealt into blocks. Each block sketches its windows: the cells they hit in every row of
a count-min table, sent as Rice-coded sorted lists to the shards of the table, which add the
blocks up and tell each block which of its cells are hit by another block too. Estimates never fall below the true
count, so a window that occurs twice is always let by. Those windows go, as 128-bit digests with
the document they start in, to a second set of shards that group them exactly and answer, again by
block, which of them start earlier elsewhere. Traffic is a few bytes a window; no sketch is ever held in one
place.

Windows are told apart by two independent 64-bit hashes of their words (see ``words.word_hashes``). Among n
distinct windows any two share a digest with a probability of about n * n / 2**129: 1e-13 for 1e13 windows, which
is some 60 TB of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import Batch, U, mix

#: Words in a window; rows of the count-min table, and its cells for each word of the corpus.
WINDOW, ROWS, LOAD = 20, 2, 4
#: Bytes of text in a block, cells of a shard of the table, and bytes of text for each shard of the exact pass, which
#: gets at most one window a word.
BLOCK_BYTES, SHARD_CELLS, EXACT_BYTES = 8 << 20, 1 << 24, 8 << 20
#: Every block writes to every shard: beyond so many (block, shard) messages shards grow, up to MOST_CELLS.
MESSAGES, MOST_CELLS = 10_000_000, 1 << 28


def shard_size(blocks: int, cells: int) -> int:
    """Cells of a shard that keep blocks x shards within MESSAGES, as far as MOST_CELLS allows."""
    size = SHARD_CELLS
    while size < MOST_CELLS and blocks * ROWS * -(-cells // size) > MESSAGES:
        size *= 2
    return size


def pack(sorted_ids: np.ndarray) -> bytes:
    """Sorted non-negative integers as Rice-coded differences: low bytes as they are, the rest in unary."""
    n = len(sorted_ids)
    gap = np.diff(sorted_ids.astype(np.uint64), prepend=np.zeros(1, np.uint64)).astype("<u8")
    low = 0
    while n and low < 7 and int(sorted_ids[-1]) >> (8 * low) > 8 * n:
        low += 1
    at = np.cumsum(gap >> U(8 * low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    bits[at] = 1
    planes = gap.view(np.uint8).reshape(-1, 8)[:, :low]
    return np.array([n, low], "<u4").tobytes() + planes.tobytes() + np.packbits(bits).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, low = np.frombuffer(data, "<u4", 2).tolist()
    gap = np.zeros((n, 8), np.uint8)
    gap[:, :low] = np.frombuffer(data, np.uint8, n * low, 8).reshape(n, low)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 + n * low)))[:n]
    high = np.diff(at, prepend=-1).astype(np.uint64) - U(1)
    return np.cumsum(gap.view("<u8").ravel() + (high << U(8 * low)), dtype=np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; sorting is far faster here than numpy's hashed unique."""
    s = np.sort(x)
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    return s[keep]


class _Block:
    """The windows of one block, its documents in the order of their ids."""

    def __init__(self, pdf: pd.DataFrame, cells: int, shard_cells: int) -> None:
        self.pdf = pdf.sort_values(["doc_id", "text"], kind="stable", na_position="last")
        self.batch = Batch(self.pdf["text"].tolist())
        self.at, self.h = self.batch.windows(WINDOW)
        self.cells, self.shard_cells = cells, shard_cells

    def cell(self, row: int) -> np.ndarray:
        """Cell of each window; a row takes up the next ``cells`` numbers."""
        z = mix(self.h ^ U(0xA0761D6478BD642F * (row + 1) % (1 << 64)))
        return (z % U(self.cells)) + U(row * self.cells)

    def let_by(self, shared: dict[int, np.ndarray]) -> np.ndarray:
        """Windows whose estimate is two or more; ``shared``: by shard, a flag for each distinct cell."""
        ok = np.ones(len(self.h), bool)
        for row in range(ROWS):
            c, inv, n = np.unique(self.cell(row), return_inverse=True, return_counts=True)
            hit = n > 1
            shard = (c // U(self.shard_cells)).astype(np.int64)
            ends = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(c)]):
                if hi > lo and (flags := shared.get(int(shard[lo]) * ROWS + row)) is not None:
                    hit[lo:hi] |= flags[: hi - lo]
            ok &= hit[inv]
        return ok

    def digests(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digest halves as a structured array, first window of each, inverse) of the chosen windows."""
        _, second = self.batch.windows(WINDOW, salt=1)
        d = np.empty(len(chosen), dtype=[("a", "<u8"), ("b", "<u8")])
        d["a"], d["b"] = mix(self.h[chosen]), second[chosen]
        order = np.lexsort((d["b"], d["a"]))  # stable: the first window of a run is the earliest
        a, b = d["a"][order], d["b"][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        inv = np.empty(len(a), np.int64)
        inv[order] = np.cumsum(new) - 1
        return d[order[new]], order[new], inv


def _grouped(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
    return {int(s): np.unpackbits(np.frombuffer(b, np.uint8)) > 0 for s, b in zip(pdf["shard"], pdf["data"])}


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def repeated_windows_removed(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the words left) for each row of ``docs``.

    A word goes if a window of 20 words covers it whose words also start earlier: in a smaller doc_id,
    or earlier in the same document. Rows that share a doc_id follow each other in a fixed order that depends on
    their texts alone, whatever the partitioning. A null text has no words. A null doc_id comes after all others.
    An empty table gives no rows. Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    cells = max(1024, LOAD * (total // 5))
    shard_cells = shard_size(blocks, cells)
    # The text is part of the hash so that rows without an id, or of one id, don't all meet in a block.
    src = src.withColumn("block", F.expr(f"cast(pmod(xxhash64(doc_id, text), {blocks}) as int)"))
    exact_shards = max(1, -(-total // EXACT_BYTES))

    def sketch(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        w = _Block(pdf, cells, shard_cells)
        rows = []
        for row in range(ROWS):
            c = distinct(w.cell(row))
            shard = (c // U(shard_cells)).astype(np.int64)
            ends = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(c)]):
                if hi > lo:
                    s = int(shard[lo])
                    rows.append((s * ROWS + row, block, pack(c[lo:hi] - U(s * shard_cells))))
        return pd.DataFrame(rows, columns=["shard", "block", "data"]).astype({"shard": "int64", "block": "int64"})

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(shard_cells, np.uint8)
        for data in pdf["data"]:
            c = unpack(data)
            seen[c] = np.minimum(seen[c], 1) + 1
        pdf["data"] = [_bits(seen[unpack(data)] > 1) for data in pdf["data"]]
        return pdf

    def chosen(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"shard": [], "block": [], "n": [], "data": []})
        if not len(left):
            return empty
        w = _Block(left, cells, shard_cells)
        pick = np.flatnonzero(w.let_by(_grouped(right)))
        if not len(pick):
            return empty
        uniq, first, _ = w.digests(pick)
        ids = w.pdf["doc_id"].fillna(2**63 - 1).astype("int64").to_numpy()[w.batch.doc[w.at[pick[first]]]]
        shard = (uniq["a"] % U(exact_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rows = []
        ends = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, ends):
            data = uniq[part].tobytes() + ids[part].astype("<i8").tobytes()
            rows.append((int(shard[part[0]]), int(left["block"].iloc[0]), len(part), data))
        return pd.DataFrame(rows, columns=["shard", "block", "n", "data"])

    def earliest(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = [("a", "<u8"), ("b", "<u8")]
        d = np.concatenate([np.frombuffer(x, kind, n) for x, n in zip(pdf["data"], pdf["n"])])
        ids = np.concatenate([np.frombuffer(x, "<i8", n, 16 * n) for x, n in zip(pdf["data"], pdf["n"])])
        block = np.repeat(pdf["block"].to_numpy(), pdf["n"].to_numpy())  # rows that share a doc_id may be in several
        order = np.lexsort((block, ids, d["b"], d["a"]))
        again = np.zeros(len(d), bool)
        a, b = d["a"][order], d["b"][order]
        again[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        ends = np.cumsum(pdf["n"].to_numpy())
        data = [_bits(again[hi - n : hi]) for hi, n in zip(ends, pdf["n"])]
        return pd.DataFrame({"shard": pdf["shard"], "block": pdf["block"], "data": data})

    def remove(key, left: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []})
        kinds = shared["pass"].to_numpy()
        w = _Block(left, cells, shard_cells)
        gone = np.zeros(len(w.batch.hash) + 1, np.int64)
        pick = np.flatnonzero(w.let_by(_grouped(shared[kinds == 1])))
        if len(pick):
            uniq, first, inv = w.digests(pick)
            again = np.zeros(len(uniq), bool)
            shard = (uniq["a"] % U(exact_shards)).astype(np.int64)
            for s, flags in _grouped(shared[kinds == 2]).items():
                at = np.flatnonzero(shard == s)
                again[at] = flags[: len(at)]
            late = again[inv]
            is_first = np.zeros(len(pick), bool)
            is_first[first] = True
            late |= ~is_first
            start = w.at[pick[late]]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + WINDOW, -1)
        covered = np.cumsum(gone[:-1]) > 0
        b = w.batch
        rows = []
        for i in range(len(w.pdf)):
            lo, hi = b.first[i], b.first[i + 1]
            cov = covered[lo:hi]
            words = b.data[b.offset[i] : b.offset[i + 1] - 1].split()
            removed = int(cov.sum())
            if removed:
                words = [words[k] for k in np.flatnonzero(~cov)]
            kept = b" ".join(words)
            rows.append((int(hi - lo), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])
        out.insert(0, "doc_id", w.pdf["doc_id"].astype("Int64").to_numpy())
        return out

    by_block = src.groupBy("block")
    flags = (
        by_block.applyInPandas(sketch, "shard long, block long, data binary")
        .groupBy("shard")
        .applyInPandas(add_up, "shard long, block long, data binary")
        .withColumn("block", F.col("block").cast("int"))
    )
    firsts = (
        by_block.cogroup(flags.groupBy("block"))
        .applyInPandas(chosen, "shard long, block long, n long, data binary")
        .groupBy("shard")
        .applyInPandas(earliest, "shard long, block long, data binary")
        .withColumn("block", F.col("block").cast("int"))
    )
    answers = flags.withColumn("pass", F.lit(1)).unionByName(firsts.withColumn("pass", F.lit(2)))
    out = by_block.cogroup(answers.groupBy("block")).applyInPandas(
        remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
    return out if keep_text else out.drop("kept")
