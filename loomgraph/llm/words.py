"""Vectorised words, word hashes and window hashes over batches of whole texts.

A word is a run of bytes other than space and U+0009..U+000D. Hashing runs in numpy over the
concatenated batch; only words of more than 64 bytes are hashed one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text split into words in one go.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


#: Masks of the first k bytes of a lane, and the seeds of the two independent word hashes.
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
#: Bytes of a word that are hashed lane by lane; longer words go through BLAKE2b.
SHORT = 64


def _pieces(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end at white space, so that no word is cut."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            back = end
            block = np.frombuffer(data, np.uint8, end - at, at)
            cut = np.flatnonzero(_SPACE[block])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                while back < n and data[back] not in b" \t\n\r\x0b\x0c":
                    back += 1
                end = back
        yield at, end
        at = end


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of ``data``."""
    parts = [(np.zeros(0, np.int64),) * 2]
    for lo, hi in _pieces(data):
        ink = np.zeros(hi - lo + 2, np.int8)
        ink[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8, hi - lo, lo)]
        step = np.diff(ink)
        parts.append((np.flatnonzero(step == 1) + lo, np.flatnonzero(step == -1) + lo))
    return tuple(np.concatenate(x) for x in zip(*parts))


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """One of two independent 64-bit hashes of the words of ``data``.

    A word of at most SHORT bytes is read as lanes of eight bytes, each folded into a state that the
    non-linear finaliser then permutes: words of up to eight bytes of one length can't collide. A longer word's
    hash is half of its BLAKE2b digest, so no structure of a word carries over to its hash.
    """
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=data + bytes(8), strides=(1,))
    size = end - start
    out = _SEEDS[which] * (size.astype(np.uint64) + U(1))
    at, left = slice(None), size
    for k in range(SHORT // 8):
        if k:
            at = np.flatnonzero(size > 8 * k)
            if not len(at):
                break
            left = size[at] - 8 * k
        x = lanes[start[at] + 8 * k] & _LANE[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ x) if not which else (out[at] + x) * _SEEDS[1])
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest()
        out[i] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
    return out


def windows(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Order-sensitive hash of each run of ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out = 0, None
    level, span = mix(h + U(0x632BE59BD9B4E019 * (2 * salt + 1) % (1 << 64))), 1
    left = width
    while left:
        if left & 1:
            part = level[done : done + n]
            out = part.copy() if out is None else mix(out * U(0xD1342543DE82EF95) + part)
            done += span
        left >>= 1
        if left:
            level = mix(level[:-span] * U(0x2545F4914F6CDD1D) + level[span:]) if len(level) > span else level[:0]
            span *= 2
    return out


class Batch:
    """Words of a list of texts (None counts as empty), each word with the index of its text."""

    def __init__(self, texts: list[str | None], lower: bool = False) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raw)
        self.data = data.lower() if lower else data  # bytes.lower() touches A-Z only
        size = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
        self.offset = np.concatenate(([0], np.cumsum(size)))
        self.start, self.end = word_bounds(self.data)
        self.hash = word_hashes(self.data, self.start, self.end)
        self.doc = np.searchsorted(self.offset, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(raw))
        self.first = np.concatenate(([0], np.cumsum(self.n_words)))

    @cached_property
    def second(self) -> np.ndarray:
        """The other hash of each word, independent of ``hash``."""
        return word_hashes(self.data, self.start, self.end, 1)

    @cached_property
    def ids(self) -> np.ndarray:
        """A number for each word that only equal words share; nothing is hashed to tell words apart."""
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.data.split()), np.int64, len(self.start))

    def windows(self, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each window that lies within one text.

        Salts 0 and 1 take independent hashes of the words, so that both together are 128 bits wide.
        """
        h = windows(self.second if salt == 1 else self.hash, width, salt)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[width - 1 :][: len(h)])
        return at, h[at]


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text each, which bounds a worker's memory."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def list_array(values: np.ndarray, lengths) -> pa.ListArray:
    """Arrow lists of the given lengths over one flat array."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
