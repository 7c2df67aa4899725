"""Byte-level BPE encoding and decoding of whole texts.

Each pre-token becomes a doubly linked list of symbols; a priority queue holds the merge ranks of
adjacent pairs and entries whose pair has changed since are skipped. Pieces that were encoded
before come from a bounded cache. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import list_array, text_chunks

#: The published split of byte-level BPE: contractions, letters, numbers, other, white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: White space as Unicode's property has it (Python's own class also holds U+001C to U+001F).
_WHITE = r"\p{White_Space}"
_FULL = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|{_WHITE}+(?![^{_WHITE}])|{_WHITE}+"
)
#: Pieces a worker remembers; when there are more, it starts afresh. Longer pieces aren't kept.
CACHE, LONGEST = 400_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(plain))
    return [names[b] for b in range(256)]


class Bpe:
    """A tokenizer read from a vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        symbols = byte_symbols()
        back = {s: bytes([b]) for b, s in enumerate(symbols)}
        vocab = model["vocab"]
        self.strings: dict[int, bytes] = {i: b"".join(back[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = [vocab[s] for s in symbols]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t, i in self.added.items():
            self.strings[i] = t.encode()
        alternatives = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.special = re.compile(f"({alternatives})") if self.added else None
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token: lowest rank first, leftmost among equals."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        ranks = self.ranks
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if (r := ranks.get((ids[i], ids[i + 1]))) is not None:
                queue.append((r[0], i, ids[i], ids[i + 1], r[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = nxt[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has merged otherwise
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            nxt[j] = -1
            if k >= 0:
                prev[k] = i
                if (r := ranks.get((new, ids[k]))) is not None:
                    heapq.heappush(queue, (r[0], i, new, ids[k], r[1]))
            if (p := prev[i]) >= 0 and (r := ranks.get((ids[p], new))) is not None:
                heapq.heappush(queue, (r[0], p, ids[p], new, r[1]))
        return [t for t in ids if t >= 0]

    def _piece(self, piece: str) -> bytes:
        out = np.asarray(self.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.special and "<" in text and (parts := self.special.split(text))[1:]:
            return b"".join(
                self.added[p].to_bytes(4, "little") if k % 2 else self.encode_plain(p) for k, p in enumerate(parts)
            )
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        split = _ASCII if text.isascii() else _FULL
        get, piece = self.cache.get, self._piece
        return b"".join([get(p) or piece(p) for p in split.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """One tokenizer for each worker and file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``.

    A null or empty text has no tokens. The vocabulary file is read by every worker from ``path``,
    which is part of an installed package. Other columns are ignored; repeated rows each count.
    """

    def work(batches):
        bpe = tokenizer(path)
        for part in text_chunks(batches):
            n, ids_digest, text_digest = [], [], []
            for text in part.column("text").to_pylist():
                raw = bpe.encode_bytes(text or "")
                ids = np.frombuffer(raw, "<u4").tolist()
                decoded = bpe.decode_bytes(ids)
                if text and not text.isascii():
                    decoded = decoded.decode("utf-8", "replace").encode()
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(raw).hexdigest())
                text_digest.append(hashlib.sha256(decoded).hexdigest())
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest), pa.array(text_digest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) of the tokens of ``text``; null text: no tokens."""

    @F.pandas_udf("array<int>")
    def enc(s: pd.Series) -> pd.Series:
        bpe = tokenizer(path)
        return pd.Series([np.frombuffer(bpe.encode_bytes(x or ""), "<u4").astype(np.int32) for x in s], dtype=object)

    return docs.withColumn(ids, enc(F.col(text).cast("string")))


def encoded_and_checked(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``round_trip``: whether the tokens decode to the text.

    A null text has no tokens and decodes to an empty one. Columns of these three names are replaced, others
    pass through; repeated rows each count, and an empty table gives no rows.
    """

    names = ("token_ids", "n_tokens", "round_trip")
    src = docs.select(*(c for c in docs.columns if c not in names)).withColumn("text", F.col("text").cast("string"))

    def work(batches):
        bpe = tokenizer(path)
        for part in text_chunks(batches):
            ids, same = [], []
            for x in part.column("text").to_pylist():
                i = np.frombuffer(bpe.encode_bytes(x or ""), "<u4")
                ids.append(i.astype(np.int32))
                same.append(bpe.decode_bytes(i.tolist()) == (x or "").encode())
            n = [len(i) for i in ids]
            made = [list_array(np.concatenate(ids), n), pa.array(n, pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])

    return src.mapInArrow(work, ", ".join([*(f"`{c}` {t}" for c, t in src.dtypes), "token_ids array<int>, n_tokens long, round_trip boolean"]))


def bpe_decode(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a column ``text`` decoded from the array column ``ids``; null ids: empty text."""

    @F.pandas_udf("string")
    def dec(s: pd.Series) -> pd.Series:
        bpe = tokenizer(path)
        return pd.Series([bpe.decode([int(i) for i in x]) if x is not None else "" for x in s], dtype=object)

    return docs.withColumn(text, dec(F.col(ids)))
