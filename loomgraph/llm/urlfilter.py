"""URL rules by Bloom filter cascades, in built-in functions only.

The universe is every (host suffix, path prefix) that a url of the corpus could match. A cascade
encodes the listed keys in its first filter, the other keys of the universe that this one lets by in
the second, the listed keys that that one lets by in the third, and so on until none is wrong; over the
universe membership is then exact, and a url is judged without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import checkpoint

#: The production rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Verdict where no rule fits, bits of a filter at most (16 MB), hash functions at most.
DEFAULT, MAX_BITS, MAX_HASHES = "allow", 1 << 27, 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Bloom:
    bits: int
    hashes: int
    salt: int
    words: list[int]

    def has(self, key: Column) -> Column:
        """Whether every bit of ``key`` is set."""
        words = F.lit(self.words).cast("array<bigint>")
        out = F.lit(True)
        for pos in _positions(key, self.bits, self.hashes, self.salt):
            word = F.get(words, F.shiftrightunsigned(pos, 6).cast("int"))
            out = out & (F.getbit(word, F.pmod(pos, F.lit(64)).cast("int")) == 1)
        return out


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt * MAX_HASHES + i)), F.lit(bits)).cast("long") for i in range(hashes)]


def build_bloom(keys: DataFrame, n: int, rate: float, salt: int = 0) -> Bloom:
    """A filter of the ``n`` rows of ``keys`` (column key) with the false positive rate ``rate``.

    ``salt`` picks the hash functions: levels of a cascade must not share them.
    """
    hashes = max(1, min(MAX_HASHES, round(-math.log2(rate))))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    if bits > MAX_BITS:
        raise ValueError(f"a filter of {bits} bits exceeds MAX_BITS; split the list")
    rows = (
        keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, salt))).alias("pos"))
        .groupBy(F.expr("pos div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("v"))
        .collect()
    )  # at most bits / 64 numbers
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["v"]
    return Bloom(bits, hashes, salt, words)


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, key: Column) -> Column:
        """Membership of ``key``; exact for keys of the universe that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            out = F.when(self.levels[depth - 1].has(key), out).otherwise(F.lit(depth % 2 == 0))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` and ``universe``: distinct rows of ``key``. Levels alternate until nothing is wrong.

    Only counts and the bits of the filters reach the driver; their size follows the list and the logarithm of
    the universe.
    """
    inside = checkpoint(listed.join(universe, "key", "left_semi"))
    outside = universe.join(inside, "key", "left_anti")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Bloom] = []
    if not n_in:
        return Cascade(levels)
    rate = min(0.5, max(2.0**-MAX_HASHES, math.sqrt(0.5) * n_in / max(1, n_out)))
    held, others, n = inside, outside, n_in
    while n:
        bloom = build_bloom(held, n, rate, len(levels))
        levels.append(bloom)
        wrong = checkpoint(others.where(bloom.has(F.col("key"))))
        held, others, n, rate = wrong, held, wrong.count(), 0.5
        if len(levels) > 64:
            raise RuntimeError("the cascade does not settle")
    return Cascade(levels)


def split_url(url: str) -> tuple[Column, Column]:
    """(host, path) of a url column; both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda i: F.coalesce(F.regexp_extract(F.col(url).cast("string"), pattern, i), F.lit(""))
    return F.translate(get(1), _UPPER, _LOWER), get(2)


def candidates(host: str, path: str, lengths: list[int]) -> Column:
    """Keys that a rule could have: every suffix of the host by label, with every prefix of the path."""
    lens = ", ".join(map(str, lengths))
    return F.expr(
        f"flatten(transform(sequence(1, size(split({host}, '[.]'))), i ->"
        f" transform(filter(array({lens}), n -> n <= char_length({path})),"
        f" n -> concat(array_join(slice(split({host}, '[.]'), i, 1000), '.'), substring({path}, 1, n)))))"
    )


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages`` (page_id, url, ...).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule
    wins, of equal lengths the one with the longer host. Without a rule ``rule`` is null and the
    verdict ``default``. A null url has an empty host and path. Other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = split_url("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    rows = rows.withColumn("_keys", candidates("host", "path", lengths))
    universe = checkpoint(rows.select(F.explode("_keys").alias("key")).distinct())
    verdicts = sorted({v for v, _, _ in rules})
    lists = {v: spark.createDataFrame([(h + p,) for w, h, p in rules if w == v], "key string").distinct() for v in verdicts}
    cascades = {v: build_cascade(lists[v], universe) for v in verdicts}

    def fits(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for v in verdicts:
            out = F.when(cascades[v].has(key), F.lit(v)).otherwise(out)
        return out

    marked = F.transform(
        "_keys",
        lambda k: F.struct(
            F.char_length(k).alias("size"), F.instr(k, "/").alias("host_size"), k.alias("rule"), fits(k).alias("verdict")
        ),
    )
    best = F.array_max(F.filter(marked, lambda m: m["verdict"].isNotNull()))
    return rows.withColumn("_best", best).select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
