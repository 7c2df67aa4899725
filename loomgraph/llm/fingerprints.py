"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions only.

A sketch is the ascending array of the k smallest 64-bit hashes of a text's 5-word shingles. Sketches of parts
merge into that of the whole, and two of them estimate resemblance, containment and distinct counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import checkpoint, shuffle_partitions

#: Words in a shingle, and hashes kept.
SHINGLE, K = 5, 128
#: Ranges of ids at most.
MAX_BLOCKS = 100_000
_SPACE = r"[\x20\x09-\x0D]"
#: Every run of five words of a cleaned text, read ahead so that the runs may overlap.
_RUN = rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{SHINGLE - 1}}}))"


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(text: Column | str) -> Column:
    """The words of ``text`` joined by one space; empty for a null text."""
    return F.trim(F.regexp_replace(F.coalesce(_as_column(text), F.lit("")), f"{_SPACE}+", " "))


def shingle_hashes(cleaned: Column | str) -> Column:
    """Distinct hashes of the shingles of a cleaned text; a shorter text's words are its one shingle."""
    c = _as_column(cleaned)
    short = F.when(F.length(c) == 0, F.array().cast("array<string>")).when(
        F.regexp_count(c, F.lit(" ")) < SHINGLE - 1, F.array(c)
    )
    return F.array_distinct(
        F.transform(short.otherwise(F.regexp_extract_all(c, F.lit(_RUN), F.lit(1))), lambda s: F.xxhash64(s))
    )


def with_sketch(df: DataFrame, text: str, column: str = "sketch", k: int = K) -> DataFrame:
    """``df`` with the bottom-k sketch of ``text``: array<bigint>, empty where there are no words.

    The cleaned text is a column of its own, so that it is made once and not in every branch.
    """
    made = df.withColumn("_cleaned", clean(text))
    return made.withColumn(column, F.slice(F.sort_array(shingle_hashes("_cleaned")), 1, k)).drop("_cleaned")


def merge(a: Column | str, b: Column | str, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(_as_column(a), _as_column(b))), 1, k)


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1. Two empty sketches are alike (1), one empty isn't (0)."""
    a, b = _as_column(a), _as_column(b)
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column | str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    a = _as_column(a)
    # position of the k-th hash in the range of all hashes, 0 to 1
    share = F.try_element_at(a, F.lit(-1)).cast("double") / F.lit(2.0**64) + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 where a is empty."""
    a, b = _as_column(a), _as_column(b)
    j, na, nu = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * nu / na))


def merged(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """``keys`` with the sketch of each group: partial sums are at most one row of each hash and group."""
    hashes = sketches.select(*keys, F.explode(column).alias("h")).distinct()
    salted = hashes.withColumn("salt", F.expr("pmod(h, 64)"))
    part = salted.groupBy(*keys, "salt").agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("s"))
    return part.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("s"))), 1, k).alias(column))


def as_text(sketch: Column | str) -> Column:
    """The sketch as comma-joined hexadecimal hashes; empty for an empty one."""
    return F.array_join(F.transform(_as_column(sketch), lambda h: F.hex(h)), ",")


def range_blocks(ids: DataFrame, column: str) -> DataFrame:
    """``ids`` with ``_block``, the range between quantiles of ``column`` that a row is in.

    The bounds are at most MAX_BLOCKS numbers.
    """
    spark = ids.sparkSession
    n = min(MAX_BLOCKS, max(1, 4 * shuffle_partitions(spark)))
    if n == 1:
        return ids.withColumn("_block", F.lit(0))
    cuts = ids.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n + 10000)).first()[0]
    cuts = sorted(set(cuts or []))
    # Two steps of about the root of n comparisons each: filters pushed below keep their size.
    step = max(1, math.isqrt(len(cuts)))
    count = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col(column)))
    coarse, bounds = F.lit(cuts[::step]).cast("array<bigint>"), F.lit(cuts).cast("array<bigint>")
    out = ids.withColumn("_coarse", F.greatest(F.lit(0), count(coarse) - 1) * step)
    return out.withColumn("_block", F.col("_coarse") + count(F.slice(bounds, F.col("_coarse") + 1, F.lit(step)))).drop("_coarse")


def _blocks_without_ids(rows: DataFrame, column: str) -> DataFrame:
    """``_block`` for rows whose ``column`` is a hash: equal ranges of it, after those of all ids."""
    n = min(MAX_BLOCKS, max(1, 4 * shuffle_partitions(rows.sparkSession)))
    place = (F.col(column).cast("double") / F.lit(2.0**64) + 0.5) * n
    return rows.withColumn("_block", F.lit(MAX_BLOCKS + 1) + F.least(F.lit(n - 1), F.floor(place).cast("int")))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and more, below.

    The edited text has its last floor(n/2) code points replaced by as many from the start of the
    next document by doc_id (the first one's for the last). Rows that share a doc_id follow each other in
    the order of their texts; rows without one come last of all, in a fixed order by their texts. A null text is an
    empty one. An empty table gives no rows. Other columns are ignored. The text is shuffled once, into ranges of
    ids; each range gets the first rows of the next one as guests (the last range those of the first), so that the next
    row is at hand.

    ``n_shingles`` estimates the text's distinct shingles, ``contained`` the share of them that the edited text has,
    and ``n_shingles_both`` the distinct shingles of this document and the next together, by merging their sketches.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("_id", F.coalesce("doc_id", F.xxhash64("text")))
    known = range_blocks(src.where("doc_id is not null"), "_id")
    blocked = known.unionByName(_blocks_without_ids(src.where("doc_id is null"), "_id"))
    firsts = checkpoint(blocked.groupBy("_block").agg(F.min("_id").alias("first")))  # a row for each block
    order = firsts.selectExpr(
        "_block", "first",
        "lag(_block) over (order by _block) as before", "max(_block) over () as last",
    )
    guests_of = order.select(
        F.col("_block").alias("gb"), F.col("first"), F.coalesce("before", "last").alias("host"), (F.col("before").isNull()).alias("wrap")
    )
    guests = (
        blocked.join(F.broadcast(guests_of), (F.col("_block") == F.col("gb")) & (F.col("_id") == F.col("first")))
        .select("_id", "doc_id", "text", F.col("host").alias("_block"), F.when(F.col("wrap"), 2).otherwise(1).alias("_guest"))
    )
    rows = blocked.select("_id", "doc_id", "text", "_block", F.lit(0).alias("_guest")).unionByName(guests)
    rows = with_sketch(rows, "text", "fp")
    near = rows.selectExpr(
        "doc_id", "text", "fp", "_guest",
        "lead(text) over (partition by _block order by _guest, _id, text) as _next",
        "lead(fp) over (partition by _block order by _guest, _id, text) as _next_fp",
    ).where("_guest = 0")
    near = near.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_half", F.expr("cast(n_chars div 2 as int)"))
    edited = near.withColumn("_edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - _half), substring(_next, 1, _half))"))
    edited = with_sketch(edited.select("doc_id", "n_chars", "fp", "_next_fp", "_edited"), "_edited", "efp")
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text("fp").alias("fingerprint"),
        as_text("efp").alias("edited_fingerprint"),
        resemblance("fp", "efp").alias("near_edited"),
        resemblance("fp", "_next_fp").alias("near_next"),
        distinct_shingles("fp").alias("n_shingles"),
        containment("fp", "efp").alias("contained"),
        distinct_shingles(merge("fp", "_next_fp")).alias("n_shingles_both"),
    )
