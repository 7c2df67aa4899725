"""Entity dedup: exact labels, fuzzy pairs behind blocking, guards, winners and rewiring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgraph.functions import text as T
from loomgraph.operators.components import connected_components

#: Least entropy of a label, score of a merge, score and length for short labels,
#: permutations, bands and rows of the sketch at a threshold of 0.7.
MIN_ENTROPY, MERGE, SHORT_MERGE, SHORT = 2.5, 92.0, 97.0, 12
PERMUTATIONS, BANDS, BAND_ROWS = 128, 14, 9
_MERSENNE = (1 << 61) - 1


def jaro(a: str, b: str) -> float:
    """Jaro similarity, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro with a bonus for a common start of up to four characters, above 0.7."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    k = 0
    while k < min(4, len(a), len(b)) and a[k] == b[k]:
        k += 1
    return s + k * weight * (1 - s)


@F.pandas_udf(DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)])


def permutations(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(1)
    return (
        np.array([rng.randint(1, _MERSENNE, dtype=np.uint64) for _ in range(n)], np.uint64),
        np.array([rng.randint(0, _MERSENNE, dtype=np.uint64) for _ in range(n)], np.uint64),
    )


def minhash_bands(labels: DataFrame) -> DataFrame:
    """``id, band`` keys of the MinHash sketches of labels' trigrams."""
    a, b = permutations()

    @F.pandas_udf("array<string>")
    def bands(label: pd.Series) -> pd.Series:
        import hashlib

        out = []
        for s in label:
            grams = {s[i : i + 3] for i in range(len(s) - 2)} or {s}
            h = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], np.uint64)
            sig = (((h[:, None] * a + b) % np.uint64(_MERSENNE)) & np.uint64(0xFFFFFFFF)).min(0)
            out.append([f"{k}:{hashlib.md5(sig[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes()).hexdigest()}" for k in range(BANDS)])
        return pd.Series(out, dtype=object)

    return labels.select("id", F.explode(bands("label")).alias("band"))


def shingle_pairs(labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``a, b, jaccard`` of distinct labels by exact trigram sets: the certain twin of the sketch."""
    own = labels.select("label").distinct().withColumn("gs", T.trigrams(F.lower("label"))).withColumn("n", F.size("gs"))
    grams = own.select("label", "n", F.explode("gs").alias("g"))
    df = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Two sets as alike as the threshold share one of the rarest n - ceil(t * n) + 1 grams of each, so that
    # only those meet; grams that nobody else has come first in that order and need no row.
    ranked = grams.join(df, "g").groupBy("label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("r"))
    t = threshold - 1e-6
    length = F.col("n") - F.ceil(F.lit(t) * F.col("n")) + 1 - (F.col("n") - F.size("r"))
    prefix = ranked.select("label", "n", F.explode(F.slice("r", F.lit(1), F.greatest(F.lit(0), length.cast("int")))).alias("p")).select("label", "n", F.col("p.g").alias("g"))
    x = prefix.select(F.col("label").alias("a"), F.col("n").alias("na"), "g")
    y = prefix.select(F.col("label").alias("b"), F.col("n").alias("nb"), "g")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= t * F.greatest("na", "nb"))
    cand = x.join(y, "g").where(fits).select("a", "b").distinct()
    sets = own.select("label", "gs")
    j = cand.join(sets.select(F.col("label").alias("a"), F.col("gs").alias("ga")), "a").join(sets.select(F.col("label").alias("b"), F.col("gs").alias("gb")), "b")
    k = F.size(F.array_intersect("ga", "gb"))
    return j.select("a", "b", F.round(k / (F.size("ga") + F.size("gb") - k), 6).alias("jaccard")).where(F.col("jaccard") >= threshold)


def guarded(a: Column, b: Column, score: Column, same_file: Column) -> Column:
    """Whether a candidate pair of normalised labels may merge."""
    short = F.least(F.length(a), F.length(b)) < SHORT
    short_ok = (F.length(a) == F.length(b)) & (score >= SHORT_MERGE) & T.one_edit(a, b)
    numbers = T.numeric_tokens(a) != T.numeric_tokens(b)
    prefix = a.startswith(F.concat(b, F.lit(" "))) | b.startswith(F.concat(a, F.lit(" ")))
    return (score >= MERGE) & ~T.variant_pair(a, b) & ~numbers & ~prefix & (~short | short_ok)


def fuzzy_pairs(labels: DataFrame, least: float = 0.85) -> DataFrame:
    """``a, b, score`` of distinct labels that share a trigram block, by Jaro-Winkler."""
    pairs = shingle_pairs(labels, 0.3).select("a", "b")
    return pairs.withColumn("score", F.round(jaro_winkler_udf("a", "b"), 4)).where(F.col("score") >= least)


def winners(groups: DataFrame) -> DataFrame:
    """``id, winner`` from (id, component): no ``_c1`` suffix, then the shorter id, then the first by id."""
    key = F.struct(F.col("id").rlike(r"_c[0-9]+$").alias("s"), F.length("id").alias("n"), "id")
    best = groups.groupBy("component").agg(F.min(key).alias("m")).select("component", F.col("m.id").alias("winner"))
    return groups.join(best, "component").select("id", "winner")


def rewire(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with merged ends; self-loops that the merge makes go, older ones stay."""
    out = edges
    for end in ("src", "dst"):
        m = mapping.select(F.col("id").alias("_i"), F.col("winner").alias(f"_{end}"))
        out = out.join(m, out[end] == m["_i"], "left").drop("_i")
    out = out.withColumn("_was", F.col("src") == F.col("dst"))
    out = out.withColumns({e: F.coalesce(f"_{e}", e) for e in ("src", "dst")}).drop("_src", "_dst")
    return out.where("_was or src <> dst").drop("_was").distinct()


def exact_label_groups(nodes: DataFrame) -> DataFrame:
    """``id, component`` of nodes with the same normalised label in the same file."""
    n = nodes.where("source_file is not null and source_file <> ''").select("id", T.norm_label(F.col("label")).alias("k"), "source_file")
    g = n.where("k <> ''").groupBy("k", "source_file").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return n.join(g, ["k", "source_file"]).select("id", "component")


def deduplicated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mapping): exact merges in a file, then guarded fuzzy ones; code nodes only merge exactly."""
    exact = winners(exact_label_groups(nodes))
    left = nodes.join(exact.where("id <> winner").select("id"), "id", "left_anti")
    fuzzy = left.where("file_type <> 'code'").select("id", T.norm_label(F.col("label")).alias("label"), "source_file")
    fuzzy = fuzzy.where((F.length("label") > 0) & (T.entropy(F.col("label")) >= MIN_ENTROPY))
    one = fuzzy.groupBy("label").agg(F.min_by("id", F.struct(F.length("id"), "id")).alias("id"), F.min("source_file").alias("source_file"))
    bands = minhash_bands(one)
    a, b = bands.select("band", F.col("id").alias("a")), bands.select("band", F.col("id").alias("b"))
    cand = a.join(b, "band").where("a < b").select("a", "b").distinct()
    la, lb = (one.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"), F.col("source_file").alias(f"f{x}")) for x in "ab")
    j = cand.join(la, "a").join(lb, "b").withColumn("score", jaro_winkler_udf("la", "lb") * 100)
    pairs = j.where(guarded(F.col("la"), F.col("lb"), F.col("score"), F.col("fa") == F.col("fb")))
    comp = connected_components(pairs, "a", "b").withColumnRenamed("node", "id")
    near = winners(comp)
    chain = exact.join(near.withColumnRenamed("winner", "w2").withColumnRenamed("id", "winner"), "winner", "left").select("id", F.coalesce("w2", "winner").alias("winner"))
    mapping = chain.unionByName(near.join(exact.select("id"), "id", "left_anti")).where("id <> winner")
    kept = nodes.join(mapping.select("id"), "id", "left_anti")
    return kept, rewire(edges, mapping), mapping
