"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by three rounds of random signs and a Hadamard transform; the coordinate of
largest size, with its sign, is its vertex of the cross-polytope. Two vertices make a bucket of one
table; multiprobe adds, to the best bucket, those with the runner-up vertices. All pairs of a bucket are
verified by cosine in double precision, block against block, and each pair is counted only in
the first bucket that it meets in, so that counts need no pair list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.grouping import forest, runs
from loomgraph.llm.words import U, mix
from loomgraph.operators.components import connected_components
from loomgraph.runtime import checkpoint, shuffle_partitions

#: Least cosine of a link; tables; vertices to a table; buckets that a vector joins in each table.
COSINE, TABLES, VERTICES, PROBES = 0.9, 12, 2, 3
#: Vectors of a bucket's block, two of which meet in one task, and rows of a block multiplied at a time. A bucket of m
#: vectors deals each out m / BLOCK times; counting its links takes all its pairs in any case.
BLOCK, STRIP = 4096, 512
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    x = x.copy()
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def buckets(x: np.ndarray) -> np.ndarray:
    """(n, TABLES, PROBES) bucket ids of the rows of x; a pair may meet in any probe of a table."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng(SEED)
    rows = np.arange(n)
    out = np.empty((n, TABLES, PROBES), np.uint64)
    for t in range(TABLES):
        best, second, gap = [], [], []
        for _ in range(VERTICES):
            z = padded
            for _ in range(3):
                z = hadamard(z * rng.choice((-1.0, 1.0), size))
            a = np.abs(z)
            i = a.argmax(1)
            top = a[rows, i]
            a[rows, i] = -1
            j = a.argmax(1)
            gap.append(top - a[rows, j])
            best.append(2 * i + (z[rows, i] < 0))
            second.append(2 * j + (z[rows, j] < 0))
        probe = [best]
        order = np.argsort(np.stack(gap, 1), axis=1)
        for p in range(PROBES - 1):
            flip = order[:, p]
            probe.append([np.where(flip == v, second[v], best[v]) for v in range(VERTICES)])
        for p, vertices in enumerate(probe):
            code = np.full(n, U(t + 1))
            for v in vertices:
                code = mix(code * U(0xD1342543DE82EF95) + v.astype(np.uint64))
            out[:, t, p] = code
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaling first keeps squares from overflowing."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _links(batches):
    """From rows (bucket, bi, bj, half, cid, rep, n, e, codes): counts by class and a forest of ids, by block pair."""
    for t in runs(batches, ["bucket", "bi", "bj"]):
        bucket = t["bucket"][0].as_py()
        cid, rep, half, n = (t[c].to_numpy() for c in ("cid", "rep", "half", "n"))
        m = len(rep)
        same = t["bi"][0].as_py() == t["bj"][0].as_py()
        left = np.arange(m) if same else np.flatnonzero(half == 0)
        right = np.arange(m) if same else np.flatnonzero(half == 1)
        if m < 2 or not len(left) or not len(right):
            continue
        x = unit(t["e"].combine_chunks().flatten().to_numpy().reshape(m, -1))
        codes = t["codes"].combine_chunks().flatten().to_numpy().reshape(m, TABLES * PROBES)
        links = np.zeros(m)
        tree = []
        for at in range(0, len(left), STRIP):
            strip = left[at : at + STRIP]
            i, j = np.nonzero(x[strip] @ x[right].T >= COSINE)
            i, j = strip[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            keep = np.empty(len(i), bool)
            for lo in range(0, len(i), 16384):
                a, b = codes[i[lo : lo + 16384]], codes[j[lo : lo + 16384]]
                # the least shared bucket is the one that counts the pair
                both = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1)
                keep[lo : lo + 16384] = both == bucket
            i, j = i[keep], j[keep]
            links += np.bincount(i, weights=n[j], minlength=m) + np.bincount(j, weights=n[i], minlength=m)
            tree.append(forest(rep[i], rep[j]))
        some = np.flatnonzero(links)
        if not len(some):
            continue
        a, b = forest(*(np.concatenate(z) for z in zip(*tree)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((cid[some], a))),
                pa.array(np.concatenate((np.full(len(some), -1), b)), mask=np.arange(len(some) + len(a)) < len(some)),
                pa.array(np.concatenate((links[some].astype(np.int64), np.zeros(len(a), np.int64)))),
            ],
            ["src", "dst", "links"],
        )


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (vec_id, embedding, ...).

    A vector links with every other of cosine >= 0.9. Null, empty and zero vectors and those with a
    null, NaN or infinite component link with nothing. Equal vectors are joined before hashing.
    Vectors of different lengths never link. Rows that share a vec_id count as separate vectors, each with its own
    links, of one component. A null vec_id links with nothing. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    src = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    )
    good = F.expr(
        "e is not null and size(e) > 0 and forall(e, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))"
        " and exists(e, v -> v <> 0)"
    )
    rows = src.select("vec_id", F.when(F.col("vec_id").isNotNull() & good, F.expr("transform(e, v -> v + 0.0D)")).alias("e"))
    # Single-precision input goes back to single precision, without loss, wherever it is shuffled.
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = rows.withColumn("e", F.col("e").cast(f"array<{kind}>"))
    classes = rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = checkpoint(classes.withColumn("cid", F.monotonically_increasing_id()))

    def hashed(frames):
        for pdf in frames:
            length = pdf["e"].map(len)
            for _, part in pdf.groupby(length):
                step = max(1, (1 << 20) // len(part["e"].iloc[0]))
                for lo in range(0, len(part), step):
                    few = part.iloc[lo : lo + step]
                    x = np.stack(few["e"].to_numpy())
                    codes = buckets(unit(x)).reshape(len(x), -1)
                    codes = (mix(codes + U(x.shape[1])) >> U(1)).astype(np.int64)
                    yield pd.DataFrame({"cid": few["cid"], "rep": few["rep"], "n": few["n"], "e": few["e"], "codes": list(codes)})

    codes = checkpoint(classes.mapInPandas(hashed, f"cid long, rep long, n long, e array<{kind}>, codes array<long>"))
    posts = codes.select("cid", F.explode(F.array_distinct("codes")).alias("bucket"))
    sizes = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # Only ids are placed in buckets; the vectors join them afterwards and are dealt once.
    placed = (
        posts.join(sizes, "bucket")
        .withColumn("nb", F.expr(f"cast(ceil(m / {BLOCK}) as int)"))
        .withColumn("own", F.expr("cast(pmod(xxhash64(cid, bucket), nb) as int)"))
        .withColumn(
            "p",
            F.expr(
                "explode(transform(sequence(0, nb - 1), o -> struct(least(o, own) as bi, greatest(o, own) as bj,"
                " cast(o < own as int) as half)))"
            ),
        )
        .select("cid", "bucket", "p.bi", "p.bj", "p.half")
    )
    dealt = placed.join(codes, "cid").select("bucket", "bi", "bj", "half", "cid", "rep", "n", "e", "codes")
    found = checkpoint(
        dealt.repartition(n, "bucket", "bi", "bj")
        .sortWithinPartitions("bucket", "bi", "bj")
        .mapInArrow(_links, "src long, dst long, links long")
    )
    # A vec_id with several vectors is one node: its classes are joined.
    several = rows.where("e is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = rows.join(several, "vec_id", "left_semi").join(classes, "e").selectExpr("vec_id as src", "rep as dst")
    comps = connected_components(found.where("dst is not null").select("src", "dst").unionByName(own))
    # Rows that share a vec_id may be several classes: links are counted by class, not by id.
    counts = found.where("dst is null").groupBy("src").agg(F.sum("links").alias("links"))
    joined = (
        rows.join(classes, "e", "left")
        .join(counts.withColumnRenamed("src", "cid"), "cid", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    )
    return joined.select(
        "vec_id",
        F.expr("coalesce(n - 1, 0L) + coalesce(links, 0L)").alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
