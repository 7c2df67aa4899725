"""Connected components by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import checkpoint

#: A node with more than this many edges, and more than 1/1000 of all, is joined by broadcast.
HEAVY = 512


def _with_low(rows: DataFrame, edges: int) -> DataFrame:
    """``u, v, m``: the rows with the smallest v of each u.

    The roots of large components have most of the edges. There are at most 2000 such nodes, which
    a broadcast of that size brings to the edges, so that no task gets all edges of a root.
    """
    limit = max(HEAVY, edges // 1000)
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    heavy = low.where(F.col("n") > limit).select(F.col("u").alias("hu"), F.col("m").alias("hm"))
    marked = rows.join(F.broadcast(heavy), F.col("u") == F.col("hu"), "left")
    light = marked.where("hu is null").select("u", "v").join(low.where(F.col("n") <= limit).select("u", "m"), "u")
    return light.unionByName(marked.where("hu is not null").select("u", "v", F.col("hm").alias("m")))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _with_low(both, n)
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger end down, and after a large star few of them leave a node."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge; component is the smallest node reachable.

    Self-loops yield a component of one, null endpoints are dropped, an empty frame gives no
    rows. Each round is a constant number of shuffles over at most as many rows as there are
    edges and is checkpointed; nothing but a row count and a checksum reaches the driver.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    given = checkpoint(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = given.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    cur = given.where("u <> v")
    n, seen = cur.count(), None
    for _ in range(max_rounds):
        nxt = checkpoint(_small_star(_large_star(cur, n)))
        mark = nxt.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.expr("sum(xxhash64(u, v) % 1000000007)"), F.lit(0)).alias("h")
        ).first()
        cur, n = nxt, mark["n"]
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("star contraction did not settle")
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
