"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash, and the blocks are permuted. A source's quota is
whole passes over all its blocks plus a run of permuted blocks, the last of which is cut to the
word. The tree splits the vector of block draws in halves, recursively, until each output shard has
its exact number from each source; shards draw disjoint runs and shuffle their rows locally.

Blocks, draws and targets are rows of DataFrames. The driver holds one number for each of at most BUCKETS runs of
neighbouring sources, which the tree splits; a run of several sources deals its shares out by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.grouping import unused
from loomgraph.runtime import checkpoint, numbered

#: Weights of sources by rank, the share of all words to draw, and the most passes over a source.
WEIGHTS, SHARE, PASSES = (5.0, 2.0, 1.0), 1.5, 2.0
#: Least blocks of a source, words of a block (larger sources get more blocks), output shards, seed of every permutation.
BLOCKS, BLOCK_WORDS, SHARDS, SEED = 256, 20_000_000, 64, 7
#: Words in a file of a shard, about: a shard of more is shuffled in so many parts.
PART_WORDS = 20_000_000
#: Sources whose targets are worked out, or which are broadcast, in one piece; and runs of sources that the tree splits.
FEW_SOURCES, BUCKETS = 100_000, 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int]) -> list[float]:
    """Words to draw from each source, in their order: shares by weight, at most PASSES times its size.

    What a full source can't take goes to the others by weight, until none is above its limit.
    """
    n = len(sizes)
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(n)]
    out = [0.0] * n
    free, left = set(range(n)), SHARE * sum(sizes)
    while free:
        total = sum(weight[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weight[i] / total > PASSES * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = PASSES * sizes[i]
            left -= out[i]
            free.discard(i)
        left = max(left, 0.0)
    return out


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Row s: how many draws of each source shard s gets; columns add up to ``quota``."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    n = int(quota.sum())
    take = np.zeros_like(quota)
    need, rest = n * left // shards, n
    for i, k in enumerate(quota):  # multivariate hypergeometric, one source after another
        k = int(k)
        rest -= k
        if need and k:
            take[i] = rng.hypergeometric(k, rest, need) if rest else need
            need -= int(take[i])
    return np.concatenate((split_tree(take, left, rng), split_tree(quota - take, shards - left, rng)))


def wide_targets(ranked: DataFrame) -> DataFrame:
    """``targets`` for any number of sources: rows (rank, words) with a column ``target``, one pass for each resharing."""
    weights = F.array(*map(F.lit, WEIGHTS))
    cur = ranked.withColumn("weight", F.get(weights, F.pmod("rank", F.lit(len(WEIGHTS))).cast("int"))).withColumn("target", F.lit(None).cast("double"))
    left = SHARE * (cur.agg(F.sum("words")).first()[0] or 0)
    while True:
        total = cur.where("target is null").agg(F.sum("weight")).first()[0]
        if total is None:
            break
        over = F.col("target").isNull() & (F.lit(left) * F.col("weight") / F.lit(total) > F.lit(PASSES) * F.col("words"))
        cur = checkpoint(cur.withColumn("full", over).withColumn("target", F.when(F.col("full"), F.lit(PASSES) * F.col("words")).otherwise(F.col("target"))))
        gone = cur.where("full").agg(F.sum("target")).first()[0]
        if gone is None:
            cur = cur.withColumn("target", F.coalesce("target", F.lit(left) * F.col("weight") / F.lit(total)))
            break
        left, cur = max(left - gone, 0.0), cur.drop("full")
    return cur.drop("weight", "full")


@dataclass
class Plan:
    """``targets``: rank, source, words, target, nb (blocks). ``draws``: rank, block, turn, words to draw, shard."""

    targets: DataFrame
    draws: DataFrame
    sizes: DataFrame  # doc_id, rank, block, size and the two hashes of each row
    parts: int  # files of a shard


def _row_hashes() -> tuple[F.Column, F.Column]:
    """128 bits that only equal rows (doc_id, source, text) share."""
    flagged = [x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(SEED), *flagged), F.xxhash64(F.lit(SEED + 1), *reversed(flagged))


def _shares(quota: DataFrame, n_sources: int) -> DataFrame:
    """``rank, ends``: for each source, where the runs of its draws end that the shards take, by the tree."""
    spark = quota.sparkSession
    per = -(-n_sources // BUCKETS)
    runs = quota.groupBy(F.expr(f"cast(rank div {per} as int)").alias("run")).agg(F.sum("n").alias("n"))
    tops = sorted((r["run"], r["n"]) for r in runs.collect())  # at most BUCKETS rows
    if not tops:
        return spark.createDataFrame([], "rank long, ends array<long>")
    tree = split_tree(np.array([n for _, n in tops], dtype=np.int64), SHARDS, np.random.default_rng(SEED))
    if per == 1:
        rows = [(run, np.cumsum(tree[:, i]).tolist()) for i, (run, _) in enumerate(tops)]
        return spark.createDataFrame(rows, "rank long, ends array<long>")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        rng = np.random.default_rng([SEED, int(pdf["run"].iloc[0])])
        left, ends = np.array(pdf["top"].iloc[0]), []
        for n in pdf["n"]:  # what is left of each shard's share of the run
            take = rng.multivariate_hypergeometric(left, int(n), method="marginals")
            left = left - take
            ends.append(np.cumsum(take).tolist())
        return pd.DataFrame({"rank": pdf["rank"], "ends": ends})

    top = spark.createDataFrame([(run, tree[:, i].tolist()) for i, (run, _) in enumerate(tops)], "run int, top array<long>")
    split = quota.withColumn("run", F.expr(f"cast(rank div {per} as int)")).join(F.broadcast(top), "run")
    return split.groupBy("run").applyInPandas(deal, "rank long, ends array<long>")


def plan_mix(docs: DataFrame) -> Plan:
    spark = docs.sparkSession
    given = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string"))))
    g, h = _row_hashes()
    rows = checkpoint(
        given.select(
            "doc_id", "source", g.alias("g"), h.alias("h"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("words"))
    ranked = numbered(sources, [F.col("source").isNull(), "source"], "rank").withColumn("rank", F.col("rank").cast("long"))
    n = ranked.count()
    if n <= FEW_SOURCES:
        known = sorted(ranked.collect(), key=lambda r: r["rank"])
        goal = [(r["rank"], r["source"], r["words"], t) for r, t in zip(known, targets([r["words"] for r in known]))]
        goal = F.broadcast(spark.createDataFrame(goal, "rank long, source string, words long, target double"))
    else:
        goal = checkpoint(wide_targets(ranked))
    goal = goal.withColumn("nb", F.greatest(F.lit(BLOCKS), F.ceil(F.col("words") / BLOCK_WORDS)).cast("long"))
    s = goal.select(F.col("source").alias("s"), "rank", "nb")
    sizes = rows.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    sizes = sizes.withColumn("block", F.pmod("g", "nb")).drop("nb")
    order = Window.partitionBy("rank").orderBy("turn", "perm", "block")
    draws = (
        sizes.groupBy("rank", "block")
        .agg(F.sum("size").alias("w"))
        .where("w > 0")
        .withColumn("perm", F.xxhash64(F.lit(SEED + 2), "rank", "block"))
        .withColumn("before", F.sum("w").over(Window.partitionBy("rank").orderBy("perm", "block")) - F.col("w"))
        .join(goal.select("rank", F.col("words").alias("all"), F.rint("target").cast("long").alias("t")), "rank")
        .withColumn("turn", F.explode(F.expr("sequence(0, cast(t div all as int))")))
        .withColumn("words", F.expr("least(w, t - turn * all - before)"))
        .where("words > 0")
        .withColumn("place", F.row_number().over(order) - 1)
        .select("rank", "block", "turn", "words", "place")
    )
    draws = checkpoint(draws)
    quota = draws.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    shares = _shares(quota, n)
    draws = draws.join(F.broadcast(shares) if n <= FEW_SOURCES else shares, "rank").select(
        "rank", "block", "turn", "words", F.expr("size(filter(ends, e -> e <= place))").alias("shard")
    )
    total = draws.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    return Plan(goal, draws, sizes, max(1, -(-total // (SHARDS * PART_WORDS))))


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    """Words taken of each row of one cut block: its rows in a fixed random order until it is full."""
    pdf = pdf.sort_values(["h", "g", "size"], kind="stable")
    before = pdf["size"].cumsum() - pdf["size"]
    pdf["taken"] = np.clip(pdf["words"].to_numpy() - before.to_numpy(), 0, pdf["size"].to_numpy())
    return pdf[["g", "h", "turn", "shard", "taken"]]


def _takes(plan: Plan) -> DataFrame:
    """``g, h, draws``: for each distinct row, its draws (turn, shard, words taken of all its copies).

    Only a block that is cut (one at most of each source) needs the order of its rows; it is summed
    up in sub-blocks first, so that no task holds more of it than one sub-block.
    """
    whole = plan.sizes.groupBy("rank", "block").agg(F.sum("size").alias("all"))
    draws = plan.draws.join(whole, ["rank", "block"])
    full = draws.where("words = all").select("rank", "block", "turn", "shard")
    part = draws.where("words < all").select("rank", "block", "turn", "shard", "words")
    sizes = plan.sizes.where("size > 0")
    out = sizes.join(full, ["rank", "block"]).select("g", "h", "turn", "shard", F.col("size").alias("taken"))
    inner = sizes.join(part, ["rank", "block"]).withColumn("sub", F.expr("cast(pmod(h, 1024) as int)"))
    sums = inner.groupBy("rank", "block", "turn", "sub").agg(F.sum("size").alias("s"))
    before = sums.selectExpr(
        "rank", "block", "turn", "sub",
        "sum(s) over (partition by rank, block, turn order by sub) - s as before",
    )  # at most 1024 rows of each cut block
    inner = inner.join(before, ["rank", "block", "turn", "sub"]).withColumn("words", F.col("words") - F.col("before"))
    cut = inner.groupBy("rank", "block", "turn", "sub").applyInPandas(_cut, "g long, h long, turn int, shard int, taken long")
    taken = out.unionByName(cut).where("taken > 0").groupBy("g", "h", "turn", "shard").agg(F.sum("taken").alias("taken"))
    # a row is in one block, which one shard draws in each of at most PASSES + 1 turns
    return taken.groupBy("g", "h").agg(F.array_sort(F.collect_list(F.struct("turn", "shard", "taken"))).alias("draws"))


#: What the k-th of n equal rows takes of their t words.
_MINE = "cast(x.taken div n + cast(k <= x.taken % n as int) as long)"


def _copies(rows: DataFrame, g: str, h: str, k: str, n: str) -> DataFrame:
    """``rows`` with the number of each among its equals and how many those are."""
    w = Window.partitionBy(g, h)
    return rows.withColumn(k, F.row_number().over(w.orderBy(g))).withColumn(n, F.count(F.lit(1)).over(w))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, draws`` for each row of ``docs`` (doc_id, source, text, ...).

    ``draws``: the shards that the tree deals the document to, as pass:shard:words by pass, comma-joined. A null
    source is a source of its own, the last. A null text has no words; a document without
    words takes none. Equal rows share what is taken evenly in whole words; rows that share a doc_id and differ
    count apart. An empty table gives no rows. Other columns are ignored.
    """
    plan = plan_mix(docs)
    rows = _copies(plan.sizes.select("doc_id", "rank", "size", "g", "h"), "g", "h", "k", "n")
    mine = f"filter(transform(coalesce(draws, array()), x -> struct(x.turn as turn, x.shard as shard, {_MINE} as words)), x -> x.words > 0)"
    return (
        rows.join(_takes(plan), ["g", "h"], "left")
        .withColumn("d", F.expr(mine))
        .join(plan.targets.select("rank", F.col("words").alias("source_size"), "target"), "rank")
        .selectExpr(
            "doc_id", "size", "source_size", "target",
            "aggregate(d, 0L, (a, x) -> a + x.words) as taken",
            "array_join(transform(d, x -> concat_ws(':', x.turn, x.shard, x.words)), ',') as draws",
        )
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one row for each pass over a document.

    The order is the shards', shuffled within each. A row whose document is cut keeps its first
    words, joined by one space. ``n_chars`` is brought up to date where there is one. Null ids and sources, and
    repeated rows, are as in ``mixed_sizes``; an empty table gives no rows, and columns may have any names.
    """
    plan = plan_mix(docs)
    g, h, k, n, draws, draw, size, shard, order = (unused(docs, c) for c in ("_g", "_h", "_k", "_n", "_draws", "_draw", "_words", "_shard", "_order"))
    one, two = _row_hashes()
    typed = docs.withColumns({c: F.col(c).cast(t) for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string"))})
    hashed = typed.withColumns({g: one, h: two, size: F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")})
    takes = _takes(plan).select(F.col("g").alias(g), F.col("h").alias(h), F.col("draws").alias(draws))
    joined = _copies(hashed.join(takes, [g, h]), g, h, k, n).withColumn(draw, F.explode(draws))
    mine = F.expr(_MINE.replace("x.taken", f"`{draw}`.taken").replace("div n", f"div `{n}`").replace("k <=", f"`{k}` <=").replace("% n", f"% `{n}`"))
    joined = joined.withColumn(draws, mine).where(F.col(draws) > 0)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shorter = F.array_join(F.slice(words, F.lit(1), F.col(draws).cast("int")), " ")
    out = joined.withColumn("text", F.when(F.col(draws) < F.col(size), shorter).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    out = out.withColumns({order: F.xxhash64(F.lit(SEED + 3), g, k, F.col(draw)["turn"]), shard: F.col(draw)["shard"]})
    part = F.pmod(order, F.lit(plan.parts))
    kept = [F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return out.repartition(F.col(shard), part).sortWithinPartitions(shard, order).select(*kept)
