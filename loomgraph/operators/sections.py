"""Diagram material: which edges are worth drawing, sections by keywords, node picks, flow chains, notes, reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.analysis import edge_score_sum, section_edges
from loomgraph.operators.community import bridge_reach, cohesion
from loomgraph.operators.graph import degree, enriched_edges
from loomgraph.operators.iterate import bfs

#: Least score of an inferred edge, relations worth drawing first and second.
MIN_SCORE = 0.85
PRIMARY, SECONDARY = ("calls", "uses", "method", "inherits", "implements"), ("imports", "imports_from", "references")


def drawable(edges: DataFrame) -> DataFrame:
    """Extracted edges, and inferred ones with a score of 0.85 at least."""
    score = F.col("confidence_score") if "confidence_score" in edges.columns else F.lit(0.5)
    return edges.where((F.col("confidence") == "EXTRACTED") | ((F.col("confidence") == "INFERRED") & (score >= MIN_SCORE)))


def preferred(edges: DataFrame) -> DataFrame:
    """Edges of primary relations; without any also the secondary ones; without those all."""
    level = F.when(F.col("relation").isin(*PRIMARY), 2).when(F.col("relation").isin(*SECONDARY), 1).otherwise(0)
    top = edges.agg(F.max(level).alias("top"))
    return edges.withColumn("_l", level).join(F.broadcast(top), F.col("_l") >= F.col("top")).drop("_l", "top")


def keyword_sections(nodes: DataFrame, members: DataFrame, archetypes: dict[str, list[str]], least: int = 2, sample: int = 80) -> DataFrame:
    """``community, section, hits``: the archetype whose words the labels of a community hold most often.

    The first ``sample`` nodes by id speak for a community; archetypes go by their order on ties; ``least`` hits are needed.
    """
    w = Window.partitionBy("community").orderBy("id")
    n = nodes.drop("community").join(members, "id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample)
    t = n.select("community", F.explode(X.tokens(F.concat_ws(" ", "label", "source_file"))).alias("tok"))
    words = [(w_, name, i) for i, (name, ws) in enumerate(archetypes.items()) for w_ in ws]
    a = nodes.sparkSession.createDataFrame(words, "tok string, section string, ord int")
    g = t.join(F.broadcast(a), "tok").groupBy("community", "section", "ord").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    best = g.groupBy("community").agg(F.min(F.struct((-F.col("hits")).alias("h"), "ord", "section")).alias("m"))
    return best.select("community", "m.section", (-F.col("m.h")).alias("hits"))


def ranked_sections(sections: DataFrame, top_n: int) -> DataFrame:
    """``section, n, rank``; sections beyond the first ``top_n`` become "other"."""
    g = sections.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    r = g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "section")))
    return r.groupBy(F.when(F.col("rank") <= top_n, F.col("section")).otherwise("other").alias("section")).agg(F.sum("n").alias("n"), F.min("rank").alias("rank"))


def diagram_nodes(nodes: DataFrame, edges: DataFrame, max_nodes: int = 40, entries: int = 8) -> list[str]:
    """Ids to draw: entry points by outgoing surplus, then ends of the strongest edges, then by score.

    The candidates are ranked in the cluster and cut to what can be drawn before they come to the driver.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    inn = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    d = nodes.select("id").join(out, "id", "left").join(inn, "id", "left").fillna(0, ["o", "i"])
    first = [r["id"] for r in d.where("o > 0").orderBy(F.desc(F.col("o") - F.col("i")), F.desc("o"), "id").limit(entries).collect()]
    s = edge_score_sum(edges)
    strong = enriched_edges(s.select("id", "score"), edges, "score").orderBy(F.desc(F.col("src_score") + F.col("dst_score")), "src", "dst", "relation").limit(max_nodes).collect()
    rest = [r["id"] for r in s.orderBy(F.desc("score"), "id").limit(max_nodes).collect()]
    order = [*first, *(x for r in strong for x in (r["src"], r["dst"])), *rest]
    return list(dict.fromkeys(order))[:max_nodes]


def flow_chain(nodes: DataFrame, edges: DataFrame, limit: int = 12) -> list[str]:
    """Sections in the order of a greedy walk along the most frequent transitions; the table has one row for each pair."""
    rows = section_edges(nodes, edges).orderBy(F.desc("n"), "src_section", "dst_section").limit(10_000).collect()
    if not rows:
        return []
    chain = [rows[0]["src_section"]]
    while len(chain) < limit:
        nxt = next((r["dst_section"] for r in rows if r["src_section"] == chain[-1] and r["dst_section"] not in chain), None)
        if nxt is None:
            break
        chain.append(nxt)
    return chain


def community_notes(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """``community, n_nodes, cohesion, band, bridges``: contents of a community's note; five bridge nodes by reach and degree."""
    c = cohesion(edges, members)
    band = F.when(F.col("cohesion") >= 0.7, "tight").when(F.col("cohesion") >= 0.4, "moderate").otherwise("loose")
    b = bridge_reach(edges, members).join(members, "id").join(degree(nodes, edges), "id")
    w = Window.partitionBy("community").orderBy(F.desc("reach"), F.desc("degree"), "id")
    top = b.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("t"))
    top = top.select("community", F.array_join(F.transform("t", lambda x: x["id"]), ", ").alias("bridges"))
    return c.select("community", "n_nodes", "cohesion", band.alias("band")).join(top, "community", "left").withColumn("bridges", F.coalesce("bridges", F.lit("")))


def token_reduction(nodes: DataFrame, edges: DataFrame, corpus_words: int, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``corpus_tokens, subgraph_tokens, ratio``: how much smaller an answer's subgraph is than the corpus."""
    sub = nodes.join(bfs(nodes, edges, seeds, depth), "id")
    t = sub.agg(F.coalesce(F.sum(X.token_estimate(F.concat_ws(" ", "label", "source_file"))), F.lit(0)).alias("subgraph_tokens"))
    corpus = F.lit(corpus_words * 100 // 75)
    return t.select(corpus.cast("long").alias("corpus_tokens"), "subgraph_tokens", F.round(corpus / F.greatest(F.lit(1), "subgraph_tokens"), 1).alias("ratio"))


def nearest_symbols(names: DataFrame, space: DataFrame, least: float = 0.7, top_n: int = 3) -> DataFrame:
    """``name, symbol, ratio``: up to three symbols like an unknown name, by edit distance over the longer length.

    Candidates share a trigram with the name, which every pair above the bar of names of six letters does.
    """
    a = names.select("name", F.explode(X.trigrams(F.lower("name"))).alias("g"))
    b = space.select(F.col("name").alias("symbol")).distinct().select("symbol", F.explode(X.trigrams(F.lower("symbol"))).alias("g"))
    p = a.join(b, "g").select("name", "symbol").distinct().where("name <> symbol")
    ratio = 1 - F.levenshtein(F.lower("name"), F.lower("symbol")) / F.greatest(F.length("name"), F.length("symbol"))
    w = Window.partitionBy("name").orderBy(F.desc("ratio"), "symbol")
    return p.withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= least).withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_n).drop("k")


def scar_summary(scars: DataFrame, couples: DataFrame, top_n: int = 5) -> DataFrame:
    """``kind, rank, path, detail``: the most dangerous files and the tightest couples."""
    d = scars.where("danger > 0").orderBy(F.desc("danger"), F.desc("edits"), "path").limit(top_n)
    d = d.select(F.lit("danger").alias("kind"), F.row_number().over(Window.orderBy(F.desc("danger"), F.desc("edits"), "path")).alias("rank"), "path", F.col("danger").cast("string").alias("detail"))
    c = couples.where("path < partner").orderBy(F.desc("confidence"), F.desc("support"), "path", "partner").limit(top_n)
    c = c.select(F.lit("couple").alias("kind"), F.row_number().over(Window.orderBy(F.desc("confidence"), F.desc("support"), "path", "partner")).alias("rank"), "path", F.col("partner").alias("detail"))
    return d.unionByName(c)
