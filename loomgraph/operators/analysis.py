"""Surprises, questions, confidence profiles, snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.community import bridge_reach, cohesion
from loomgraph.operators.graph import degree, enriched_edges, is_concept, is_file_node

#: Relations that hold files together, and the edge weights by confidence.
STRUCTURAL = ("imports", "imports_from", "contains", "method")
CONFIDENCE_SCORE = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}


def surprises(nodes: DataFrame, edges: DataFrame, top_n: int | None = None) -> DataFrame:
    """``src, dst, relation, score, reasons`` of links between files, the most surprising first.

    Confidence counts 3/2/1 (ambiguous most), different file kinds and top directories 2 each, different
    communities 1; a semantic similarity multiplies by 1.5 (cut to whole points) before 1 for a
    peripheral node (degree 2 at most) that meets a hub (5 at least). Inferred calls and uses across
    languages or between code and documents earn nothing for confidence or structure.
    """
    d = degree(nodes, edges)
    rich = nodes.join(d, "id").withColumn("file_node", is_file_node(F.col("label"), F.col("source_file"), F.col("degree")))
    rich = rich.withColumn("concept", is_concept(F.col("source_file")))
    e = enriched_edges(rich, edges, "source_file", "community", "degree", "file_node", "concept")
    e = e.where(
        (F.col("src_source_file") != F.col("dst_source_file")) & ~F.col("relation").isin(*STRUCTURAL)
        & ~F.col("src_file_node") & ~F.col("dst_file_node") & ~F.col("src_concept") & ~F.col("dst_concept")
    )
    kinds = [T.file_category(F.col(f"{x}_source_file")) for x in ("src", "dst")]
    dirs = [T.top_dir(F.col(f"{x}_source_file")) for x in ("src", "dst")]
    family = [T.language_family(F.col(f"{x}_source_file")) for x in ("src", "dst")]
    e = e.withColumns({"k1": kinds[0], "k2": kinds[1], "t1": dirs[0], "t2": dirs[1], "f1": family[0], "f2": family[1]})
    mixed = (F.col("f1").isNotNull() & F.col("f2").isNotNull() & (F.col("f1") != F.col("f2"))) | (
        F.array_sort(F.array("k1", "k2")) == F.array(F.lit("code"), F.lit("doc"))
    )
    void = F.col("relation").isin("calls", "uses") & (F.col("confidence") == "INFERRED") & mixed
    e = e.withColumn("void", void)
    conf = F.when(F.col("void"), 0).when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    kind = F.when(~F.col("void") & (F.col("k1") != F.col("k2")), 2).otherwise(0)
    dirs_ = F.when(~F.col("void") & (F.col("t1") != F.col("t2")), 2).otherwise(0)
    comm = F.when(~F.col("void") & (F.col("src_community") != F.col("dst_community")), 1).otherwise(0)
    base = conf + kind + dirs_ + comm
    lifted = F.when(F.col("relation") == "semantically_similar_to", F.floor(base * 1.5)).otherwise(base)
    low, high = F.least("src_degree", "dst_degree"), F.greatest("src_degree", "dst_degree")
    hub = F.when((low <= 2) & (high >= 5), 1).otherwise(0)
    reasons = F.array_compact(
        F.array(
            F.when(conf > 1, F.concat(F.lower("confidence"), F.lit(" link"))),
            F.when(kind > 0, F.lit("crosses file kinds")),
            F.when(dirs_ > 0, F.lit("crosses directories")),
            F.when(comm > 0, F.lit("crosses communities")),
            F.when(hub > 0, F.lit("peripheral node meets hub")),
        )
    )
    out = e.select("src", "dst", "relation", (lifted + hub).cast("long").alias("score"), F.concat_ws("; ", reasons).alias("reasons"))
    return out.orderBy(F.desc("score"), "src", "dst", "relation").limit(top_n) if top_n else out


def confidence_mode(edges: DataFrame) -> DataFrame:
    """``id, confidence``: the most frequent confidence of a node's edges (ties: first by name)."""
    e = edges.select(F.explode(F.array("src", "dst")).alias("id"), "confidence")
    c = e.groupBy("id", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "confidence")).alias("m")).select("id", F.col("m.confidence").alias("confidence"))


def graph_diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, directed: bool = False) -> DataFrame:
    """``kind, change, a, b, relation``: nodes and edges added and removed; edges by pair and relation."""
    def keys(e: DataFrame) -> DataFrame:
        a, b = ("src", "dst") if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        return e.select(a.alias("a"), b.alias("b"), "relation")

    def ids(n: DataFrame) -> DataFrame:
        return n.select(F.col("id").alias("a"))

    none = F.lit(None).cast("string")
    tagged = None
    for tag, n, e in ((1, old_nodes, old_edges), (2, new_nodes, new_edges)):
        both = ids(n).select(F.lit("node").alias("kind"), "a", none.alias("b"), none.alias("relation"))
        both = both.unionByName(keys(e).select(F.lit("edge").alias("kind"), "a", "b", "relation")).withColumn("tag", F.lit(tag))
        tagged = both if tagged is None else tagged.unionByName(both)
    # one shuffle: a key that both sides have carries both tags
    sides = tagged.groupBy("kind", "a", "b", "relation").agg(F.bit_or("tag").alias("tag")).where("tag < 3")
    return sides.select("kind", F.when(F.col("tag") == 2, "added").otherwise("removed").alias("change"), "a", "b", "relation")


def diff_summary(diff: DataFrame) -> str:
    """One line of English for a difference."""
    n = {(r["kind"], r["change"]): r["n"] for r in diff.groupBy("kind", "change").agg(F.count(F.lit(1)).alias("n")).collect()}
    said = []
    for kind, change, word in (("node", "added", "new"), ("edge", "added", "new"), ("node", "removed", "removed"), ("edge", "removed", "removed")):
        if k := n.get((kind, change), 0):
            said.append(f"{k} {word} {kind}{'s' if k != 1 else ''}" if word == "new" else f"{k} {kind}{'s' if k != 1 else ''} removed")
    return ", ".join(said) or "no changes"


def file_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_file, fact``: ids of a file's nodes, and its edges under both ends' files; facts may repeat."""
    n = nodes.select("source_file", F.col("id").alias("fact"))
    e = enriched_edges(nodes, edges, "source_file")
    fact = F.concat_ws("|", "src", "relation", "dst")
    e = e.select(F.explode(F.array_distinct(F.array("src_source_file", "dst_source_file"))).alias("source_file"), fact.alias("fact"))
    return n.unionByName(e)


def changed_files(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``source_file``: files whose sets of facts differ between two (nodes, edges) snapshots."""
    both = file_facts(*old).withColumn("tag", F.lit(1)).unionByName(file_facts(*new).withColumn("tag", F.lit(2)))
    return both.groupBy("source_file", "fact").agg(F.bit_or("tag").alias("tag")).where("tag < 3").select("source_file").distinct()


def contract_check(changed: DataFrame, predicted: DataFrame) -> DataFrame:
    """``source_file, place``, place: inside or outside of the prediction, or untouched, with the overall ``verdict``."""
    c = changed.select("source_file", F.lit(True).alias("c"))
    p = predicted.select("source_file", F.lit(True).alias("p")).distinct()
    j = c.join(p, "source_file", "full")
    place = F.when(F.col("c").isNull(), "untouched").when(F.col("p").isNull(), "outside").otherwise("inside")
    j = j.select("source_file", place.alias("place"))
    w = Window.partitionBy(F.lit(0))
    g = j.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.coalesce(F.sum(F.when(F.col("place") == "outside", F.col("n"))), F.lit(0)).alias("o"), F.coalesce(F.sum(F.when(F.col("place") != "untouched", F.col("n"))), F.lit(0)).alias("t"))
    verdict = F.when(F.col("t") == 0, "NO_CHANGES").when(F.col("o") > 0, "DEVIATION").otherwise("CLEAN")
    return j.join(F.broadcast(total.select(verdict.alias("verdict"))))  # one row


def suggested_questions(nodes: DataFrame, edges: DataFrame, members: DataFrame, limit: int = 7) -> DataFrame:
    """``section, rank, subject``: what is worth asking, by section; ``no_signal`` where nothing is."""
    d = degree(nodes, edges)
    real = nodes.join(d, "id").where(~is_concept(F.col("source_file")) & ~is_file_node(F.col("label"), F.col("source_file"), F.col("degree")))

    def ranked(df: DataFrame, section: str, order: list, n: int) -> DataFrame:
        top = df.orderBy(*order).limit(n)
        return top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("subject"))

    amb = edges.where("confidence = 'AMBIGUOUS'").select(F.concat_ws("|", "src", "relation", "dst").alias("subject"))
    bridges = bridge_reach(edges, members).join(real.select("id"), "id").select(F.col("id").alias("subject"), "reach")
    inferred = edges.where("confidence = 'INFERRED'").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    top = real.select("id", "degree").orderBy(F.desc("degree"), "id").limit(5).join(inferred, "id").where("k >= 2").select(F.col("id").alias("subject"), "degree")
    lonely = real.where("degree <= 1").select(F.col("id").alias("subject"))
    loose = cohesion(edges, members).where("cohesion < 0.15 and n_nodes >= 5").select(F.col("community").cast("string").alias("subject"), "cohesion")
    parts = [
        ranked(amb, "1_ambiguous_edge", ["subject"], limit),
        ranked(bridges, "2_bridge_node", [F.desc("reach"), "subject"], 3),
        ranked(top, "3_verify_inferred", [F.desc("degree"), "subject"], limit),
        ranked(lonely, "4_isolated", ["subject"], limit),
        ranked(loose, "5_low_cohesion", ["cohesion", "subject"], limit),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.orderBy("section", "rank").limit(limit)
    spark = nodes.sparkSession
    none = spark.range(1).select(F.lit("no_signal").alias("section"), F.lit(1).alias("rank"), F.lit("").alias("subject"))
    return out.unionByName(none.join(out.limit(1).select(F.col("section").alias("_s")), F.col("_s").isNotNull(), "left_anti"))


def edge_usefulness(relation: Column, confidence: Column, score: Column | None = None) -> Column:
    """Worth of an edge in a diagram."""
    base = F.coalesce(score, T.by_map(confidence, CONFIDENCE_SCORE)) if score is not None else T.by_map(confidence, CONFIDENCE_SCORE)
    bonus = (
        F.when(confidence == "EXTRACTED", 2.0).otherwise(0.0)
        + F.when(relation.isin("calls", "uses", "method"), 1.0)
        .when(relation.isin("imports", "imports_from"), 0.6)
        .when(relation == "contains", -0.2)
        .when(relation == "rationale_for", -0.6)
        .otherwise(0.0)
    )
    return F.round(base + bonus, 6)


def edge_score_sum(edges: DataFrame) -> DataFrame:
    """``id, score``: usefulness summed over a node's edges."""
    s = edges.select(F.explode(F.array("src", "dst")).alias("id"), edge_usefulness(F.col("relation"), F.col("confidence")).alias("s"))
    return s.groupBy("id").agg(F.round(F.sum("s"), 4).alias("score"))


def section_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src_section, dst_section, n, top_relation`` by top directory of both ends' files."""
    n = nodes.select("id", T.top_dir(F.col("source_file")).alias("section"))
    e = enriched_edges(n, edges, "section").where("src_section <> dst_section")
    g = e.groupBy("src_section", "dst_section", "relation").agg(F.count(F.lit(1)).alias("k"))
    return g.groupBy("src_section", "dst_section").agg(
        F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "relation")).getField("relation").alias("top_relation")
    )
