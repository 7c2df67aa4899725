"""Exports: node-link JSON, Cypher, GraphML, display payloads, trees, articles, reports, logs."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import analysis, community
from loomgraph.operators.graph import both_directions, degree, enriched_edges, graph_stats, hub_nodes

#: Nodes above which a display shows communities, and default confidence scores.
DISPLAY_LIMIT = 5000
_IDENT = re.compile(r"[^A-Za-z0-9_]")


def export_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``norm_label``, edges with a default ``confidence_score``; keys that start with ``_`` go."""
    n = nodes.withColumn("norm_label", X.norm_label(F.col("label"))).drop(*[c for c in nodes.columns if c.startswith("_")])
    score = X.by_map(F.coalesce("confidence", F.lit("EXTRACTED")), analysis.CONFIDENCE_SCORE)
    own = F.col("confidence_score") if "confidence_score" in edges.columns else F.lit(None).cast("double")
    e = edges.withColumn("confidence_score", F.coalesce(own, score)).drop(*[c for c in edges.columns if c.startswith("_")])
    return n, e


def _content(df: DataFrame) -> tuple:
    """Number and digest of the lines of a table, whatever their order."""
    h = [F.sum(F.xxhash64(F.lit(seed), "value").cast("decimal(38,0)")) for seed in (0, 1)]
    return tuple(df.agg(F.count(F.lit(1)), *h).first())


def backup_graph(spark, path: str, stamp: str, always: bool = False) -> str | None:
    """Copy the snapshot under ``path`` to ``path/backup/stamp`` and return that folder; without a snapshot None.

    Only a curated graph is copied unless ``always``: one in which a community has a name other than ``Community <n>``.
    An equal copy stays, another one of the same stamp is replaced.
    """
    def lines(folder: str) -> DataFrame | None:
        try:
            return spark.read.text(folder)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            return None

    now = {part: lines(f"{path}/{part}") for part in ("nodes", "edges")}
    if now["nodes"] is None:
        return None
    if not always:
        named = F.get_json_object("value", "$.community_name"), F.get_json_object("value", "$.community")
        if now["nodes"].where(named[0].isNotNull() & (named[0] != F.concat(F.lit("Community "), F.coalesce(named[1], F.lit(""))))).isEmpty():
            return None
    folder = f"{path}/backup/{stamp}"
    for part, df in now.items():
        old = lines(f"{folder}/{part}")
        if df is not None and (old is None or _content(old) != _content(df)):
            df.write.mode("overwrite").text(f"{folder}/{part}")
    return folder


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False, backup: str | None = None) -> None:
    """JSON lines under ``path/nodes`` and ``path/edges``; refuses to write fewer nodes than are there.

    With a stamp as ``backup`` a curated snapshot is copied before it is replaced.
    """
    spark = nodes.sparkSession
    n, e = export_rows(nodes, edges)
    if not force:
        try:
            before = spark.read.json(f"{path}/nodes").count()
        except Exception as err:  # no snapshot yet
            if "PATH_NOT_FOUND" not in str(err):
                raise
            before = 0
        if n.count() < before:
            raise ValueError(f"refusing to replace {before} nodes by fewer; use force")
    if backup:
        backup_graph(spark, path, backup)
    n.write.mode("overwrite").json(f"{path}/nodes")
    e.write.mode("overwrite").json(f"{path}/edges")


def _quoted(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\")
    return F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, "'", r"\\'"), r"[\r\n]+", " "), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``statement``: a MERGE for each node and edge; labels and types keep letters, digits and underscores."""
    ident = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    n = nodes.select(F.concat(F.lit("MERGE (n:"), ident(F.initcap("file_type")), F.lit(" {id: "), _quoted(F.col("id")), F.lit("}) SET n.label = "), _quoted(F.col("label")), F.lit(";")).alias("statement"))
    e = edges.select(
        F.concat(
            F.lit("MATCH (a {id: "), _quoted(F.col("src")), F.lit("}), (b {id: "), _quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"),
            ident(F.upper("relation")), F.lit(" {confidence: "), _quoted(F.col("confidence")), F.lit("}]->(b);"),
        ).alias("statement")
    )
    return n.unionByName(e)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``line``: the elements of a GraphML document between its header and footer."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    comm = F.coalesce(F.col("community").cast("string"), F.lit("-1"))
    n = nodes.select(F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"><data key="label">'), esc(F.col("label")), F.lit('</data><data key="community">'), comm, F.lit("</data></node>")).alias("line"))
    e = edges.select(F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"><data key="relation">'), esc(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def display_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, size, show_label``: sizes from 10 to 40 by degree; labels for the better connected."""
    d = degree(nodes, edges)
    top = F.greatest(F.lit(1), F.max("degree").over(Window.partitionBy()))
    # the largest degree is one number: a join with one row, not a window over all rows
    best = d.agg(F.greatest(F.lit(1), F.max("degree")).alias("top"))
    j = d.join(F.broadcast(best))
    return j.select("id", F.round(10 + 30 * F.col("degree") / F.col("top"), 1).alias("size"), (F.col("degree") >= 0.15 * F.col("top")).alias("show_label"))


def display_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "relation", (F.coalesce("confidence", F.lit("EXTRACTED")) != "EXTRACTED").alias("dashed"))


def path_rollup(paths: DataFrame) -> DataFrame:
    """``prefix, depth, n``: leaf counts (path, n) added up over every folder above them."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"), k.alias("depth")))
    e = paths.where(F.size(parts) > 0).select(F.explode(levels).alias("p"), F.greatest(F.lit(1), "n").alias("n"))
    return e.groupBy("p.prefix", "p.depth").agg(F.sum("n").alias("n"))


def community_articles(nodes: DataFrame, edges: DataFrame, members: DataFrame, top_n: int = 25) -> DataFrame:
    """``community, title, top, links, sources``: the contents of an article for each community."""
    d = nodes.drop("community").join(members, "id").join(degree(nodes, edges), "id")
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    top = d.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_n)
    top = top.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("t")).select("community", F.array_join(F.transform("t", lambda x: x["label"]), ", ").alias("top"))
    meta = community.meta_graph(edges, members)
    both = meta.unionByName(meta.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    lw = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    links = both.withColumn("k", F.row_number().over(lw)).where("k <= 12").groupBy(F.col("src").alias("community")).agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", "dst", "weight").alias("l")))).alias("t"))
    links = links.select("community", F.array_join(F.transform("t", lambda x: x["l"]), ", ").alias("links"))
    src = d.select("community", "source_file").distinct().withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("source_file"))).where("k <= 20")
    src = src.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("source_file")), ", ").alias("sources"))
    title = community.hub_labels(nodes, edges, members).select("community", F.col("label").alias("title"))
    return title.join(top, "community").join(links, "community", "left").join(src, "community", "left")


def hub_article(nodes: DataFrame, edges: DataFrame, node: str, per_relation: int = 20) -> DataFrame:
    """``relation, rank, id``: the neighbours of a hub by relation."""
    e = both_directions(edges.select("src", "dst", "relation")).where(F.col("a") == node).select("relation", F.col("b").alias("id")).distinct()
    w = Window.partitionBy("relation").orderBy(F.desc("degree"), "id")
    return e.join(degree(nodes, edges), "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_relation).select("relation", "rank", "id")


def safe_names(labels: DataFrame) -> DataFrame:
    """``id, name``: file names without reserved characters, 200 bytes at most, unique whatever the case.

    Copies of a name are numbered; a numbered name that another label has already gets a digest of its id as well.
    """
    clean = F.trim(F.regexp_replace("label", r'[\\/:*?"<>|#^\[\]\x00-\x1f]+', " "))
    base = F.when(clean == "", F.lit("unnamed")).otherwise(F.substring(clean, 1, 40))
    n = labels.select("id", base.alias("base"))
    k = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("id"))
    n = n.withColumn("k", k).withColumn("name", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string"))))
    again = (F.col("k") > 1) & (F.count(F.lit(1)).over(Window.partitionBy(F.lower("name"))) > 1)
    mark = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16)
    return n.select("id", F.when(again, F.concat_ws("_", "name", mark)).otherwise(F.col("name")).alias("name"))


def report(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> str:
    """A short report in Markdown: counts, hubs, communities, surprises. Every table is a bounded top list."""
    s = graph_stats(nodes, edges).first()
    out = ["# Graph report", "", f"{s['n_nodes']} nodes, {s['n_edges']} edges ({s['pct_extracted']}% extracted, {s['pct_inferred']}% inferred, {s['pct_ambiguous']}% ambiguous)", "", "## Hubs", ""]
    out += [f"- {r['label']} ({r['degree']})" for r in hub_nodes(nodes, edges).orderBy("rank").collect()]
    out += ["", "## Communities", ""]
    c = community.cohesion(edges, members).join(community.hub_labels(nodes, edges, members), "community")
    out += [f"- {r['label']}: {r['n_nodes']} nodes, cohesion {r['cohesion']:.2f}" for r in c.orderBy(F.desc("n_nodes"), "community").limit(20).collect()]
    out += ["", "## Surprises", ""]
    out += [f"- {r['src']} {r['relation']} {r['dst']}: {r['reasons']}" for r in analysis.surprises(nodes, edges, 5).collect()]
    return "\n".join(out) + "\n"


def log_query(spark, path: str, **fields) -> None:
    """Append one JSON line about a query to ``path``."""
    spark.createDataFrame([(json.dumps(fields, sort_keys=True),)], "value string").write.mode("append").text(path)


def graph_text(nodes: DataFrame, edges: DataFrame, found: DataFrame, budget: int = 2000) -> str:
    """Lines of a bounded subgraph, seeds first, then by degree, within the character budget."""
    from loomgraph.operators.search import within_budget

    n = nodes.join(found, "id").join(degree(nodes, edges), "id")
    lines = n.select("id", "depth", "degree", F.concat_ws(" ", "label", F.concat(F.lit("["), "source_file", F.lit("]"))).alias("line"))
    kept = within_budget(lines, ["depth", F.desc("degree"), "id"], F.length("line"), budget)
    rows = kept.orderBy("depth", F.desc("degree"), "id").collect()
    # edges between the nodes that are shown, in a fixed order
    e = enriched_edges(n.join(kept.select("id"), "id", "left_semi").select("id", "label"), edges, "label")
    e = e.where("src_label is not null and dst_label is not null").orderBy("src_label", "relation", "dst_label")
    return "\n".join([r["line"] for r in rows] + [f"{r['src_label']} -{r['relation']}-> {r['dst_label']}" for r in e.collect()])
