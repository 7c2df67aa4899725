"""From fragments to a graph: canonical fields, cleaning, ids, ghosts, pruning, collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import entities, graph, resolution

#: Kinds of nodes, and other spellings of them.
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
FILE_TYPE_ALIASES = {"markdown": "document", "doc": "document", "text": "document", "tool": "code", "library": "code", "pdf": "paper", "figure": "image"}


def canonical(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known file types, forward slashes, trimmed labels, default confidences, no rows without an id."""
    t = F.lower(F.coalesce("file_type", F.lit("")))
    kind = F.when(t.isin(*FILE_TYPES), t).otherwise(F.coalesce(X.by_map(t, FILE_TYPE_ALIASES), F.lit("concept")))
    n = nodes.where("id is not null and id <> ''").withColumn("file_type", kind)
    n = n.withColumn("source_file", F.regexp_replace(F.coalesce("source_file", F.lit("")), r"\\", "/")).withColumn("label", F.trim(F.coalesce("label", "id")))
    e = edges.where("src is not null and dst is not null and src <> '' and dst <> ''")
    return n, e.withColumn("confidence", F.coalesce("confidence", F.lit("EXTRACTED")))


def sanitised(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None):
    """(nodes, edges, hyperedges) of a semantic fragment without rationale and concept nodes.

    A sentence-like label moves along ``rationale_for`` into its target's ``rationale``, joined by blank lines in the
    order of the sources' ids; hyperedges keep the members that live, two at least.
    """
    speaks = edges.where("relation = 'rationale_for'").select(F.col("src").alias("id")).distinct().withColumn("speaks", F.lit(True))
    n = nodes.where("id <> ''").join(speaks, "id", "left")
    sentence = X.is_sentence(F.col("label"))
    bad = F.col("file_type").isin("rationale", "concept") | (F.coalesce("speaks", F.lit(False)) & sentence)
    n = n.withColumn("gone", F.coalesce(bad, F.lit(False)))
    said = n.where("gone").where(sentence).select(F.col("id").alias("src"), F.trim("label").alias("t"))
    live = n.where("not gone").drop("gone", "speaks")
    texts = edges.where("relation = 'rationale_for'").join(said, "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set(F.struct("src", "t"))).alias("ts"))
    texts = texts.select("id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("rationale"))
    out = live.join(texts, "id", "left")
    dead = n.where("gone").select("id")
    e = edges.join(dead.select(F.col("id").alias("src")), "src", "left_anti").join(dead.select(F.col("id").alias("dst")), "dst", "left_anti")
    if hyperedges is None:
        return out, e, None
    m = hyperedges.select(F.col("id").alias("h"), F.posexplode("nodes").alias("pos", "id")).join(live.select("id"), "id", "left_semi")
    m = m.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("ms")).where(F.size("ms") >= 2)
    h = hyperedges.join(m.withColumnRenamed("h", "id"), "id").withColumn("nodes", F.transform("ms", lambda x: x["id"])).drop("ms")
    return out, e, h.select(hyperedges.columns)


def build(nodes: DataFrame, edges: DataFrame, directed: bool = False, dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    """A graph from raw rows: nodes (id, label, file_type, source_file, source_location, _origin, ord), edges (src, dst, relation, confidence, context).

    Short semantic ids take their file's, duplicates merge column by column (with ``dedup``: the first row stays), ghosts join
    their twins, ends resolve exactly or by normalised id, dangling and phantom edges go, pairs collapse.
    """
    n, e = canonical(nodes, edges)
    rekey = resolution.semantic_rekey(n)
    r = rekey.select(F.col("old").alias("id"), "new")
    n = n.join(r, "id", "left").withColumn("id", F.coalesce("new", "id")).drop("new")
    e = resolution.remapped_ends(e, rekey)
    n = graph.resolve_duplicates(n, ["id"], "ord", "first" if dedup else "merge")
    n, e = resolution.without_ghosts(n, e)
    index = n.select(X.ascii_id(F.col("id")).alias("k"), "id").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("to")).where("c = 1").drop("c")
    known = n.select(F.col("id").alias("i"))
    for end in ("src", "dst"):
        x = e.join(known, e[end] == known["i"], "left").join(index, X.ascii_id(F.col(end)) == F.col("k"), "left")
        e = x.withColumn(end, F.coalesce("i", "to", end)).drop("i", "to", "k")
    e = resolution.phantom_edges_dropped(n, graph.without_dangling(n, e))
    if dedup:
        n, e, _ = entities.deduplicated(n, e)
    return n, graph.collapsed_edges(e, directed)


def legacy_ids(nodes: DataFrame) -> DataFrame:
    """File-level nodes (``L1``) whose id is only the file name's: a sign of an older graph."""
    base = X.ascii_id(F.regexp_replace(X.basename(F.col("source_file")), r"\.[^.]+$", ""))
    return nodes.where("source_location = 'L1'").where((F.col("id") == base) & (resolution.stem_id(F.col("source_file")) != base)).select("id")


def compose(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two graphs in one; attributes of the second win where they aren't null."""
    def both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        u = a.withColumn("_k", F.lit(0)).unionByName(b.withColumn("_k", F.lit(1)), allowMissingColumns=True)
        return graph.resolve_duplicates(u, keys, "_k", "merge").drop("_k")

    return both(first[0], second[0], ["id"]), both(first[1], second[1], ["src", "dst", "relation"])
