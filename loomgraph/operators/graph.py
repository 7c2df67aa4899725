"""Relational graph operators over ``nodes`` (id, ...) and ``edges`` (src, dst, relation, ...).

Every ranking ends in the id, so that results are total orders. Degrees count a self-loop twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of language builtins that are no hubs, and of keys of package files.
BUILTIN_LABELS = ("str", "int", "float", "bool", "list", "dict", "set", "tuple", "object", "none", "any", "optional", "exception")
JSON_KEYS = ("name", "version", "description", "scripts", "dependencies", "devdependencies", "main", "type", "license", "author")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree``; nodes without edges have 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def is_concept(source_file: Column) -> Column:
    """No file, or a file name without an extension."""
    name = F.substring_index(source_file, "/", -1)
    return source_file.isNull() | (source_file == "") | ~name.contains(".")


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """The node of a file itself, a ``.method()`` stub, or a bare ``call()`` with one edge at most."""
    return (
        (label == F.substring_index(source_file, "/", -1))
        | (label.startswith(".") & label.endswith("()"))
        | (label.endswith("()") & (degree <= 1))
    )


def hub_nodes(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """``id, label, degree, rank`` of the best connected real entities."""
    d = nodes.join(degree(nodes, edges), "id")
    label, file = F.col("label"), F.coalesce("source_file", F.lit(""))
    noise = is_file_node(label, file, F.col("degree")) | is_concept(file) | F.lower(label).isin(*BUILTIN_LABELS)
    noise = noise | (file.endswith(".json") & F.lower(label).isin(*JSON_KEYS))
    top = d.where(~noise).select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node, edge and confidence counts; a missing confidence is EXTRACTED. Shares are whole percents."""
    conf = F.coalesce("confidence", F.lit("EXTRACTED"))
    kinds = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
    e = edges.agg(
        F.count(F.lit(1)).alias("n_edges"), *(F.count_if(conf == k).alias(f"n_{k.lower()}") for k in kinds)
    )
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    share = lambda k: F.bround(F.col(f"n_{k.lower()}") * 100 / F.greatest(F.lit(1), "n_edges")).cast("int").alias(f"pct_{k.lower()}")
    return n.join(e).select("*", *map(share, kinds))  # two single rows


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degree(nodes, edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def degree_at(degrees: DataFrame, share: float) -> DataFrame:
    """``threshold``: the degree at index ``int(n * share)`` of all degrees in ascending order.

    Found from the histogram, whose size is the number of different degrees.
    """
    h = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = F.least(F.floor(F.col("total") * share), F.col("total") - 1)
    return h.where(F.col("upto") > at).agg(F.min("degree").alias("threshold"))


def enriched_edges(nodes: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """Edges with ``src_<c>`` and ``dst_<c>`` of both endpoints; dangling edges go."""
    out = edges
    for end in ("src", "dst"):
        side = nodes.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        out = out.join(side, end)
    return out


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    out = edges.join(ids, edges["src"] == ids["id"], "left_semi")
    ids = nodes.select(F.col("id").alias("id2"))
    return out.join(ids, out["dst"] == ids["id2"], "left_semi")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (id)."""
    return without_dangling(ids, edges)


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge as ``a -> b`` and ``b -> a`` with its relation."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    fwd = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *rest)
    return fwd.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *rest))


def expand(edges: DataFrame, node: str, direction: str = "all", relations: tuple[str, ...] = ()) -> DataFrame:
    """``id, relation, direction`` of the neighbours of one node."""
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    out = e.where(F.col("src") == node).select(F.col("dst").alias("id"), "relation", F.lit("out").alias("direction"))
    inn = e.where(F.col("dst") == node).select(F.col("src").alias("id"), "relation", F.lit("in").alias("direction"))
    return {"out": out, "in": inn, "all": out.unionByName(inn)}[direction].distinct()


def ranked_neighbours(nodes: DataFrame, edges: DataFrame, node: str, top_n: int = 12) -> DataFrame:
    near = expand(edges, node)
    return near.join(degree(nodes, edges), "id").orderBy(F.desc("degree"), "id", "relation", "direction").limit(top_n)


def common_neighbours(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id, degree`` of nodes next to both, whatever the directions."""
    e = both_directions(edges)
    near = lambda x: e.where(F.col("a") == x).select(F.col("b").alias("id"))
    both = near(a).intersect(near(b)).where(~F.col("id").isin(a, b))
    return both.join(degree(nodes, edges), "id")


def resolve_duplicates(rows: DataFrame, keys: list[str], order: str, policy: str) -> DataFrame:
    """One row of each key: ``first`` or ``last`` whole row, or the last non-null value of each column (``merge``).

    Three policies because callers differ; ``order`` must be unique within a key.
    """
    rest = [c for c in rows.columns if c not in keys]
    if policy in ("first", "last"):
        pick = F.min_by if policy == "first" else F.max_by
        best = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("r"))
        return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
    if policy == "merge":
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
        return rows.groupBy(*keys).agg(*last)
    raise ValueError(policy)


def collapsed_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """One edge of each pair of nodes: ``src, dst, relation, confidence, context``.

    Edges are folded in the order (src, dst, relation). A later edge overwrites the stored keys that it
    has (nulls don't), except that an undirected pair's edge with the stored relation in the other
    direction is dropped. Pairs are small groups; the fold runs over each one's sorted array.
    """
    item = F.struct("src", "dst", "relation", F.col("confidence"), F.col("context"))
    keys = ["src", "dst"] if directed else ["u", "v"]
    e = edges if directed else edges.withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")})
    g = e.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("es"))

    def step(acc: Column, x: Column) -> Column:
        reverse = (acc["relation"] == x["relation"]) & (acc["src"] == x["dst"]) & (acc["src"] != x["src"])
        new = F.struct(
            x["src"].alias("src"),
            x["dst"].alias("dst"),
            x["relation"].alias("relation"),
            F.coalesce(x["confidence"], acc["confidence"]).alias("confidence"),
            F.coalesce(x["context"], acc["context"]).alias("context"),
        )
        return F.when(reverse, acc).otherwise(new)

    folded = F.aggregate(F.slice("es", 2, F.greatest(F.lit(1), F.size("es"))), F.get("es", F.lit(0)), step)
    return g.select(folded.alias("e")).select("e.*")


def multigraph_diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters over raw edges: what collapsing to a simple graph would hide."""
    known = nodes.select(F.col("id").alias("k"))
    e = edges.withColumn("missing", F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") == "") | (F.col("dst") == ""))
    e = e.join(known.withColumnRenamed("k", "ks"), F.col("src") == F.col("ks"), "left")
    e = e.join(known.withColumnRenamed("k", "kd"), F.col("dst") == F.col("kd"), "left")
    e = e.withColumn("dangling", ~F.col("missing") & (F.col("ks").isNull() | F.col("kd").isNull()))
    one = e.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if("missing").alias("n_missing"),
        F.count_if("dangling").alias("n_dangling"),
        F.count_if(~F.col("missing") & ~F.col("dangling") & (F.col("src") == F.col("dst"))).alias("n_self_loops"),
    )
    valid = e.where("not missing and not dangling")
    directed = valid.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("relations"),
    )
    by_pair = directed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_valid"),
        F.count(F.lit(1)).alias("n_directed_pairs"),
        F.count_if(F.col("relations") > 1).alias("n_relation_variants"),
    )
    undirected = directed.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    un = undirected.agg(F.count(F.lit(1)).alias("n_undirected_pairs"))
    exact = valid.groupBy("src", "dst", "relation", "confidence").agg((F.count(F.lit(1)) - 1).alias("x"))
    ex = exact.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n_exact_duplicates"))
    out = one.join(by_pair).join(un).join(ex)  # single rows
    return out.withColumn("n_collapsed", F.col("n_valid") - F.col("n_directed_pairs"))


def endpoint_aliases(refs: DataFrame, targets: DataFrame, key: Column, target_key: Column) -> DataFrame:
    """``refs`` with ``resolved``: the id of the only target with the same key, else null.

    Ambiguity resolves to nothing.
    """
    index = targets.select(target_key.alias("_k"), "id").groupBy("_k").agg(F.min("id").alias("resolved"), F.count_distinct("id").alias("_n"))
    index = index.where("_n = 1").drop("_n")
    return refs.withColumn("_key", key).join(index, F.col("_key") == F.col("_k"), "left").drop("_k", "_key")


def validation_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``row_kind, row_id, error``: never raises. Required fields, allowed values, dangling endpoints."""
    def missing(c):
        return F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"missing {c}"))

    n = nodes.select(
        F.lit("node").alias("row_kind"), F.col("id").alias("row_id"),
        F.array(missing("id"), missing("label"), missing("file_type"), missing("source_file"),
                F.when(~F.col("file_type").isin("code", "document", "paper", "image", "rationale", "concept"), F.lit("bad file_type"))).alias("es"),
    )
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    e = edges.join(ids.withColumnRenamed("_id", "_s"), F.col("src") == F.col("_s"), "left").join(ids.withColumnRenamed("_id", "_d"), F.col("dst") == F.col("_d"), "left")
    e = e.select(
        F.lit("edge").alias("row_kind"), F.concat_ws("->", "src", "dst").alias("row_id"),
        F.array(missing("src"), missing("dst"), missing("relation"), missing("confidence"),
                F.when(~F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), F.lit("bad confidence")),
                F.when(F.col("_s").isNull(), F.lit("unknown source")), F.when(F.col("_d").isNull(), F.lit("unknown target"))).alias("es"),
    )
    return n.unionByName(e).select("row_kind", "row_id", F.explode(F.array_compact("es")).alias("error"))
