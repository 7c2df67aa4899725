"""Snapshots kept up to date: manifests, caches, replacement by owner, guards, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import without_dangling


def manifest_diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, state``: new, changed, unchanged or deleted, by ``hash``; a missing old hash counts as changed."""
    c, m = current.select("path", "hash"), manifest.select("path", F.col("hash").alias("old"), F.lit(True).alias("known"))
    j = c.withColumn("here", F.lit(True)).join(m, "path", "full")
    state = (
        F.when(F.col("here").isNull(), "deleted").when(F.col("known").isNull(), "new")
        .when(F.col("hash").eqNullSafe(F.col("old")) & F.col("old").isNotNull(), "unchanged").otherwise("changed")
    )
    return j.select("path", state.alias("state"))


def manifest_upsert(manifest: DataFrame, current: DataFrame, kind: str) -> DataFrame:
    """``path, ast_hash, semantic_hash`` after a run of ``kind`` (ast, semantic, both) over ``current`` (path, hash).

    A semantic hash survives an ast run only while the content is the same.
    """
    j = manifest.join(current.select("path", "hash"), "path", "full")
    new = F.col("hash")
    a = F.coalesce(new, "ast_hash") if kind in ("ast", "both") else F.col("ast_hash")
    kept = F.when(new.isNull() | (new == F.col("semantic_hash")), F.col("semantic_hash"))
    s = F.coalesce(new, "semantic_hash") if kind in ("semantic", "both") else kept
    return j.select("path", a.alias("ast_hash"), s.alias("semantic_hash"))


def cache_split(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, hit`` by content hash."""
    known = cache.select("hash").distinct().withColumn("hit", F.lit(True))
    return files.select("path", "hash").join(known, "hash", "left").select("path", F.coalesce("hit", F.lit(False)).alias("hit"))


def cache_prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select("hash"), "hash", "left_semi")


def replace_sources(rows: DataFrame, fresh: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Rows whose ``source_file`` isn't in ``fresh`` or ``deleted``, and all fresh ones; a file extracted again is never deleted."""
    gone = fresh.select("source_file").distinct()
    kept = rows.join(gone, "source_file", "left_anti")
    if deleted is not None:
        d = deleted.select("source_file").join(gone, "source_file", "left_anti")
        kept = kept.join(d, "source_file", "left_anti")
    return kept.unionByName(fresh)


def merge_graph(nodes, edges, fresh_nodes, fresh_edges, deleted=None) -> tuple[DataFrame, DataFrame]:
    """Replacement by owner for both frames; edges that lose an end go."""
    n = replace_sources(nodes, fresh_nodes, deleted)
    return n, without_dangling(n, replace_sources(edges, fresh_edges, deleted))


def surviving_hyperedges(hyperedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those with all members alive."""
    m = hyperedges.select(F.col("id").alias("h"), F.explode("nodes").alias("id"))
    dead = m.join(nodes.select("id"), "id", "left_anti").select(F.col("h").alias("id")).distinct()
    return hyperedges.join(dead, "id", "left_anti")


def attach_hyperedges(old: DataFrame, new: DataFrame) -> DataFrame:
    """First of each id; those without an id go."""
    u = old.withColumn("_k", F.lit(0)).unionByName(new.withColumn("_k", F.lit(1))).where("id is not null and id <> ''")
    rest = [c for c in old.columns if c != "id"]
    g = u.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("_k", *[F.col(c) for c in rest])).alias("r"))
    return g.select("id", *(F.col(f"r.{c}").alias(c) for c in rest))


def same_topology(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], ignore=("community", "norm_label", "confidence_score")) -> bool:
    """Whether two snapshots hold the same rows in any order, whatever the ignored columns say.

    Each frame is summed up as a count and two checksums of its rows; nothing else leaves the cluster.
    """
    def mark(df: DataFrame) -> tuple:
        cols = sorted(c for c in df.columns if c not in ignore)
        h, g = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
        r = df.select(h.alias("h"), g.alias("g")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("g") % 1_000_000_007)).first()
        return tuple(r), cols

    return all(mark(x) == mark(y) for x, y in zip(a, b))


def unaccounted_losses(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Nodes that vanished from files that weren't rebuilt: a write should be refused if there are any."""
    lost = old.join(new.select("id"), "id", "left_anti")
    return lost.join(rebuilt.select("source_file").distinct(), "source_file", "left_anti").select("id")


def prefixed(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Ids in a registry: ``repo::id``."""
    p = lambda c: F.concat(F.lit(f"{repo}::"), c)
    n = nodes.withColumn("local_id", F.col("id")).withColumn("id", p("id")).withColumn("repo", F.lit(repo))
    return n, edges.withColumns({"src": p("src"), "dst": p("dst")}).withColumn("repo", F.lit(repo))


def global_add(reg_nodes, reg_edges, nodes, edges, repo: str) -> tuple[DataFrame, DataFrame]:
    """A registry with the graph of ``repo`` replaced; nodes without a file merge with those of the same label."""
    n, e = prefixed(nodes, edges, repo)
    rn, re_ = reg_nodes.where(F.col("repo") != repo), reg_edges.where(F.col("repo") != repo)
    free = (F.col("source_file").isNull()) | (F.col("source_file") == "")
    have = rn.where(free).groupBy("label").agg(F.min("id").alias("to"))
    ext = n.where(free).join(have, "label").select(F.col("id").alias("from"), "to")
    n = n.join(ext.select(F.col("from").alias("id")), "id", "left_anti")
    for end in ("src", "dst"):
        x = ext.select(F.col("from").alias("_f"), F.col("to").alias("_t"))
        e = e.join(x, e[end] == x["_f"], "left").withColumn(end, F.coalesce("_t", end)).drop("_f", "_t")
    return rn.unionByName(n.select(rn.columns)), re_.unionByName(e.where("src <> dst").select(re_.columns))


def overlay_state(overlay: DataFrame, files: DataFrame) -> DataFrame:
    """``id, state`` of notes on nodes: fresh, stale (the file's fingerprint differs) or gone."""
    f = files.select(F.col("path").alias("source_file"), F.col("hash").alias("now"))
    j = overlay.join(f, "source_file", "left")
    return j.select("id", F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("fingerprint"), "stale").otherwise("fresh").alias("state"))
