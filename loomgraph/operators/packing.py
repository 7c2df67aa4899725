"""Token packing, pull requests, graph sessions: small ordered folds and thin fronts over the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph, iterate, search


def pack_tokens(files: DataFrame, budget: int = 60_000) -> DataFrame:
    """``path, chunk``: files in the order of their paths go into chunks of at most ``budget`` tokens.

    The fold is sequential by definition: (path, n_tokens) rows come sorted to one task, which keeps only the
    running sum; a larger file gets a chunk of its own.
    """
    def fold(frames: Iterator[pd.DataFrame]):
        chunk, used = 0, 0
        for pdf in frames:
            out = []
            for n in pdf["n_tokens"]:
                if used and used + n > budget:
                    chunk, used = chunk + 1, 0
                used += int(n)
                out.append(chunk)
            yield pd.DataFrame({"path": pdf["path"], "chunk": out})

    return files.select("path", "n_tokens").repartition(1).sortWithinPartitions("path").mapInPandas(fold, "path string, chunk int")


def cost(files: DataFrame, prices: dict[str, float]) -> DataFrame:
    """``backend, tokens, cost`` for a million tokens' price by backend."""
    p = files.sparkSession.createDataFrame(list(prices.items()), "backend string, price double")
    t = files.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return p.join(F.broadcast(t)).select("backend", "tokens", F.round(F.col("tokens") * F.col("price") / 1e6, 6).alias("cost"))


def pr_impact(prs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``number, n_communities, n_nodes, communities`` of pull requests (number, path).

    A path meets a graph file that is equal or ends with it after a slash (either way); names block the join,
    each graph file counts once.
    """
    files = nodes.drop("community").join(members, "id").groupBy("source_file").agg(F.collect_set("community").alias("cs"), F.count(F.lit(1)).alias("n"))
    base = lambda c: F.substring_index(c, "/", -1)
    a = prs.select("number", "path", base("path").alias("b")).distinct()
    f = files.select("source_file", "cs", "n", base("source_file").alias("b"))
    hit = (F.col("path") == F.col("source_file")) | F.col("path").endswith(F.concat(F.lit("/"), "source_file")) | F.col("source_file").endswith(F.concat(F.lit("/"), "path"))
    j = a.join(f, "b").where(hit).select("number", "source_file", "cs", "n").dropDuplicates(["number", "source_file"])
    total = j.groupBy("number").agg(F.sum("n").alias("n_nodes"))
    cs = j.select("number", F.explode("cs").alias("c")).distinct().groupBy("number").agg(F.count(F.lit(1)).alias("n_communities"), F.array_join(F.array_sort(F.collect_list("c")), ",").alias("communities"))
    return total.join(cs, "number")


def pr_conflicts(impact: DataFrame) -> DataFrame:
    """``community, n_prs`` touched by more than one pull request."""
    c = impact.select("number", F.explode(F.split("communities", ",")).alias("community"))
    return c.groupBy("community").agg(F.count_distinct("number").alias("n_prs")).where("n_prs > 1")


def pr_ladder(prs: DataFrame) -> DataFrame:
    """``number, status, rank``: draft, failing, changes requested, pending, approved, open."""
    s = (
        F.when(F.col("is_draft"), "draft").when(F.col("ci_status") == "FAILURE", "failing")
        .when(F.col("review_decision") == "CHANGES_REQUESTED", "changes").when(F.col("ci_status") == "PENDING", "pending")
        .when(F.col("review_decision") == "APPROVED", "approved").otherwise("open")
    )
    order = F.array_position(F.array(*map(F.lit, ("approved", "open", "changes", "failing", "pending", "draft"))), s)
    return prs.select("number", s.alias("status"), order.alias("rank"))


def collapse_chunks(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First node of each id by ``ord``, first edge of each (src, dst, relation)."""
    return graph.resolve_duplicates(nodes, ["id"], "ord", "first"), graph.resolve_duplicates(edges, ["src", "dst", "relation"], "ord", "first")


class Session:
    """The small language of graph operations: one line, one answer; ``n1``, ``n2``, ... name nodes that were shown."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, cap: int = 12) -> None:
        self.nodes, self.edges, self.cap = nodes, edges, cap
        self.refs: dict[str, str] = {}
        self.notes: list[str] = []

    def ref(self, node: str) -> str:
        for r, n in self.refs.items():
            if n == node:
                return r
        r = f"n{len(self.refs) + 1}"
        self.refs[r] = node
        return r

    def _id(self, word: str) -> str | None:
        if word in self.refs:
            return self.refs[word]
        row = search.resolve_seed(self.nodes, word).first()
        return row["id"] if row else None

    def _show(self, rows) -> list[str]:
        return [f"{self.ref(r['id'])} {r['id']}" for r in rows]

    def run(self, line: str) -> list[str]:
        op, _, arg = line.strip().partition(" ")
        arg = arg.strip()
        if op == "note":
            self.notes.append(arg)
            return [f"noted ({len(self.notes)})"]
        if op == "notes":
            return list(self.notes)
        if op == "answer":
            return [arg]
        if op == "find":
            from loomgraph.functions.text import query_terms

            return self._show(search.ranked_scores(self.nodes, query_terms(arg), self.cap).collect())
        if op in ("path", "common"):
            ends = [self._id(x.strip()) for x in arg.split("->")]
            if len(ends) != 2 or None in ends:
                return ["not found"]
            if op == "path":
                return [" -> ".join(self.ref(x) for x in iterate.shortest_path(self.edges, *ends))] if ends[0] != ends[1] else [self.ref(ends[0])]
            return self._show(graph.common_neighbours(self.nodes, self.edges, *ends).orderBy(F.desc("degree"), "id").limit(self.cap).collect())
        node = self._id(arg)
        if node is None:
            return ["not found"]
        calls, member = ("calls", "indirect_call"), ("contains", "method")
        if op == "expand":
            return self._show(graph.ranked_neighbours(self.nodes, self.edges, node, self.cap).collect())
        if op in ("callers", "callees", "members"):
            way, rel = {"callers": ("in", calls), "callees": ("out", calls), "members": ("out", member)}[op]
            return self._show(graph.expand(self.edges, node, way, rel).orderBy("id").limit(self.cap).collect())
        if op == "source":
            return [r["source_file"] or "" for r in self.nodes.where(F.col("id") == node).collect()]
        if op == "community":
            own = self.nodes.where(F.col("id") == node).select("community")
            return self._show(self.nodes.join(own, "community", "left_semi").orderBy("id").limit(self.cap).collect())
        return [f"unknown operation {op}"]
