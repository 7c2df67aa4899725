"""Keyword search over node labels: IDF, tiered scores, seeds, graph queries under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.graph import degree
from loomgraph.operators.iterate import bfs

#: Points for a match of the whole label, of its start, and anywhere; the share for a path match.
EXACT, PREFIX, SUBSTRING, IN_PATH = 1000.0, 100.0, 1.0, 0.5
#: Aliases of edge contexts, and words of a question that hint at one.
CONTEXT_ALIASES = {"calls": "call", "imports": "import", "fields": "field", "params": "parameter_type", "returns": "return_type"}
CONTEXT_HINTS = {"call": ("call", "calls", "called", "invoke", "invokes"), "import": ("import", "imports", "imported"), "field": ("field", "fields")}


def idf(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """``term, df, idf``: ln(1 + N / (1 + nodes whose label contains the term))."""
    label = F.lower("label")
    counts = nodes.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(label.contains(t)).alias(f"t{i}") for i, t in enumerate(terms)))
    stack = ", ".join(f"'{t}', t{i}" for i, t in enumerate(terms))
    rows = counts.selectExpr("n", f"stack({len(terms)}, {stack}) as (term, df)")
    return rows.select("term", "df", F.round(F.log(1 + F.col("n") / (1 + F.col("df"))), 9).alias("idf"))


def node_scores(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """``id, score`` of nodes that match a term; the order is score, shorter label, id.

    The whole query as the label counts ten times an exact match, as its start ten times a prefix, by the
    rarest term's weight. Of each term the best of exact, prefix and substring counts, the first two scaled
    by the squared share of terms matched; half a weight comes for a term in the file's path.
    Terms are few, so that one pass of the nodes with a few columns for each term is the whole plan.
    """
    w = {r["term"]: r["idf"] for r in idf(nodes, terms).collect()}
    label, path = F.lower("label"), F.lower(F.coalesce("source_file", F.lit("")))
    whole = " ".join(terms)
    top = max(w.values(), default=0.0)
    matched = sum((label.contains(t).cast("int") for t in terms), F.lit(0))
    share = F.pow(matched / F.lit(float(max(1, len(terms)))), F.lit(2.0))
    score = F.when(label == whole, 10 * EXACT * top).when(label.startswith(whole), 10 * PREFIX * top).otherwise(0.0)
    for t in terms:
        best = F.when(label == t, EXACT * w[t] * share).when(label.startswith(t), PREFIX * w[t] * share).when(label.contains(t), SUBSTRING * w[t]).otherwise(0.0)
        score = score + best + F.when(path.contains(t), IN_PATH * w[t]).otherwise(0.0)
    out = nodes.select("id", "label", F.round(score, 4).alias("score"))
    return out.where("score > 0")


def ranked_scores(nodes: DataFrame, terms: list[str], top_n: int) -> DataFrame:
    return node_scores(nodes, terms).orderBy(F.desc("score"), F.length("label"), "id").limit(top_n)


def trigram_postings(nodes: DataFrame) -> DataFrame:
    """``trigram, id``: the inverted index of lower-case labels."""
    return nodes.select("id", F.explode(T.trigrams(F.lower("label"))).alias("trigram"))


def trigram_candidates(nodes: DataFrame, term: str) -> DataFrame:
    """``id`` of nodes whose label has every trigram of ``term``: a superset of those that contain it."""
    grams = [term[i : i + 3] for i in range(max(1, len(term) - 2))]
    if len(term) < 3:
        return nodes.where(F.lower("label").contains(term)).select("id")
    hit = trigram_postings(nodes).where(F.col("trigram").isin(*grams))
    return hit.groupBy("id").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(set(grams))).select("id")


def find_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """``id, tier``: 0 source path, 1 exact label, 2 prefix, 3 substring."""
    q = query.lower()
    label, path = F.lower("label"), F.lower("source_file")
    tier = F.when(path == q, 0).when(label == q, 1).when(label.startswith(q), 2).when(label.contains(q), 3)
    return nodes.select("id", tier.alias("tier")).where("tier is not null")


def resolve_seed(nodes: DataFrame, query: str) -> DataFrame:
    """One row ``id, tier`` of the first rule with exactly one hit: id, label, bare name, file, substring; else none."""
    q = query.lower()
    bare = F.regexp_replace(F.lower("label"), r"^\.|\(\)$", "")
    rules = [F.col("id") == query, F.lower("label") == q, bare == q, F.lower("source_file") == q, F.lower("label").contains(q)]
    hits = nodes.select("id", F.explode(F.array_compact(F.array(*(F.when(r, F.lit(i)) for i, r in enumerate(rules))))).alias("tier"))
    g = hits.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return g.orderBy("tier").limit(1).select("id", "tier")


def query_seeds(nodes: DataFrame, edges: DataFrame, terms: list[str], top: int = 3, gap: float = 0.2) -> DataFrame:
    """``id``: the best three while each keeps 20 % of its predecessor's lead, and the best node of each term."""
    s = ranked_scores(nodes, terms, top)
    w = Window.orderBy(F.desc("score"), F.length("label"), "id")
    lead = s.withColumn("best", F.max("score").over(Window.partitionBy())).withColumn("k", F.row_number().over(w))
    head = lead.where((F.col("k") == 1) | (F.col("score") >= (1 - gap) * F.col("best"))).select("id")
    d = degree(nodes, edges)
    label = F.lower("label")
    per = nodes.select("id", "label", F.explode(F.array_compact(F.array(*(F.when(label.contains(t), F.lit(t)) for t in terms)))).alias("term")).join(d, "id")
    lab = F.lower("label")
    tier = F.when(lab == F.col("term"), 0).when(lab.startswith(F.col("term")), 1).otherwise(2)
    best = per.groupBy("term").agg(F.min(F.struct(tier.alias("t"), (-F.col("degree")).alias("d"), "id")).alias("m")).select("m.id")
    return head.unionByName(best).distinct()


def context_filter(edges: DataFrame, contexts: list[str], question: str = "") -> DataFrame:
    """Edges of the wanted contexts; explicit ones beat hints in the question; without any all stay."""
    wanted = [CONTEXT_ALIASES.get(c, c) for c in contexts]
    if not wanted:
        words = set(question.lower().split())
        wanted = [c for c, hints in CONTEXT_HINTS.items() if words & set(hints)]
    return edges.where(F.col("context").isin(*wanted)) if wanted else edges


def query_graph(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 2, contexts: list[str] | None = None) -> DataFrame:
    """``id, depth`` of the subgraph that answers a question."""
    terms = T.query_terms(question)
    seeds = query_seeds(nodes, edges, terms)
    e = context_filter(edges, contexts or [], question) if "context" in edges.columns else edges
    return bfs(nodes, e, seeds, depth)


def within_budget(lines: DataFrame, order: list[str | Column], length: Column, budget: int) -> DataFrame:
    """Rows whose running length (each plus one) stays within ``3 * budget`` characters.

    The rows are a bounded subgraph; a running sum needs their order.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("upto", F.sum(length + 1).over(w)).where(F.col("upto") <= 3 * budget)
