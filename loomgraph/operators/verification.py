"""Claims against the graph, verified insights, symbol spaces and draft checks."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.graph import both_directions, degree
from loomgraph.operators.iterate import shortest_paths
from loomgraph.runtime import checkpoint

#: Verbs of claims by relation, names of relations by the one they mean, and the worth of verdicts.
ALIASES = {
    "call": "calls", "calls": "calls", "invoke": "calls", "invokes": "calls", "import": "imports", "imports": "imports",
    "use": "uses", "uses": "uses", "extends": "inherits", "inherits": "inherits", "subclasses": "inherits",
    "implements": "implements", "contain": "contains", "contains": "contains", "define": "contains", "defines": "contains",
    "reference": "references", "references": "references", "depends": "uses", "connected": "connected",
}
RELATIONS = {
    "call": "calls", "invokes": "calls", "invoke": "calls", "import": "imports", "imports_from": "imports", "use": "uses",
    "inherit": "inherits", "inherits_from": "inherits", "extends": "inherits", "subclasses": "inherits",
    "reference": "references", "refers_to": "references", "depends_on": "uses", "contain": "contains", "defines": "contains",
}
RANK = {"VERIFIED": 3, "VERIFIED_INDIRECT": 2, "UNKNOWN": 1, "REFUTED": 0}
SUPPORTED = ("VERIFIED", "VERIFIED_INDIRECT")
_CLAIM = re.compile(r"`([^`]+)`\s+(?:also\s+)?(" + "|".join(ALIASES) + r")\s+(?:on\s+|to\s+)?`([^`]+)`", re.I)
_DEFINED = re.compile(r"`([^`]+)`\s+is\s+defined\s+in\s+`([^`]+)`", re.I)
_NAMED = re.compile(r"`([^`\n]{1,120})`")
CLAIMS = "claim_no int, subject string, relation string, object string"


def claims_in(text: str | None) -> list[tuple[str, str, str]]:
    """Distinct (subject, relation, object) claims of sentences that name both ends in backticks.

    What a sentence without such a claim names in backticks is claimed to exist.
    """
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text or ""):
        said = [(a, ALIASES[v.lower()], b) for a, v, b in _CLAIM.findall(sentence)]
        said += [(a, "defined_in", b) for a, b in _DEFINED.findall(sentence)]
        out += said or [(a, "exists", "") for a in _NAMED.findall(sentence)]
    return list(dict.fromkeys(out))


def relation_name(relation: Column) -> Column:
    """The relation that a name means."""
    plain = F.replace(F.lower(F.trim(relation)), F.lit(" "), F.lit("_"))
    return F.coalesce(T.by_map(plain, RELATIONS), plain)


def extract_claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, claim_no, subject, relation, object`` of each text."""
    def work(frames):
        for pdf in frames:
            rows = [(k, i, *c) for k, t in zip(pdf[key], pdf[text]) for i, c in enumerate(claims_in(t))]
            yield pd.DataFrame(rows, columns=[key, "claim_no", "subject", "relation", "object"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(work, f"{key} {kind}, {CLAIMS}")


def resolve_labels(nodes: DataFrame, labels: DataFrame, top_n: int = 8) -> DataFrame:
    """``label, id, rank, confident`` of the nodes a claim's label may mean (label: column of ``labels``).

    A node is a candidate if its label has every token of the claim's. Equal labels come first, then the shorter;
    the first is confident if no other label is as short, at most ``top_n`` stay: a feature of the resolver.
    Tokens are joined on the claim's rarest one, so that no claim meets all nodes.
    """
    want = labels.select("label").distinct().withColumn("toks", F.array_distinct(T.tokens(F.col("label")))).where(F.size("toks") > 0)
    have = nodes.select("id", F.lower("label").alias("name"), F.explode(F.array_distinct(T.tokens(F.col("label")))).alias("tok"))
    df = have.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    w = want.select("label", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    rare = w.join(df, "tok").groupBy("label").agg(F.min(F.struct("df", "tok")).alias("m"), F.count(F.lit(1)).alias("known"), F.first("n").alias("n"))
    rare = rare.where("known = n").select("label", F.col("m.tok").alias("tok"))
    cand = rare.join(have, "tok").select("label", "id", "name").join(want, "label")
    full = cand.where(F.size(F.array_except("toks", T.tokens(F.col("name")))) == 0)
    exact = (F.col("name") == F.lower("label")) | (F.regexp_replace("name", r"\(\)$", "") == F.lower("label"))
    full = full.select("label", "id", (~exact).cast("int").alias("t"), F.length("name").alias("k"))
    from pyspark.sql import Window

    by = Window.partitionBy("label").orderBy("t", "k", "id")
    tie = Window.partitionBy("label", "t", "k")
    out = full.withColumn("rank", F.row_number().over(by)).withColumn("confident", F.count(F.lit(1)).over(tie) == 1)
    return out.where(F.col("rank") <= top_n).select("label", "id", "rank", "confident")


def pair_verdicts(pairs: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """Pairs (src, dst, relation, confident) with ``verdict``.

    Relations are compared by what their names mean. An edge of the relation verifies, another one between them does indirectly; an edge of the relation in
    the other direction refutes a confident pair; a path within ``max_hops`` counts indirectly; else refuted if
    confident and unknown if not.
    """
    edges = edges.select("src", "dst", relation_name(F.col("relation")).alias("relation"))
    # only the edges of pairs are grouped, those of both directions in one pass
    ways = F.array(F.struct("src", "dst", "relation", F.lit(True).alias("along")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", F.lit(False).alias("along")))
    ends = pairs.select("src", "dst").distinct()
    direct = edges.select(F.explode(ways).alias("w")).select("w.*").join(ends, ["src", "dst"], "left_semi")
    names = lambda along: F.collect_set(F.when(F.col("along") == along, F.col("relation")))
    direct = direct.groupBy(F.col("src").alias("s"), F.col("dst").alias("d")).agg(names(True).alias("fwd"), names(False).alias("rev"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    direct = checkpoint(direct.select("s", "d", some("fwd"), some("rev")))
    p = pairs.join(direct, (pairs["src"] == direct["s"]) & (pairs["dst"] == direct["d"]), "left").drop("s", "d")
    loose = p.where("fwd is null and rev is null").select("src", "dst").distinct()
    near = shortest_paths(edges, loose, max_hops).select(F.col("src").alias("s"), F.col("dst").alias("d"), "hops")
    p = p.join(near, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left").drop("s", "d")
    r = relation_name(F.col("relation"))
    verdict = (
        F.when(F.array_contains("fwd", r) | ((r == "connected") & (F.col("fwd").isNotNull() | F.col("rev").isNotNull())), "VERIFIED")
        .when(F.col("fwd").isNotNull(), "VERIFIED_INDIRECT")
        .when(F.array_contains("rev", r) & F.col("confident"), "REFUTED")
        .when(F.col("rev").isNotNull() | F.col("hops").isNotNull(), "VERIFIED_INDIRECT")
        .when(F.col("confident"), "REFUTED")
        .otherwise("UNKNOWN")
    )
    return p.withColumn("verdict", verdict).drop("fwd", "rev", "hops")


def file_verdicts(claims: DataFrame, subjects: DataFrame, nodes: DataFrame) -> DataFrame:
    """``claim_id, verdict`` of claims that a subject is defined in a file: one path ends with the other or has it in it.

    A subject without files, or one that isn't sure, is unknown where no file fits; else such a claim is refuted.
    """
    path = lambda c: F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/")))
    at = claims.withColumn("want", F.trim(path("object"))).join(subjects, "subject")
    at = at.join(nodes.select(F.col("id").alias("src"), path("source_file").alias("file")), "src")
    has = F.coalesce(F.col("file") != "", F.lit(False))
    fits = has & (F.contains("file", "want") | F.endswith("want", "file")) & (F.col("want") != "")
    g = at.groupBy("claim_id").agg(
        F.max(fits).alias("fits"), F.max(has & (F.col("want") != "")).alias("has"), F.min_by("c1", "rank").alias("sure")
    )
    return g.select("claim_id", F.when(F.col("fits"), "VERIFIED").when(F.col("has") & F.col("sure"), "REFUTED").otherwise("UNKNOWN").alias("verdict"))


def claim_verdicts(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``claim_id, verdict``: the best verdict over all pairs of resolved ends; unresolvable claims are unknown.

    A claim ``exists`` needs its subject only, ``defined_in`` compares its object with the files of the subject.
    """
    labels = claims.select(F.col("subject").alias("label")).unionByName(claims.select(F.col("object").alias("label")))
    ids = checkpoint(resolve_labels(nodes, labels))
    s = ids.select(F.col("label").alias("subject"), F.col("id").alias("src"), F.col("confident").alias("c1"), "rank")
    o = ids.select(F.col("label").alias("object"), F.col("id").alias("dst"), F.col("confident").alias("c2"))
    kind = relation_name(F.col("relation"))
    there = claims.where(kind == "exists").join(s.select("subject").distinct(), "subject").select("claim_id", F.lit("VERIFIED").alias("verdict"))
    files = file_verdicts(claims.where(kind == "defined_in"), s, nodes)
    between = claims.where(~kind.isin("exists", "defined_in"))
    pairs = between.join(s, "subject").join(o, "object").where("src <> dst")
    pairs = checkpoint(pairs.select("claim_id", "src", "dst", "relation", (F.col("c1") & F.col("c2")).alias("confident")))
    v = pair_verdicts(pairs, edges).select("claim_id", "verdict").unionByName(there).unionByName(files)
    rank = T.by_map(F.col("verdict"), RANK)
    best = v.groupBy("claim_id").agg(F.max_by("verdict", rank).alias("verdict"))
    return claims.select("claim_id").distinct().join(best, "claim_id", "left").select("claim_id", F.coalesce("verdict", F.lit("UNKNOWN")).alias("verdict"))


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def admit(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``insight_id, status, memory_id``: admitted insights have a claim, and support for every one."""
    from pyspark.sql import Window

    j = claims.select("insight_id", "claim_id").join(verdicts, "claim_id", "left")
    ok = F.coalesce(F.every(F.coalesce(F.col("verdict").isin(*SUPPORTED), F.lit(False))), F.lit(False))
    g = j.groupBy("insight_id").agg(F.when(ok, "ADMITTED").otherwise("REJECTED").alias("status"))
    # ids count admitted insights in order: one row each
    n = F.row_number().over(Window.partitionBy("status").orderBy("insight_id"))
    return g.withColumn("memory_id", F.when(F.col("status") == "ADMITTED", F.concat(F.lit("m"), n.cast("string"))))


def reverify(memory: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``insight_id, status, change``: quarantined where a claim has lost its support, resurrected where all have it."""
    good = admit(claims, verdicts).select("insight_id", (F.col("status") == "ADMITTED").alias("good"))
    j = memory.select("insight_id", F.col("status").alias("was")).join(good, "insight_id", "left")
    good = F.coalesce("good", F.lit(False))
    status = F.when(good, "active").otherwise("quarantined")
    change = F.when(good & (F.col("was") == "quarantined"), "resurrected").when(good, "confirmed").when(F.col("was") == "active", "quarantined").otherwise("still_bad")
    return j.select("insight_id", status.alias("status"), change.alias("change"))


def recall(memory: DataFrame, question: str, top_n: int = 8) -> DataFrame:
    """``insight_id, score``: two points for a token among an insight's anchors, else one in its text."""
    toks = list(dict.fromkeys(T.query_terms(question)))
    anchors, words = F.transform("anchors", F.lower), T.tokens(F.col("insight"))
    score = sum((F.when(F.array_contains(anchors, t), 2).when(F.array_contains(words, t), 1).otherwise(0) for t in toks), F.lit(0))
    return memory.select("insight_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "insight_id").limit(top_n)


def symbol_space(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``name, kind, degree`` of callables, classes and modules; a name's largest degree counts."""
    d = nodes.where("file_type = 'code'").join(degree(nodes, edges), "id")
    label = F.col("label")
    call = d.where(label.endswith("()")).select(F.regexp_replace(label, r"^\.|\(\)$", "").alias("name"), F.lit("callable").alias("kind"), "degree")
    cls = d.where(label.rlike("^[A-Z][A-Za-z0-9_]*$")).select(label.alias("name"), F.lit("class").alias("kind"), "degree")
    parts = F.filter(F.split(F.regexp_replace("source_file", r"\.[^./]+$", ""), "/"), lambda p: p != "")
    mod = d.select(F.explode(parts).alias("name"), F.lit("module").alias("kind"), F.lit(0).cast("long").alias("degree"))
    return call.unionByName(cls).unionByName(mod).groupBy("name", "kind").agg(F.max("degree").alias("degree"))


def members(nodes: DataFrame) -> DataFrame:
    """``module, member`` of code files."""
    stem = F.regexp_replace(T.basename(F.col("source_file")), r"\.[^.]+$", "")
    return nodes.where("file_type = 'code'").select(stem.alias("module"), F.regexp_replace("label", r"^\.|\(\)$", "").alias("member")).distinct()


def draft_references(code: str) -> list[tuple[str, str, str | None]]:
    """(kind, name, module) of what a Python draft refers to; a syntax error is one row."""
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return [("syntax_error", "", None)]
    defined = {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    defined |= {a.arg for n in ast.walk(tree) if isinstance(n, ast.arguments) for a in [*n.args, *n.kwonlyargs]}
    defined |= {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    out, modules = [], {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out.append(("module", a.name.split(".")[-1], None))
                modules[a.asname or a.name.split(".")[0]] = a.name.split(".")[-1]
        elif isinstance(n, ast.ImportFrom) and n.module:
            stem = n.module.split(".")[-1]
            out.append(("module", stem, None))
            out += [("member", a.name, stem) for a in n.names if a.name != "*"]
            defined |= {a.asname or a.name for a in n.names}
    import builtins

    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name) and f.id not in defined and f.id not in modules and not hasattr(builtins, f.id):
                out.append(("call", f.id, None))
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in modules:
                out.append(("member", f.attr, modules[f.value.id]))
    return list(dict.fromkeys(out))


def check_drafts(drafts: DataFrame, space: DataFrame, member: DataFrame) -> DataFrame:
    """``draft_id, kind, name`` of references that the symbol space doesn't have; modules that it doesn't know pass."""
    def work(frames):
        for pdf in frames:
            rows = [(i, *r) for i, c in zip(pdf["draft_id"], pdf["code"]) for r in draft_references(c or "")]
            yield pd.DataFrame(rows, columns=["draft_id", "kind", "name", "module"])

    refs = drafts.select(F.col("draft_id").cast("long").alias("draft_id"), "code").mapInPandas(work, "draft_id long, kind string, name string, module string")
    names = space.select("name").distinct()
    bad_syntax = refs.where("kind = 'syntax_error'").select("draft_id", "kind", "name")
    calls = refs.where("kind = 'call'").join(names, "name", "left_anti").select("draft_id", "kind", "name")
    known = member.select("module").distinct()
    mem = refs.where("kind = 'member'").join(known, "module", "left_semi")
    mem = mem.join(member.withColumnRenamed("member", "name"), ["module", "name"], "left_anti").select("draft_id", "kind", "name")
    return bad_syntax.unionByName(calls).unionByName(mem)


def enum_schema(space: DataFrame, cap: int = 2000) -> dict:
    """A JSON schema whose names are the best connected symbols."""
    rows = space.where("kind <> 'module'").orderBy(F.desc("degree"), "name").limit(cap).collect()
    return {"type": "object", "properties": {"name": {"type": "string", "enum": [r["name"] for r in rows]}}, "required": ["name"]}


def grammar(space: DataFrame, cap: int = 2000) -> str:
    """The same as a GBNF rule."""
    return "root ::= " + " | ".join(f'"{n}"' for n in enum_schema(space, cap)["properties"]["name"]["enum"])
