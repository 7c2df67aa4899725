"""Small hand-made graphs with known answers."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import analysis, community, components, entities, graph, history, incremental, iterate, packing, search, verification
from loomgraph.plans import graph_queries
from loomgraph.sinks import export
from loomgraph.sources import extract, manifests
from loomgraph.streaming import changes

TINY = "/root/testdata/sf0.001"
NODES = "id string, label string, file_type string, source_file string, community int"
EDGES = "src string, dst string, relation string, confidence string, context string"


def make(spark, nodes, edges):
    ns = [(n + (None,) * 5)[:5] for n in nodes]
    es = [(*e[:3], e[3] if len(e) > 3 else "EXTRACTED", e[4] if len(e) > 4 else None) for e in edges]
    return spark.createDataFrame(ns, NODES), spark.createDataFrame(es, EDGES)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def search_graph(spark):
    return make(
        spark,
        [("n1", "extract", "code", "extract.py", 0), ("n2", "cluster", "code", "cluster.py", 0), ("n3", "build", "code", "build.py", 1), ("n4", "report", "code", "report.py", 1), ("n5", "isolated", "code", "other.py", 2)],
        [("n1", "n2", "calls", "EXTRACTED", "call"), ("n2", "n3", "imports", "EXTRACTED", "import"), ("n3", "n4", "uses")],
    )


def test_search_scenario(spark, search_graph):
    n, e = search_graph
    assert rows(iterate.bfs(n, e, spark.createDataFrame([("n1",)], "id string"), 1), "id") == [("n1",), ("n2",)]
    top = search.ranked_scores(n, ["cluster"], 1).first()
    assert top["id"] == "n2"
    found = search.query_graph(n, e, "how does extract work", 2, ["call"])
    assert rows(found, "id") == [("n1",), ("n2",)]
    assert search.resolve_seed(n, "report").first()["id"] == "n4"
    assert search.resolve_seed(n, "py").first() is None
    full = {r["id"] for r in n.collect() if "ust" in r["label"]}
    assert {r["id"] for r in search.trigram_candidates(n, "ust").collect()} == full
    assert X.query_terms("what is the API of auth") == ["api", "auth"] and X.query_terms("is it") == ["is", "it"]
    assert "extract" in export.graph_text(n, e, found.join(n.select("id"), "id"))


CLAIM_NODES = [
    ("auth", "auth.py", "code", "auth.py"), ("session", "session.py", "code", "session.py"), ("login", "login()", "code", "auth.py"), ("validate", "validate_token()", "code", "auth.py"),
    ("sess", "Session", "code", "session.py"), ("base", "BaseModel", "code", "session.py"), ("orphan", "OrphanWidget", "code", "widget.py"),
]
CLAIM_EDGES = [("auth", "session", "imports"), ("login", "validate", "calls", "INFERRED"), ("sess", "base", "inherits"), ("auth", "login", "contains"), ("auth", "validate", "contains"), ("session", "sess", "contains")]


@pytest.fixture(scope="module")
def claim_graph(spark):
    return make(spark, CLAIM_NODES, CLAIM_EDGES)


def test_claims_of_other_kinds(spark, claim_graph):
    n, e = claim_graph
    file = n.where("label = 'auth.py'").first()
    alone = n.where("label = 'login()' or label = 'login'").first()
    c = [
        ("auth.py", "imports", "session.py"), ("login", "exists", ""), ("ghost", "exists", ""), ("login", "defined_in", alone["source_file"]),
        ("login", "defined_in", "nowhere.xyz"), ("ghost", "defined_in", "a.py"), ("login", "defined_in", ""), ("login", "calls", ""),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(c)], "claim_id long, subject string, relation string, object string")
    e = e.withColumn("relation", F.when(F.col("relation") == "imports", "imports_from").otherwise(F.col("relation")))
    v = dict(rows(verification.claim_verdicts(df, n, e), "claim_id", "verdict"))
    assert file and [v[i] for i in range(8)] == ["VERIFIED", "VERIFIED", "UNKNOWN", "VERIFIED", "REFUTED", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert verification.claims_in("See `login`. `a` depends on `b`. `Box` defines `open`.") == [("login", "exists", ""), ("a", "uses", "b"), ("Box", "contains", "open")]


def test_claims(spark, claim_graph):
    n, e = claim_graph
    text = "`login` calls `validate_token`. `validate_token` calls `login`. `Session` extends `BaseModel`. `login` calls `OrphanWidget`. `login` uses `session.py`. `login` calls `nothing`."
    got = verification.claims_in(text)
    assert got[2] == ("Session", "inherits", "BaseModel") and len(got) == 6
    c = spark.createDataFrame([(i, *x, i % 2) for i, x in enumerate(got)], "claim_id long, subject string, relation string, object string, insight_id int")
    v = verification.claim_verdicts(c, n, e)
    assert dict(rows(v, "claim_id", "verdict")) == {0: "VERIFIED", 1: "REFUTED", 2: "VERIFIED", 3: "REFUTED", 4: "VERIFIED_INDIRECT", 5: "UNKNOWN"}
    assert rows(verification.admit(c, v), "insight_id", "status", "memory_id") == [(0, "ADMITTED", "m1"), (1, "REJECTED", None)]
    memory = spark.createDataFrame([(0, "quarantined"), (1, "active")], "insight_id int, status string")
    assert rows(verification.reverify(memory, c, v), "insight_id", "change") == [(0, "resurrected"), (1, "quarantined")]
    docs = spark.createDataFrame([(7, text, "x")], "doc_id long, text string, relation string")
    assert verification.extract_claims(docs).count() == 6
    mem = spark.createDataFrame([(1, "login is checked", ["Login"]), (2, "nothing here", ["db"])], "insight_id int, insight string, anchors array<string>")
    assert rows(verification.recall(mem, "where does login happen"), "insight_id", "score") == [(1, 2)]


def test_symbol_space(spark, claim_graph):
    n, e = claim_graph
    s = verification.symbol_space(n, e)
    assert {r["name"] for r in s.where("kind = 'callable'").collect()} == {"login", "validate_token"}
    assert {"Session", "BaseModel", "OrphanWidget"} == {r["name"] for r in s.where("kind = 'class'").collect()}
    assert verification.enum_schema(s)["properties"]["name"]["enum"][0] in ("login", "validate_token", "Session")
    drafts = spark.createDataFrame([(1, "import auth\nauth.login()\nauth.gone()\nmissing()\nprint(1)"), (2, "def ("), (3, "import numpy\nnumpy.zeros(3)"), (4, "from auth import login, nope\nlogin()")], "draft_id long, code string")
    bad = verification.check_drafts(drafts, s, verification.members(n))
    assert rows(bad, "draft_id", "kind", "name") == [(1, "call", "missing"), (1, "member", "gone"), (2, "syntax_error", ""), (4, "member", "nope")]


def test_impact(spark):
    n, e = make(spark, [("db", "db()", "code", "db.py"), ("svc", "service()", "code", "service.py"), ("h", "handlers()", "code", "handlers.py"), ("s", "strings()", "code", "strings.py")], [("svc", "db", "calls"), ("h", "svc", "calls")])
    p = iterate.impact_prediction(n, e, ["db"])
    assert rows(p, "id", "depth") == [("h", 2), ("svc", 1)]
    changed = analysis.changed_files((n, e), (n.unionByName(make(spark, [("s2", "x()", "code", "strings.py")], [("a", "b", "c")])[0]), e))
    assert rows(changed) == [("strings.py",)]
    assert rows(analysis.contract_check(changed, p), "place", "verdict") == [("outside", "DEVIATION"), ("untouched", "DEVIATION"), ("untouched", "DEVIATION")]
    same = analysis.changed_files((n, e), (n, e))
    assert {r["verdict"] for r in analysis.contract_check(same, p).collect()} == {"NO_CHANGES"}


def test_members_are_seeds_but_not_reported(spark):
    n, e = make(spark, [("p", "Processor"), ("pc", ".call()"), ("r", "Runner"), ("rr", ".run()")], [("p", "pc", "method"), ("r", "rr", "method"), ("rr", "pc", "calls")])
    assert rows(iterate.reverse_impact(e, "p"), "id") == [("rr",)]


def test_session(spark):
    n, e = make(spark, [("routes", "routes()", "code", "routes.py", 1), ("service", "service()", "code", "service.py", 2), ("db", "db()", "code", "db.py", 3)], [("routes", "service", "calls"), ("service", "db", "calls")])
    s = packing.Session(n, e)
    assert s.run("find service") == ["n1 service"] and s.run("find service") == ["n1 service"]
    assert s.run("callers n1") == ["n2 routes"] and s.run("callees n1") == ["n3 db"]
    assert s.run("path n2 -> n3") == ["n2 -> n1 -> n3"] and s.run("common n2 -> n3") == ["n1 service"]
    assert s.run("note x") == ["noted (1)"] and s.run("notes") == ["x"] and s.run("dance n1") == ["unknown operation dance"]
    assert s.run("source n3") == ["db.py"] and s.run("community n3") == ["n3 db"] and s.run("expand n1")[0].startswith("n")
    assert iterate.depth_first(n, e, "routes") == ["routes", "service", "db"]


def test_history(spark):
    log = []
    for i in range(5):
        log.append(("feat: both", ["api.py", "schema.py"]))
    log += [("chore: api", ["api.py"]), ("feat: a", ["risky.py"]), ("feat: b", ["risky.py"]), ("fix: c", ["risky.py"]), ("fix bug", ["risky.py"]), ('Revert "b"', ["risky.py"]), ("feat", ["solo.py", "yarn.lock"])]
    text = "".join(f"\x01{s}\x02\n" + "\n".join(p) + "\n" for s, p in log)
    c = history.quiet(history.parse_log(spark.createDataFrame([(text,)], "value string")))
    d = {r["path"]: r for r in history.danger(c).collect()}
    assert d["api.py"]["edits"] == 6 and d["risky.py"]["danger"] == 0.8 and d["solo.py"]["danger"] == 0 and "yarn.lock" not in d
    couples = history.cochange(c)
    assert rows(couples, "path", "support", "confidence") == [("api.py", 5, 0.833333), ("schema.py", 5, 1.0)]
    w = history.edit_warnings(spark.createDataFrame([("api.py",), ("risky.py",)], "path string"), history.danger(c), couples)
    assert rows(w) == [("api.py", "partner", "schema.py"), ("risky.py", "danger", "0.8")]
    paths = spark.createDataFrame([("a/x.py",), ("b/x.py",), ("c/y.py",)], "path string")
    assert history.unique_suffix(paths, "y.py").first()["path"] == "c/y.py" and history.unique_suffix(paths, "x.py").first() is None


def test_multigraph(spark):
    n, e = make(spark, [("a", "a"), ("b", "b"), ("c", "c")], [("a", "b", "calls"), ("a", "b", "calls"), ("a", "b", "uses"), ("b", "b", "calls"), ("a", "zz", "calls"), ("", "b", "calls"), ("a", "b", "calls", "EXTRACTED", "x")])
    r = graph.multigraph_diagnostics(n, e).first()
    assert (r["n_raw"], r["n_valid"], r["n_missing"], r["n_dangling"], r["n_self_loops"], r["n_directed_pairs"], r["n_collapsed"], r["n_relation_variants"]) == (7, 5, 1, 1, 1, 2, 3, 1)


def test_edge_fold(spark):
    _, e = make(spark, [("a",)], [("a", "b", "calls", "EXTRACTED", "call"), ("b", "a", "calls", "INFERRED", None), ("a", "b", "uses", "INFERRED", None), ("c", "a", "uses", "AMBIGUOUS", "x")])
    # in order: a>b calls, a>b uses (context survives), then b>a calls replaces, since the stored relation is uses
    assert rows(graph.collapsed_edges(e), "src", "dst", "relation", "confidence", "context") == [("b", "a", "calls", "INFERRED", "call"), ("c", "a", "uses", "AMBIGUOUS", "x")]
    same = e.where("relation = 'calls'")
    assert rows(graph.collapsed_edges(same), "src", "dst") == [("a", "b")]


def test_duplicate_policies(spark):
    d = spark.createDataFrame([("a", "x", None, 1), ("a", None, "y", 2)], "id string, p string, q string, ord int")
    assert rows(graph.resolve_duplicates(d, ["id"], "ord", "first"), "p", "q") == [("x", None)]
    assert rows(graph.resolve_duplicates(d, ["id"], "ord", "last"), "p", "q") == [(None, "y")]
    assert rows(graph.resolve_duplicates(d, ["id"], "ord", "merge"), "p", "q") == [("x", "y")]


def test_diff(spark):
    a = make(spark, [("n1", "A"), ("n2", "B")], [("n1", "n2", "calls")])
    b = make(spark, [("n1", "A"), ("n2", "B"), ("n3", "Gamma")], [("n2", "n1", "calls"), ("n2", "n3", "uses")])
    d = analysis.graph_diff(*a, *b)
    assert rows(d, "kind", "change", "a") == [("edge", "added", "n2"), ("node", "added", "n3")]
    assert analysis.diff_summary(d) == "1 new node, 1 new edge"
    assert analysis.diff_summary(analysis.graph_diff(*a, *a)) == "no changes"


def test_community_ids(spark):
    f = lambda m: spark.createDataFrame([(i, c) for c, ids in m.items() for i in ids], "id string, community int")
    assert sorted(community.remapped(f({10: "abc", 11: "de"}), f({5: "abc", 1: "de"})).values()) == [1, 5]
    assert community.remapped(f({7: "xyz", 8: "m"}), f({3: "a"})) == {7: 0, 8: 1}


def test_cohesion_and_detection(spark):
    k = [(a, b, "calls") for i, a in enumerate("abcd") for b in "abcd"[i + 1 :]] + [(a, b, "calls") for i, a in enumerate("wxyz") for b in "wxyz"[i + 1 :]] + [("a", "w", "calls")]
    n, e = make(spark, [(c, c) for c in "abcdwxyzq"], k)
    m = community.detect(n, e)
    groups = {}
    for r in m.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert set(map(frozenset, groups.values())) == {frozenset("abcd"), frozenset("wxyz"), frozenset("q")}
    assert {r["cohesion"] for r in community.cohesion(e, m).collect()} == {1.0}
    assert community.modularity(e, m) > 0.3
    votes = community.hub_votes(e, m.where("id <> 'a'"), spark.createDataFrame([("a",)], "id string"))
    assert votes.first()["community"] == m.where("id = 'b'").first()["community"]
    b = dict(rows(iterate.betweenness(n, e), "id", "score"))
    assert b["a"] == b["w"] == max(b.values()) and b["q"] == 0
    eb = {(r["u"], r["v"]): r["score"] for r in iterate.edge_betweenness(n, e).collect()}
    assert max(eb, key=eb.get) == ("a", "w")
    assert community.split_members(m, e, 9, min_size=3, share=0.1).count() == 9


def test_detection_is_whole(spark):
    path = [f"p{i:02}" for i in range(60)]
    star = [f"s{i:02}" for i in range(60)]
    n, e = make(spark, [(c, c) for c in path + star], [(a, b, "calls") for a, b in zip(path, path[1:])] + [("s00", c, "calls") for c in star[1:]])
    with pytest.raises(RuntimeError):
        community.detect(n, e, rounds=1, here=0)
    one = n.select("id", F.ascii("id").alias("community"))
    by = {}
    for r in community.split_loose(one, e).collect():
        by.setdefault(r["community"], set()).add(r["id"])
    assert set(star) in by.values() and len(by) > 4
    assert community.modularity(e, community.detect(n, e)) > 0.6
    assert not [r for r in community.cluster(n, e).groupBy("community").count().collect() if r["count"] > 30 and r["count"] != 60]


def test_detection_by_rounds(spark):
    n, e = make(spark, [(c, c) for c in "abcxyz"], [(*p, "calls") for p in ("ab", "bc", "ac", "xy", "yz", "xz", "cx")])
    groups = community.detect(n, e, here=0).groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("id")), "").alias("g"))
    assert {r["g"] for r in groups.collect()} == {"abc", "xyz"}


def test_detection_settles_large_levels_without_rounds(spark, monkeypatch):
    def rounds(*args):
        raise AssertionError("a level of this size needs no rounds")

    n = spark.range(2500).select(F.concat(F.lit("n"), "id").alias("id"))
    ring = spark.range(2500).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(249)))).where("id div 250 = (id + d) div 250 or (id % 250 = 249 and d = 1)")
    e = ring.select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), (F.col("id") + F.col("d")) % 2500).alias("dst")).persist()
    assert e.count() * 2 > 500_000
    monkeypatch.setattr(community, "_settled", rounds)
    m = community.detect(n, e.unionByName(e)).persist()
    assert m.count() == 2500 and community.modularity(e, m) > 0.8
    at, near = dict(m.collect()), {}
    for a, b in e.collect():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    tot, m2 = {}, sum(map(len, near.values()))
    for i in near:
        tot[at[i]] = tot.get(at[i], 0) + len(near[i])
    for i, found in near.items():  # the blocks are far apart, so no single move may gain after merging either
        into = {c: sum(at[b] == c for b in found) for c in {at[i], *map(at.get, found)}}
        gain = {c: w - len(found) * (tot[c] - len(found) * (c == at[i])) / m2 for c, w in into.items()}
        assert gain[at[i]] >= max(gain.values()) - 1e-6


def test_clustering_at_once(spark, monkeypatch):
    blocks = {x: [f"{x}{i:02}" for i in range(20)] for x in "abc"}
    star = [f"s{i:02}" for i in range(60)]
    ends = [(u, v) for b in blocks.values() for u in b for v in b if u < v] + [("a00", "b00"), ("c00", "c00"), ("c01", "out"), ("out", "c02")]
    n, e = make(spark, [(c, c) for b in blocks.values() for c in b] + [(c, c) for c in star] + [("alone", "alone")], [(*p, "calls") for p in ends] + [("s00", c, "calls") for c in star[1:]])
    whole = {r["id"]: r["community"] for r in community.cluster(n, e, here=1386).collect()}  # by tables, its levels on the driver

    def tables(*args, **more):
        raise AssertionError("a graph of this size is clustered at once")

    monkeypatch.setattr(community, "detect", tables)
    monkeypatch.setattr(community, "_split", tables)
    once = community.cluster(n, e).collect()
    assert {r["id"]: r["community"] for r in once} == whole and len(once) == len(whole) == 121
    assert [whole[x] for x in ("s59", "a19", "b00", "c05", "alone")] == [0, 1, 2, 3, 4]
    assert community.cluster(n.limit(0), e).count() == 0
    assert community.cluster(n.limit(0), e.limit(0)).count() == 0
    assert community.cluster(n, e.limit(0)).agg(F.count_distinct("community")).first()[0] == 121


def test_moves_in_rounds_leave_no_gain():
    rnd = np.random.default_rng(3)
    i, j = np.unique(np.sort(rnd.integers(0, 6000, (24000, 2))), axis=0).T
    i, j = i[i < j], j[i < j]
    singly, single = [], community._one_by_one
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort([b, a])
    ptr = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=6000))])
    for weight in (None, rnd.integers(1, 9, len(i)).astype("f8")):
        w = np.ones(len(a)) if weight is None else np.concatenate([weight, weight])[order]
        k = np.bincount(a[order], w, 6000)
        m2 = np.full(6000, k.sum())
        with pytest.MonkeyPatch.context() as m:
            m.setattr(community, "_one_by_one", lambda *x: singly.append(len(x[-1])) or single(*x))
            at = community._moved_here(ptr, b[order].astype("i4"), None if weight is None else w, k, m2)
        assert singly[-1] == 0 and max(singly) < 3000
        singly.clear()
        tot = np.bincount(at, k, 6000)
        into = np.zeros((6000, 6000))
        np.add.at(into, (a[order], at[b[order]]), w)
        gain = into - k[:, None] / m2[:, None] * (tot[None] - (at[:, None] == np.arange(6000)) * k[:, None])
        near = into > 0
        assert (np.where(near, gain, -np.inf).max(1, initial=-np.inf) <= gain[np.arange(6000), at] + 1e-6).all()


def test_registered_detection_splits_loose_communities(spark):
    n, e = graph_queries.kg(spark, TINY)
    whole = graph_queries.community_detection(spark, TINY)
    fine = whole.join(community.detect(n, e).withColumnRenamed("community", "parent"), "id").persist()
    assert fine.groupBy("community").agg(F.count_distinct("parent").alias("k")).where("k > 1").count() == 0
    assert fine.select("community").distinct().count() > fine.select("parent").distinct().count()


def test_registered_betweenness_has_all_pivots(spark, monkeypatch):
    def pivots(nodes, edges, pivots=100, **more):
        return pivots

    monkeypatch.setattr(iterate, "betweenness", pivots)
    assert graph_queries.betweenness_sampled(spark, TINY) == 100


def test_betweenness_of_large_graphs(spark, monkeypatch):
    rnd = random.Random(5)
    path = [(f"p{i}", f"p{i + 1}") for i in range(8)]
    knot = [(f"k{rnd.randrange(40):02}", f"k{rnd.randrange(40):02}") for _ in range(90)]
    ends = path + knot + [("p8", "k00"), ("k01", "k00"), ("k01", "out"), ("k02", "out"), ("k03", "k03")]
    ids = sorted({x for p in ends for x in p} - {"out"}) + ["alone"]
    n, e = make(spark, [(i, i) for i in ids], [(*p, "calls") for p in ends])
    near = {}
    for u, v in ends:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)

    def walks(s):  # distance and number of shortest walks from s
        d, k, queue = {s: 0}, {s: 1}, [s]
        for v in queue:
            for w in near.get(v, ()):
                if w not in d:
                    d[w], k[w] = d[v] + 1, 0
                    queue.append(w)
                if d[w] == d[v] + 1:
                    k[w] += k[v]
        return d, k

    def whole(*args, **more):
        raise AssertionError("the graph must not be on the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", whole)
    of = {i: walks(i) for i in [*ids, "out"]}
    norm = 1 / ((len(ids) - 1) * (len(ids) - 2))

    def score(v, sources, scale):
        dv, kv = of[v]
        pairs = ((s, t) for s in sources if s != v and v in of[s][0] for t in of[s][0] if t not in (s, v) and t in dv)
        return scale * norm * sum(of[s][1][v] * kv[t] / of[s][1][t] for s, t in pairs if of[s][0][v] + dv[t] == of[s][0][t])

    some = [r["id"] for r in n.orderBy(F.xxhash64("id"), "id").limit(7).collect()]
    for more, sources, scale in (({}, ids, 1), ({"pivots": 7, "limit": 20}, some, len(ids) / 7)):
        for packed in (10**6, 0):
            found = dict(rows(iterate.betweenness(n, e, packed=packed, **more), "id", "score"))
            assert found.keys() == set(ids)
            assert all(abs(found[v] - score(v, sources, scale)) < 2e-9 for v in ids)


def test_edges_of_betweenness_are_packed_once(spark, monkeypatch):
    ends = [("a", "b"), ("b", "a"), ("b", "c"), ("b", "c"), ("c", "d"), ("d", "out"), ("d", "d")]
    n, e = make(spark, [(i, i) for i in "abcd"], [(*p, "calls") for p in ends])
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    hashes, lists = iterate._packed_graph(n.select("id"), e, 3)
    assert hashes.agg(F.sum("n")).first()[0] == 5 and lists.agg(F.sum("n")).first()[0] == 4
    right = rows(iterate.betweenness(n, e), "id", "score")
    assert spark.conf.get(key) == before and dict(right)["a"] == 0 < dict(right)["b"]
    with monkeypatch.context() as m:
        m.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # all ids share a hash
        assert rows(iterate.betweenness(n, e), "id", "score") == right


def test_cycles(spark):
    _, e = make(spark, [("a",)], [("a", "b", "x"), ("b", "a", "x"), ("b", "c", "x"), ("c", "a", "x"), ("d", "d", "x")])
    assert rows(iterate.bounded_cycles(e), "length", "cycle") == [(1, "d"), (2, "a>b"), (3, "a>b>c")]


def test_slice(spark):
    n, e = make(spark, [(x, x, "code", f"{x}.py") for x in ("api", "core", "util", "test_core", "other")], [("api", "core", "imports_from"), ("core", "util", "imports_from"), ("test_core", "core", "imports_from")])
    deps = iterate.file_dependencies(n, e)
    c = iterate.import_closure(deps, spark.createDataFrame([("api.py",)], "id string"))
    assert rows(c, "id") == [("api.py",), ("core.py",), ("util.py",)]
    assert rows(iterate.tests_for(deps, c, X.is_test_path)) == [("test_core.py",)]


def test_hyperedges(spark):
    h = spark.createDataFrame([("auth", ["a", "b"]), ("", ["a"]), ("dead", ["a", "zz"])], "id string, nodes array<string>")
    n, _ = make(spark, [("a", "a"), ("b", "b")], [("a", "b", "c")])
    kept = incremental.attach_hyperedges(h, h)
    assert kept.count() == 2
    assert rows(incremental.surviving_hyperedges(kept, n), "id") == [("auth",)]


def test_entities(spark):
    pairs = [("graphextractor", "graph extractor"), ("userservice", "orderservice"), ("ai", "ml"), ("step 1 of the plan", "step 2 of the plan"), ("session manager", "session manager base")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("s", entities.jaro_winkler_udf("a", "b") * 100)
    ok = df.select("a", entities.guarded(F.col("a"), F.col("b"), F.col("s"), F.lit(False)).alias("ok"))
    assert dict(rows(ok)) == {"graphextractor": True, "userservice": False, "ai": False, "step 1 of the plan": False, "session manager": False}
    n, e = make(spark, [("sm", "Session Manager", "document", "a.md"), ("sm_c2", "session-manager", "document", "a.md"), ("x", "Other thing entirely", "document", "b.md")], [("sm_c2", "x", "references"), ("sm", "sm_c2", "references"), ("x", "x", "references")])
    kept, edges, mapping = entities.deduplicated(n, e)
    assert rows(kept, "id") == [("sm",), ("x",)] and rows(mapping) == [("sm_c2", "sm")]
    assert rows(edges, "src", "dst") == [("sm", "x"), ("x", "x")]


@given(st.text(max_size=20), st.text(max_size=20))
@settings(max_examples=100, deadline=None)
def test_jaro_is_a_similarity(a, b):
    assert 0 <= entities.jaro(a, b) <= entities.jaro_winkler(a, b) + 1e-12 <= 1 + 1e-9
    assert abs(entities.jaro(a, b) - entities.jaro(b, a)) < 0.2 and entities.jaro(a, a) == 1


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_ids_are_stable(s):
    once = X.normalize_id(s)
    assert X.normalize_id(once) == once


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
@settings(max_examples=5, deadline=None)
def test_components_are_the_closure(spark, pairs):
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    low = {x: x for p in pairs for x in p}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert got == low


def test_surprise_suppression(spark):
    n, e = make(
        spark, [("a", "alpha", "code", "src/a.py", 0), ("b", "beta", "code", "web/b.js", 1), ("c", "gamma", "code", "src/c.py", 0)],
        [("a", "b", "calls", "INFERRED"), ("a", "c", "semantically_similar_to", "INFERRED"), ("b", "c", "calls", "EXTRACTED")],
    )
    s = {(r["src"], r["dst"]): r["score"] for r in analysis.surprises(n, e).collect()}
    assert s == {("a", "b"): 0, ("a", "c"): 3, ("b", "c"): 1 + 2 + 1}
    assert analysis.suggested_questions(n.drop("community"), e, n.select("id", "community")).count() > 0


def test_extractors(spark):
    files = [
        ("docs/read.md", "# Top\n\n## Sub\n[x](../other.md)\n```\n# no\n```\n# End"),
        ("pkg/auth.py", 'import os\nfrom pkg.util import helper\n\nclass A(B):\n    """A class that does a good deal."""\n    def run(self):\n        helper()\n\ndef login():\n    helper()\n    check()\n\ndef check():\n    pass\n'),
        ("pkg/util.py", "def helper():\n    return 1\n"),
        ("db/schema.sql", "CREATE TABLE a (id int); create table b (a_id int references a(id));\nCREATE VIEW v AS SELECT * FROM a JOIN b ON 1=1; CREATE TRIGGER t AFTER INSERT ON b BEGIN x; END;"),
        ("web/x.ts", "import {y} from './y';\nexport class Foo {}\nfunction bar() {}\n"),
        ("package.json", '{"name": "x", "dependencies": {"left-pad": "1"}}'),
        ("bad.py", "def ("), ("photo.png", ""),
    ]
    frag = extract.extract(spark.createDataFrame(files, "path string, text string")).cache()
    assert frag.count() == 7 and rows(frag.where("error is not null"), "path") == [("bad.py",)]
    n, e, c = extract.exploded(frag)
    edges = {(r["src"], r["dst"], r["relation"]) for r in e.collect()}
    assert ("docs_read", "docs_read_top", "contains") in edges and ("docs_read_top", "docs_read_sub", "contains") in edges and ("docs_read_sub", "other", "references") in edges
    assert not any("no" == r["label"] for r in n.collect())
    assert ("pkg_auth_a", "pkg_auth_a_run", "method") in edges and ("pkg_auth_a_rationale", "pkg_auth_a", "rationale_for") in edges
    assert ("db_schema_b", "db_schema_a", "references") in edges and ("db_schema_v", "db_schema_b", "reads_from") in edges and ("db_schema_b", "db_schema_t", "triggers") in edges
    assert ("package", "pkg_left_pad", "depends_on") in edges and ("web_x", "web_x_foo", "contains") in edges and ("web_x", "y", "imports_from") in edges
    calls = extract.resolved_calls(n, e, c)
    assert rows(calls, "src", "dst", "confidence") == [
        ("pkg_auth_a_run", "pkg_util_helper", "EXTRACTED"), ("pkg_auth_login", "pkg_auth_check", "EXTRACTED"), ("pkg_auth_login", "pkg_util_helper", "EXTRACTED"),
    ]


def test_readers(spark, tmp_path):
    g = {"nodes": [{"id": "a", "label": "A", "source": "a.py"}], "links": [{"from": "a", "to": "b", "relation": "calls"}], "hyperedges": [{"id": "h", "members": ["a", "b"]}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    n, e, h = extract.read_graph_json(spark, str(tmp_path / "g.json"))
    assert rows(n, "id", "source_file") == [("a", "a.py")] and rows(e, "src", "dst", "confidence") == [("a", "b", "EXTRACTED")] and h.first()["nodes"] == ["a", "b"]
    docs = spark.createDataFrame([("m", '---\ntype: qa\ndate: "2024-01-02"\noutcome: useful\nsource_nodes: ["a", "b"]\n---\nbody')], "doc string, text string")
    r = extract.front_matter(docs).first()
    assert (r["type"], r["date"], r["outcome"], r["source_nodes"], r["correction"]) == ("qa", "2024-01-02", "useful", ["a", "b"], None)
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "node_modules" / "b.py").write_text("x = 1")
    assert rows(extract.scan(spark, str(tmp_path / "src"))) == [("a.py", "x = 1")]
    p = spark.createDataFrame([("build/x.o",), ("src/a.log",), ("src/keep.log",), ("src/a.py",)], "path string")
    assert {r["path"] for r in extract.ignored(p, ["build/", "*.log", "!keep.log"]).where("ignored").collect()} == {"build/x.o", "src/a.log"}
    t = spark.createDataFrame([("x", "a\n# b\nc\n\nd " * 50)], "path string, text string")
    s = extract.slices(t, 60).orderBy("part").collect()
    assert s[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(s, s[1:])) and s[-1]["end"] == len("a\n# b\nc\n\nd " * 50)
    assert extract.salvaged_json('so: ```json\n{"a": {"b": 1}}\n``` ok') == {"a": {"b": 1}} and extract.salvaged_json('"1": "One", "2": "Two"') == {"1": "One", "2": "Two"}
    names = spark.createDataFrame([(".env",), ("src/app.py",), (".ssh/config",)], "path string")
    assert names.where(extract.is_sensitive(F.col("path"))).count() == 2
    for name in ("build", "dist", "bin"):
        (tmp_path / "src" / name).write_text("#!/bin/sh")
    (tmp_path / "src" / "yarn.lock").write_text("x")
    assert [r[0] for r in rows(extract.scan(spark, str(tmp_path / "src")), "path")] == ["a.py", "bin", "build", "dist"]


@pytest.mark.parametrize("path, secret", [
    ("credentials", True), ("notes/credentials/plan.md", True), ("a/.envrc", True), ("x.pfx", True), ("my.crt", True), ("home/.pgpass", True),
    ("api_token.txt", True), ("token-economics-of-recall.md", False), ("password-policy-discussion.md", False), ("secret_store.txt", True),
    ("tokenizer.py", False), ("device_token.py", False), ("oauth_token.json", True), ("src/secretary.md", False), (".token", True), ("app/main.go", False),
])
def test_secrets_by_folder_name_and_word(spark, path, secret):
    df = spark.createDataFrame([(path, "x")], "path string, text string")
    assert df.select(extract.is_sensitive(F.col("path"))).first()[0] == secret


def test_survey(spark):
    files = [("src/a.py", "x"), ("node_modules/b.py", "x"), ("x.egg-info/c.py", "x"), ("secrets/d.md", "x"), ("old/e.md", "x"), ("f.md", "x"), ("go.sum", "x")]
    df = spark.createDataFrame(files, "path string, text string")
    assert rows(extract.survey(df, ["old/"]), "path", "kind") == [("f.md", "document"), ("src/a.py", "code")]


def test_incremental(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    c = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert dict(rows(incremental.manifest_diff(c, m))) == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    n, e = make(spark, [("x", "X", "code", "a.py"), ("y", "Y", "code", "b.py")], [("x", "y", "calls")])
    fresh_n, fresh_e = make(spark, [("x2", "X2", "code", "a.py")], [("x2", "y", "calls")])
    e, fresh_e = (d.withColumn("source_file", F.lit("a.py")) for d in (e, fresh_e))
    nn, ne = incremental.merge_graph(n, e, fresh_n, fresh_e)
    assert rows(nn, "id") == [("x2",), ("y",)] and rows(ne, "src", "dst") == [("x2", "y")]
    assert incremental.same_topology((n, e), (n.withColumn("community", F.lit(9)), e)) and not incremental.same_topology((n, e), (nn, ne))
    assert rows(incremental.unaccounted_losses(n, nn, fresh_n), "id") == []
    rn, re_ = incremental.prefixed(*make(spark, [("lib", "requests", "concept", None), ("q", "q", "code", "q.py")], [("q", "lib", "imports")]), "one")
    gn, ge = incremental.global_add(rn, re_, *make(spark, [("req", "requests", "concept", None), ("z", "z", "code", "z.py")], [("z", "req", "imports")]), "two")
    assert rows(gn, "id") == [("one::lib",), ("one::q",), ("two::z",)] and ("two::z", "one::lib") in rows(ge, "src", "dst")


def test_sinks(spark, search_graph, tmp_path):
    n, e = search_graph
    export.write_graph(n, e, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        export.write_graph(n.where("id = 'n1'"), e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 5
    assert export.cypher(n, e).count() == 8 and export.graphml(n, e).count() == 8
    assert "5 nodes, 3 edges" in export.report(n, e, n.select("id", "community"))
    labels = spark.createDataFrame([("1", "A/b"), ("2", "a b"), ("3", "??")], "id string, label string")
    assert rows(export.safe_names(labels)) == [("1", "A b"), ("2", "a b_2"), ("3", "unnamed")]
    export.log_query(spark, str(tmp_path / "log"), kind="query", n=3)
    assert json.loads(spark.read.text(str(tmp_path / "log")).first()[0]) == {"kind": "query", "n": 3}
    assert export.hub_article(n, e, "n2").count() == 2


def test_prs(spark):
    p = spark.createDataFrame([(1, True, "SUCCESS", "APPROVED"), (2, False, "FAILURE", "APPROVED"), (3, False, "SUCCESS", "APPROVED")], "number int, is_draft boolean, ci_status string, review_decision string")
    assert dict(rows(packing.pr_ladder(p), "number", "status")) == {1: "draft", 2: "failing", 3: "approved"}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows_ = [(f"2024-01-01 00:00:{s:02d}", "a.py", "u", "v") for s in (1, 2, 3, 10, 11)] + [("2024-01-01 00:10:00", "b.py", "u", "w")]
    df = spark.createDataFrame(rows_, "ts string, path string, src string, dst string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(src))

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = lambda: spark.readStream.schema(df.schema).parquet(str(src))
    got = run(changes.debounce_stream(stream()), "quiet", "append")
    assert rows(got, "path", "n") == [("a.py", 2), ("a.py", 3)]
    assert rows(changes.debounce_batches(df.where("path = 'a.py'"), 3), "n") == [(2,), (3,)]
    assert rows(run(changes.distinct_paths(stream()), "once", "append"), "path") == [("a.py",), ("b.py",)]
    deg = run(changes.running_degree(stream()), "deg", "update").groupBy("id").agg(F.max("degree").alias("d"))
    assert dict(rows(deg)) == {"u": 6, "v": 5, "w": 1}
    tumbling = run(changes.tumbling_counts(stream(), "1 minute", "1 minute", "path"), "tumble", "append")
    assert rows(tumbling, "path", "n") == [("a.py", 5)]
    apply = changes.upsert_graph(str(tmp_path / "graph"))
    b0 = spark.createDataFrame([("node", "x", "X", "a.py", None, None, None), ("node", "y", "Y", "b.py", None, None, None), ("edge", None, None, "a.py", "x", "y", "calls")], "kind string, id string, label string, source_file string, src string, dst string, relation string")
    b1 = spark.createDataFrame([("node", "x9", "X9", "a.py", None, None, None)], b0.schema)
    apply(b0, 0)
    apply(b1, 1)
    apply(b1, 1)
    assert rows(spark.read.parquet(str(tmp_path / "graph/nodes/1")), "id") == [("x9",), ("y",)] and spark.read.parquet(str(tmp_path / "graph/edges/1")).count() == 0


def test_scalars(spark):
    d = spark.createDataFrame([("src/tests/test_a.py", "1.5MB", "Hello, World. This is one long sentence here now."), ("./.github/x.yml", "oops", "no")], "p string, s string, t string")
    r = d.select(X.is_test_path(F.col("p")), X.size_literal(F.col("s"), 7), X.is_sentence(F.col("t")), X.bare_path(F.col("p")), X.make_id(F.lit("_a_"), F.lit(""), F.lit("B c"))).collect()
    assert tuple(r[0]) == (True, 1572864, True, "src/tests/test_a.py", "a_b_c") and tuple(r[1])[:4] == (False, 7, False, "github/x.yml")
    u = spark.createDataFrame([("Ünïcode Straße",)], "s string").select(X.normalize_id_udf("s"), X.strip_diacritics("s"), X.norm_label_udf("s")).first()
    assert tuple(u) == ("ünïcode_strasse", "unicode straße", "ünïcode strasse")
    v = spark.createDataFrame([("item1", "item2", True), ("abcd", "abdc", True), ("usera", "userb", True), ("alpha", "omega", False)], "a string, b string, v boolean")
    assert all(x["got"] == x["v"] for x in v.select("v", X.variant_pair(F.col("a"), F.col("b")).alias("got")).collect())
    assert v.where(X.one_edit(F.col("a"), F.col("b"))).count() == 3
    f = spark.createDataFrame([(10, "d/a"), (50, "d/b"), (70, "d/c")], "n_tokens int, path string")
    assert rows(packing.pack_tokens(f, 60)) == [("d/a", 0), ("d/b", 0), ("d/c", 1)]


def test_sql_functions(spark):
    from loomgraph.functions import udfs

    udfs.register(spark)
    assert spark.sql("select kg_norm_id('A-b C'), kg_norm_label('A-b  C'), round(kg_jaro_winkler('martha', 'marhta'), 4), round(kg_jaro('martha', 'marhta'), 4)").first()[:] == ("a_b_c", "a b c", 0.9611, 0.9444)
    assert rows(spark.sql("select * from kg_headings('# A\n```\n# no\n```\n## B')")) == [(1, "A"), (2, "B")]
    assert rows(spark.sql("select subject, object from kg_claims('`a` calls `b`.')")) == [("a", "b")]
    assert rows(spark.sql("select * from kg_slices('ab\ncd\nef', 4)")) == [(0, "ab\n"), (1, "cd\n"), (2, "ef")]


def test_overlay(spark):
    o = spark.createDataFrame([("a", "a.py", "1"), ("b", "b.py", "2"), ("c", "c.py", "3")], "id string, source_file string, fingerprint string")
    f = spark.createDataFrame([("a.py", "1"), ("b.py", "9")], "path string, hash string")
    assert dict(rows(incremental.overlay_state(o, f))) == {"a": "fresh", "b": "stale", "c": "gone"}


@pytest.mark.parametrize("heavy", [512, 3])
def test_components_with_a_hub(spark, monkeypatch, heavy):
    monkeypatch.setattr(components, "HEAVY", heavy)
    hub = [(900, k) for k in range(40)] + [(901, k) for k in range(39, 60)]
    chain = [(1000 + k, 1001 + k) for k in range(30)]
    pairs = hub + chain + [(5000, 5000), (7000, 7001), (7001, 7000), (None, 1), (2, None)]
    out = components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    want = {n: 0 for n in [*range(60), 900, 901]} | {n: 1000 for n in range(1000, 1031)} | {5000: 5000, 7000: 7000, 7001: 7000}
    assert {r["node"]: r["component"] for r in out} == want and len(out) == len(want)
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_interpreter_as_a_column(spark):
    lines = ["#!/bin/sh", "#! /usr/bin/env -S A=1 node --x", "#!/usr/bin/env", "#!", "plain", "", None, "#!/opt/python3.12 -u", "#!/usr/bin/env -i perl5"]
    d = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    got = dict(rows(d.select("k", manifests.interpreter_column(F.col("line")).alias("p"))))
    assert got == {k: manifests.interpreter(line) for k, line in enumerate(lines)}


def test_numbered_names_stay_unique(spark):
    labels = spark.createDataFrame([("1", "a"), ("2", "A"), ("3", "a_2"), ("4", "\U0001f600" * 300)], "id string, label string")
    names = [r["name"] for r in export.safe_names(labels).collect()]
    assert len({n.lower() for n in names}) == 4 and max(len(n.encode()) for n in names) <= 200


def test_logs_of_several_rows(spark):
    d = spark.createDataFrame([("x", "\x01a\x02\nf\n\x01b\x02\ng\n"), ("y", "\x01c\x02\nf\n"), ("z", None)], "repo string, value string")
    assert rows(history.parse_log(d, "repo")) == [("x", 1, "a", "f"), ("x", 2, "b", "g"), ("y", 1, "c", "f")]


def test_size_of_no_literal(spark):
    d = spark.createDataFrame([(None,), ("",), ("x",), ("2k",)], "s string")
    assert [r[0] for r in d.select(X.size_literal(F.col("s"), 5)).collect()] == [5, 5, 5, 2048]


@pytest.mark.parametrize("heavy", [2, 100_000])
def test_walks_with_spread_hubs(spark, monkeypatch, heavy):
    monkeypatch.setattr(iterate, "HEAVY", heavy)
    links = [("h", f"x{i}") for i in range(60)] + [("x3", "y"), ("y", "z"), ("z", "h"), ("s", "h"), ("q", "q")]
    e = spark.createDataFrame([(a, b, "calls") for a, b in links], "src string, dst string, relation string")
    n = spark.createDataFrame([(i,) for i in sorted({x for link in links for x in link})], "id string")
    seed = lambda x: spark.createDataFrame([(x,)], "id string")
    # h is a hub: it is reached, not walked on from, unless it is the seed
    assert rows(iterate.bfs(n, e, seed("s"), 3)) == [("h", 1), ("s", 0)]
    far = dict(rows(iterate.bfs(n, e, seed("h"), 2)))
    assert far["y"] == 2 and far["z"] == 1 and sum(d == 1 for d in far.values()) == 62 and "q" not in far
    back = dict((r["id"], r["depth"]) for r in iterate.reverse_impact(e, "y", 3).collect())
    assert back == {"x3": 1, "h": 2, "s": 3, "z": 3}
    pairs = spark.createDataFrame([("s", "y"), ("x1", "x2"), ("s", "q"), ("s", "s")], "src string, dst string")
    assert rows(iterate.shortest_paths(e, pairs)) == [("s", "s", 0), ("s", "y", 3), ("x1", "x2", 2)]
