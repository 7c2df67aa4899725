"""Identity, building, sections and manifests on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import build, resolution, sections
from loomgraph.runtime import numbered
from loomgraph.sources import manifests

NODE = "id string, label string, file_type string, source_file string, source_location string, _origin string, type string, ord int"
EDGE = "src string, dst string, relation string, confidence string, context string, source_file string"


def nodes(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], "code", *(r[2:] + (None,) * 4)[:4], i) for i, r in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else "EXTRACTED", None, r[4] if len(r) > 4 else "a.py") for r in rows], EDGE)


def pairs(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_short_ids_take_the_path(spark):
    n = nodes(spark, ("auth_login", "login()", "pkg/auth.py"), ("pkg_auth_x", "x", "pkg/auth.py"), ("pkg_auth_y", "y", "pkg/auth.py", None, "ast"), ("auth", "auth.py", "pkg/auth.py"))
    assert pairs(resolution.semantic_rekey(n), "old", "new") == [("auth", "pkg_auth"), ("auth_login", "pkg_auth_login")]


def test_ghosts_join_their_twin(spark):
    n = nodes(spark, ("a_f", "f()", "x/a.py", "L1", "ast"), ("g1", "f()", "y/a.py"), ("g2", "f()", "z/a.py"), ("b1", "h", "x/b.md", "L1"), ("b2", "h", "y/b.md", "L2"))
    e = edges(spark, ("g2", "b1", "uses"))
    n2, e2 = resolution.without_ghosts(n, e)
    assert pairs(n2, "id") == [("a_f",), ("b1",), ("b2",), ("g1",)]  # only the last of a key joins; b is ambiguous
    assert pairs(e2, "src", "dst") == [("a_f", "b1")]
    two = nodes(spark, ("p", "f()", "x/a.py", "L1", "ast"), ("q", "f()", "y/a.py", "L1", "ast"), ("g", "f()", "z/a.py"))
    assert resolution.ghosts(two).count() == 0


def test_colliding_ids_split(spark):
    n = nodes(spark, ("foo", "foo.h", "src/foo.h"), ("foo", "foo.c", "src/foo.c"), ("m", "m", "a.py", None, None, "module"), ("m", "m", "b.py", None, None, "module"), ("z", "z", "a/b/c.md"), ("z", "z", "a.b/c.md"))
    e = edges(spark, ("foo", "z", "calls", "EXTRACTED", "src/foo.c"), ("main", "foo", "imports", "EXTRACTED", "main.c"))
    n2, e2 = resolution.split_collisions(n, e)
    ids = {r["id"] for r in n2.collect()}
    assert {"src_foo_h_foo", "src_foo_c_foo", "m"} <= ids and len([i for i in ids if i.startswith("a_b_c_md_z_")]) == 2
    assert pairs(e2, "src", "dst") == [("main", "src_foo_h_foo"), ("src_foo_c_foo", "z")]
    assert pairs(resolution.merge_declarations(nodes(spark, ("h", "run()", "src/foo.h"), ("c", "run()", "src/foo.c"))), "old", "new") == [("c", "h")]


def test_stubs_rewire(spark):
    n = nodes(spark, ("cls", "Path", "p.py"), ("up", "PATH"), ("st", "Path"), ("fn", "get_db()", "d.py"), ("fs", "get_db"), ("base", "get_db()"))
    e = edges(spark, ("x", "st", "references"), ("x", "up", "references"), ("x", "fs", "references"), ("x", "base", "inherits"))
    n2, e2, m = resolution.rewire_stubs(n, e)
    assert pairs(m, "old", "new") == [("fs", "fn"), ("st", "cls")]
    assert pairs(e2, "dst") == [("base",), ("cls",), ("fn",), ("up",)] and n2.count() == 4
    go = edges(spark, ("x", "fs", "references", "EXTRACTED", "x.go"))
    assert ("fs", "fn") not in pairs(resolution.rewire_stubs(n, go)[2], "old", "new")


def test_phantoms(spark):
    n = nodes(spark, ("p", "p", "a.py"), ("j", "j", "b.js"), ("d", "d", "c.md"))
    e = edges(spark, ("p", "j", "calls", "INFERRED"), ("p", "j", "calls", "EXTRACTED"), ("p", "d", "calls", "INFERRED"), ("p", "j", "imports"), ("d", "p", "references"))
    assert pairs(resolution.phantom_edges_dropped(n, e), "src", "dst", "relation", "confidence") == [("d", "p", "references", "EXTRACTED"), ("p", "j", "calls", "EXTRACTED")]


def test_nearest_candidate(spark):
    rows = [
        ("same", "x/a.py", "1", "x/a.py"), ("same", "x/a.py", "2", "y/b.py"), ("dir", "x/a.py", "1", "x/c.py"), ("dir", "x/a.py", "2", "y/b.py"),
        ("far", "s/u/v/a.py", "1", "s/u/w/b.py"), ("far", "s/u/v/a.py", "2", "t/b.py"), ("tie", "s/a.py", "1", "t/b.py"), ("tie", "s/a.py", "2", "u/b.py"),
        ("mock", "x/a.py", "1", "tests/test_m.py"), ("mock", "x/a.py", "2", "z/m.py"), ("one", "x/a.py", "9", "q/z.py"), ("intest", "tests/test_a.py", "1", "z/m.py"), ("intest", "tests/test_a.py", "2", "tests/test_b.py"),
    ]
    out = resolution.nearest_candidates(spark.createDataFrame(rows, "call string, call_file string, candidate string, file string"))
    assert dict(pairs(out, "call", "candidate")) == {"same": "1", "dir": "1", "far": "1", "mock": "2", "one": "9", "intest": "2"}


def test_nearest_among_lists_no_pairs(spark):
    rnd = random.Random(3)
    files = ["a.py", "x/a.py", "x/b.py", "x/y/a.py", "x/y/z/b.py", "/x/a.py", "w/a.py", "tests/test_a.py", "x/tests/a.py", None]
    callers = [(c, rnd.choice(files), rnd.randrange(9)) for c in range(120)]
    candidates = [(k, f"P{k}{i}", rnd.choice(files)) for k in range(9) for i in range(k // 2 + 1)]
    candidates += candidates[:5]
    test = lambda f: f is not None and "test" in f
    folders = lambda f: f.split("/")[:-1] if f else []

    def verdict(file, found):
        own = test(file)
        if len(found) > 1:
            found = {x for x in found if (test(x[1]) or not any(test(f) for _, f in found) if own else not test(x[1]))}
        near = {}
        for c, f in found:
            shared = next((i for i, (a, b) in enumerate(zip(folders(f), folders(file))) if a != b), min(len(folders(f)), len(folders(file))))
            same = None not in (f, file)
            near.setdefault((2, 0) if same and f == file else (1, 0) if same and folders(f) == folders(file) else (0, shared), []).append(c)
        best = max(near, default=None)
        return near[best][0] if near and (len(found) == 1 or (len(near[best]) == 1 and best > (0, 0))) else None

    want = {c: v for c, f, k in callers if (v := verdict(f, {(x, g) for q, x, g in candidates if q == k}))}
    a, b = spark.createDataFrame(callers, "call int, call_file string, key int"), spark.createDataFrame(candidates, "key int, candidate string, file string")
    assert dict(pairs(resolution.nearest_candidates(a.join(b, "key")), "call", "candidate")) == want and len(want) > 20
    out = resolution.nearest_among(a, b)
    assert dict(pairs(out, "call", "candidate")) == want


def test_calls_on_receivers_and_imports(spark):
    n = nodes(spark, ("A", "Auth", "auth.py"), ("A_run", ".run()", "auth.py"), ("c", "main()", "main.py"), ("h", "helper()", "pkg/util.py"))
    e = edges(spark, ("A", "A_run", "method"))
    calls = spark.createDataFrame([("c", "auth", "run", "main.py"), ("c", "Auth", "run", "main.py"), ("c", "x", "run", "main.py")], "caller string, receiver string, callee string, source_file string")
    types = spark.createDataFrame([("main.py", "auth", "Auth")], "source_file string, receiver string, type_name string")
    assert pairs(resolution.member_calls(calls, types, n, e), "src", "dst") == [("c", "A_run")]
    plain = spark.createDataFrame([("c", "h2", "main.py")], "caller string, callee string, source_file string")
    imp = spark.createDataFrame([("main.py", "h2", "pkg.util", "helper")], "source_file string, alias string, module string, name string")
    assert pairs(resolution.import_guided_calls(plain, imp, n), "src", "dst", "confidence") == [("c", "h", "EXTRACTED")]
    q = spark.createDataFrame([("c", "pkg.util.helper"), ("c", "none.such")], "src string, qualified string")
    assert pairs(resolution.qualified_imports(q, n), "src", "dst") == [("c", "h")]


def test_build(spark):
    n = nodes(spark, ("a_f", "f()", "x\\a.py", "L1", "ast"), ("a_g", "g()", "x/a.py", "L9"), ("a_g", "g()", "x/a.py"), ("", "nothing", "x/a.py")).withColumn("file_type", F.lit("tool"))
    e = edges(spark, ("a_f", "A-G", "calls"), ("a_f", "zz", "calls"), ("x_a_g", "a_f", "calls"))
    gn, ge = build.build(n, e)
    assert pairs(gn, "id", "file_type") == [("a_f", "code"), ("x_a_g", "code")]
    assert pairs(ge, "src", "dst", "relation") == [("x_a_g", "a_f", "calls")]
    h = spark.createDataFrame([("h", ["d", "c", "r"]), ("k", ["r", "d"])], "id string, nodes array<string>")
    f = nodes(spark, ("d", "doc", "d.md"), ("c", "code", "c.py"), ("r", "We chose this because it was by far the simplest.", "d.md")).withColumn("file_type", F.when(F.col("id") == "r", "rationale").otherwise("code"))
    sn, se, sh = build.sanitised(f, edges(spark, ("r", "d", "rationale_for"), ("c", "d", "references")), h)
    assert pairs(sn, "id", "rationale") == [("c", None), ("d", "We chose this because it was by far the simplest.")]
    assert pairs(se, "src", "dst") == [("c", "d")] and sh.first()["nodes"] == ["d", "c"] and sh.count() == 1
    cn, _ = build.compose((n.where("id = 'a_f'"), e), (n.where("id = 'a_f'").withColumn("label", F.lit("new")), e))
    assert pairs(cn, "id", "label") == [("a_f", "new")]
    assert pairs(build.legacy_ids(nodes(spark, ("a", "a.py", "x/a.py", "L1"), ("x_b", "b.py", "x/b.py", "L1"))), "id") == [("a",)]


def test_sections(spark):
    n = nodes(spark, ("a", "main()", "app/m.py"), ("b", "store()", "db/s.py"), ("c", "row()", "db/r.py"))
    e = edges(spark, ("a", "b", "calls"), ("b", "c", "imports"), ("a", "c", "calls", "INFERRED"))
    assert pairs(sections.preferred(sections.drawable(e)), "src", "dst") == [("a", "b")]
    assert pairs(sections.preferred(e.where("relation = 'imports'")), "src") == [("b",)]
    assert sections.diagram_nodes(n, e, 2) == ["a", "b"] and sections.flow_chain(n, e) == ["app", "db"]
    s = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "community int, section string")
    assert pairs(sections.ranked_sections(s, 1), "section", "n") == [("other", 2), ("x", 2)]


def test_manifests(spark):
    files = [
        ("a/pyproject.toml", '[project]\nname = "alpha"\ndependencies = ["beta>=1", "gamma"]'), ("b/pyproject.toml", '[project]\nname = "beta"'), ("go.mod", "module ex.com/m\nrequire (\n\texample.com/x v1.2.3\n)\n"),
        ("pom.xml", "<project><artifactId>app</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>lib</artifactId></dependency></dependencies></project>"),
        ("c/Cargo.toml", '[package]\nname = "one"\n[dependencies]\ntwo = "1"\nserde = "1"'), ("d/Cargo.toml", '[package]\nname = "two"'), ("bad/pyproject.toml", "[["), ("apm.yml", "name: tool\ndependencies:\n  - x/y\n"),
    ]
    f = spark.createDataFrame(files, "path string, text string")
    got = {(r["src"], r["dst"]) for r in manifests.package_edges(f).collect()}
    assert {("pkg_alpha", "pkg_beta"), ("pkg_alpha", "pkg_gamma"), ("pkg_ex_com_m", "pkg_example_com_x"), ("pkg_app", "pkg_lib"), ("pkg_tool", "pkg_x_y")} <= got
    assert pairs(manifests.package_edges(f, True), "src", "dst") == [("pkg_alpha", "pkg_beta"), ("pkg_one", "pkg_two")]
    assert pairs(manifests.crate_edges(f), "src", "dst", "relation") == [("pkg_one", "pkg_two", "crate_depends_on")]
    cfg = json.dumps({"mcpServers": {"Files": {"command": "npx", "args": ["-y", "@scope/server"], "env": {"TOKEN": "x"}}}})
    s = manifests.service_edges(spark.createDataFrame([(".mcp.json", cfg), ("broken.json", "{")], "path string, text string"))
    assert pairs(s, "dst", "relation") == [("env_token", "requires_env"), ("mcp_files", "contains"), ("pkg_scope_server", "uses")]
    docs = spark.createDataFrame([("d1", [("s", "definition"), ("t", "reference")]), ("d2", [("s", "reference"), ("t", "definition"), ("u", "reference")])], "doc string, symbols array<struct<symbol:string,role:string>>")
    d, r = manifests.symbol_index(docs)
    assert pairs(resolution.symbol_external(r, d), "ref", "target", "place") == [("d1@1", "d2#t", "global"), ("d2@0", "d1#s", "global"), ("d2@2", "ext:u", "external")]
    spark.sql("create database if not exists shop")
    spark.range(3).withColumnRenamed("id", "item_id").write.mode("overwrite").saveAsTable("shop.items")
    spark.range(1).createOrReplaceTempView("passing")
    n, e = manifests.catalog_graph(spark, "shop")
    spark.catalog.dropTempView("passing")
    assert pairs(n, "id") == [("shop_items",), ("shop_items_item_id",)] and e.count() == 1
    spark.sql("drop database shop cascade")


@pytest.mark.parametrize(("line", "prog"), [("#!/bin/bash -e", "bash"), ("#!/usr/bin/env -S python3.11 -u", "python"), ("#!/usr/bin/env A=1 node", "node"), ("x", None), (None, None)])
def test_shebang(line, prog):
    assert manifests.interpreter(line) == prog


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000)
    out = numbered(df.repartition(7), ["k"], "n")
    assert out.where("n <> k").count() == 0 and out.count() == 1000
