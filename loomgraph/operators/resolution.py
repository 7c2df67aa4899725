"""Identity across files: ids by source, ghosts, colliding ids, stubs, calls, receivers.

One rule runs through all of it: exactly one candidate, or nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X

#: Header extensions, relations that make a supertype, families whose names ignore case.
HEADERS = ("h", "hpp", "hh", "hxx")
SUPERTYPES = ("inherits", "implements", "extends")
CASELESS = ("sql", "php")
#: Rank of the same folder, above any number of folders shared.
FOLDER = 1 << 30


def stem_id(path: Column) -> Column:
    """Id of a file: its path without the extension."""
    return X.ascii_id(F.regexp_replace(path, r"\.[^./]+$", ""))


def remapped_ends(edges: DataFrame, mapping: DataFrame, own_file: bool = False) -> DataFrame:
    """Edges with ends replaced through (old, new); with ``own_file`` only where ``source_file`` agrees too."""
    out = edges
    for end in ("src", "dst"):
        m = mapping.select(F.col("old").alias("_o"), F.col("new").alias("_n"), *([F.col("source_file").alias("_f")] if own_file else []))
        on = out[end] == m["_o"]
        if own_file:
            on = on & (out["source_file"] == m["_f"])
        out = out.join(m, on, "left").withColumn(end, F.coalesce("_n", end)).drop("_o", "_n", *(["_f"] if own_file else []))
    return out


def semantic_rekey(nodes: DataFrame) -> DataFrame:
    """``old, new`` ids of nodes from outside the parsers whose id starts with a short stem of their file.

    Short stems are the bare file name and the last folder with it; the new id starts with the whole path's.
    """
    n = nodes.where("coalesce(_origin, '') <> 'ast' and source_file <> '' and source_file not like '/%'")
    base = F.regexp_replace(X.basename(F.col("source_file")), r"\.[^.]+$", "")
    parent = F.element_at(F.concat(F.array(F.lit(""), F.lit("")), F.split("source_file", "/")), -2)
    full = stem_id(F.col("source_file"))
    norm = X.ascii_id(F.col("id"))
    new = F.lit(None).cast("string")
    for short in (X.ascii_id(base), X.ascii_id(F.concat_ws("_", parent, base))):
        fits = F.when(norm == short, full).when(norm.startswith(F.concat(short, F.lit("_"))), F.concat(full, F.substr(norm, F.length(short) + 1)))
        new = F.coalesce(F.when(short != full, fits), new)
    return n.select(F.col("id").alias("old"), new.alias("new")).where("new is not null and new <> old").distinct()


def ghosts(nodes: DataFrame) -> DataFrame:
    """``old, new``: the last unparsed node of a (file name, label) and its canonical twin.

    The twin is the only parsed node of the key, else the first by id that has a location. Keys with two parsed nodes, or
    with located unparsed ones from different files, are ambiguous.
    """
    name, label = X.basename(F.coalesce("source_file", F.lit(""))), F.trim(F.coalesce("label", F.lit("")))
    n = nodes.select("id", "source_file", name.alias("name"), label.alias("l"), (F.coalesce("_origin", F.lit("")) == "ast").alias("ast"), F.col("source_location").isNotNull().alias("located"))
    n = n.where("name <> '' and l <> ''")
    other = ~F.col("ast") & F.col("located")
    g = n.groupBy("name", "l").agg(
        F.count_if("ast").alias("n_ast"),
        F.min(F.when(F.col("ast"), F.col("id"))).alias("ast_id"),
        F.min(F.when(other, F.col("id"))).alias("other_id"),
        F.count_distinct(F.when(other, F.col("source_file"))).alias("files"),
    )
    # a parsed twin decides only over located ones that come later in the order of ids
    twin = g.where("n_ast < 2 and (files < 2 or n_ast = 1)").select("name", "l", F.coalesce("ast_id", "other_id").alias("new")).where("new is not null")
    c = n.where("not ast").join(twin, ["name", "l"]).where("id <> new")
    return c.groupBy("name", "l").agg(F.max("id").alias("old"), F.first("new").alias("new")).select("old", "new")


def without_ghosts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = ghosts(nodes)
    return nodes.join(m.select(F.col("old").alias("id")), "id", "left_anti"), remapped_ends(edges, m)


def split_collisions(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that several files share become path-qualified; modules and namespaces stay one.

    Where two paths give the same id after normalising, six digits of the path's digest keep them apart. An edge's
    ends follow its own file; imports go to the header, if one of the files is.
    """
    exempt = F.coalesce("type", F.lit("")).isin("module", "namespace")
    ids = nodes.where(~exempt & (F.coalesce("source_file", F.lit("")) != "")).select("id", "source_file").distinct()
    many = ids.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
    c = ids.join(many, "id").withColumn("naive", X.ascii_id(F.concat_ws("_", "source_file", "id")))
    same = c.groupBy("id", "naive").agg(F.count(F.lit(1)).alias("k"))
    c = c.join(same, ["id", "naive"])
    salted = F.concat_ws("_", "naive", F.substring(F.sha1("source_file"), 1, 6))
    m = c.select(F.col("id").alias("old"), "source_file", F.when(F.col("k") > 1, salted).otherwise(F.col("naive")).alias("new"))
    own = m.select(F.col("old").alias("id"), "source_file", "new")
    n = nodes.join(own, ["id", "source_file"], "left").withColumn("id", F.when(exempt, F.col("id")).otherwise(F.coalesce("new", "id"))).drop("new").select(nodes.columns)
    header = m.where(X.extension(F.col("source_file")).isin(*HEADERS)).groupBy("old").agg(F.min("new").alias("new"))
    imports = F.col("relation").isin("imports", "imports_from")
    h = header.select(F.col("old").alias("_o"), F.col("new").alias("_h"))
    e = edges.join(h, edges["dst"] == h["_o"], "left").withColumn("_h", F.when(imports, F.col("_h"))).drop("_o")
    e = remapped_ends(e.withColumn("_dst", F.col("dst")), m, own_file=True)
    return n, e.withColumn("dst", F.coalesce("_h", "dst")).drop("_h", "_dst").select(edges.columns)


def merge_declarations(nodes: DataFrame) -> DataFrame:
    """``old, new``: definitions that join the declaration in the one header of the same folder and stem, by label."""
    stem = F.regexp_replace("source_file", r"\.[^./]+$", "")
    n = nodes.where("source_file <> ''").select("id", "label", stem.alias("stem"), X.extension(F.col("source_file")).isin(*HEADERS).alias("header"))
    g = n.groupBy("label", "stem").agg(F.count_if("header").alias("h"), F.count_if(~F.col("header")).alias("d"), F.min(F.when(F.col("header"), F.col("id"))).alias("new"))
    return n.where("not header").join(g.where("h = 1 and d >= 1"), ["label", "stem"]).where("id <> new").select(F.col("id").alias("old"), "new")


def rewire_stubs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mapping): nodes without a file take the place of the only definition of their label.

    Types first, then types of caseless languages by folded label, then functions whose family the stub's edges share and
    that nobody uses as a supertype. Stubs that no edge needs any more go.
    """
    real = nodes.where("source_file is not null and source_file <> ''").withColumn("family", X.language_family(F.col("source_file")))
    types = real.where("label not like '%()' and label rlike '^[A-Za-z_][A-Za-z0-9_]*$'")
    funcs = real.where("label like '%()' and label not like '.%'").withColumn("label", F.regexp_replace("label", r"\(\)$", ""))

    def only(df: DataFrame, key: Column, *more: str) -> DataFrame:
        g = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), *(F.min(c).alias(c) for c in more))
        return g.where("n = 1").drop("n")

    exact = only(types, F.col("label")).select(F.col("k").alias("k1"), F.col("id").alias("t1"))
    fold = only(types.where(F.col("family").isin(*CASELESS)), F.lower("label")).select(F.col("k").alias("k2"), F.col("id").alias("t2"))
    func = only(funcs, F.col("label"), "family").select(F.col("k").alias("k3"), F.col("id").alias("t3"), F.col("family").alias("f3"))
    stubs = nodes.where("(source_file is null or source_file = '') and label <> ''").select(F.col("id").alias("old"), F.regexp_replace("label", r"\(\)$", "").alias("l"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("old"), X.language_family(F.col("source_file")).alias("f")).where("f is not null")
    fams = ends.groupBy("old").agg(F.collect_set("f").alias("fams"))
    supers = edges.where(F.col("relation").isin(*SUPERTYPES)).select(F.col("dst").alias("old")).distinct().withColumn("base", F.lit(True))
    j = stubs.join(exact, F.col("l") == F.col("k1"), "left").join(fold, F.lower("l") == F.col("k2"), "left").join(func, F.col("l") == F.col("k3"), "left")
    j = j.join(fams, "old", "left").join(supers, "old", "left")
    fits = F.col("base").isNull() & (F.col("fams").isNull() | F.col("f3").isNull() | F.array_contains("fams", F.col("f3")))
    m = j.select("old", F.coalesce("t1", "t2", F.when(fits, F.col("t3"))).alias("new")).where("new is not null and new <> old")
    e = remapped_ends(edges, m)
    return nodes.join(m.select(F.col("old").alias("id")), "id", "left_anti"), e, m


def phantom_edges_dropped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without those that bind a name across languages.

    An inferred call between files of different families goes (an unknown extension counts as different), an
    import or reference only where both families are known.
    """
    f = nodes.select("id", X.language_family(F.col("source_file")).alias("f"), X.extension(F.coalesce("source_file", F.lit(""))).alias("x"))
    e = edges.join(f.select(F.col("id").alias("src"), F.col("f").alias("f1"), F.col("x").alias("x1")), "src", "left")
    e = e.join(f.select(F.col("id").alias("dst"), F.col("f").alias("f2"), F.col("x").alias("x2")), "dst", "left")
    call = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & (F.col("x1") != "") & (F.col("x2") != "") & ~F.col("f1").eqNullSafe(F.col("f2"))
    other = F.col("relation").isin("imports", "imports_from", "references") & (F.col("f1") != F.col("f2"))
    return e.where(~F.coalesce(call, F.lit(False)) & ~F.coalesce(other, F.lit(False))).select(edges.columns)


def _places(path: Column) -> Column:
    """(rank, place) of a path, nearer ones ranked higher: the file, its folder, each start of its folders, anything (0)."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    starts = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda d: F.struct(d.alias("rank"), F.array_join(F.slice(folders, F.lit(1), d), "/").alias("place")))
    folder = F.struct(F.lit(FOLDER).alias("rank"), F.regexp_replace(path, "[^/]*$", "").alias("place"))
    file = F.struct(F.lit(FOLDER + 1).alias("rank"), path.alias("place"))
    anything = F.array(F.struct(F.lit(0).alias("rank"), F.lit("").alias("place")))
    return F.when(path.isNull(), anything).otherwise(F.concat(starts, F.array(folder, file)))


def nearest_among(callers: DataFrame, candidates: DataFrame) -> DataFrame:
    """One ``candidate`` for each ``call`` of (call, call_file, key) among (key, candidate, file), or none.

    Callers outside tests never bind to tests; test callers prefer tests, their own file's first. Then the same file, the same
    folder, the longest common start of the path: each only if a single candidate has it. A (call, call_file) has one key.
    A missing file is no test and shares nothing.

    Candidates are counted by key and place, and callers look their own places up, so pairs are never listed.
    """
    test = lambda c: F.coalesce(X.is_test_path(F.col(c)), F.lit(False))
    c = candidates.select("key", "candidate", "file").where("key is not null").distinct()
    c = c.select("key", "candidate", test("file").alias("t"), F.explode(_places(F.col("file"))).alias("p"))
    there = c.groupBy("key", "p.rank", "p.place").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("t").alias("n_test"), F.min(F.when(F.col("t"), F.col("candidate"))).alias("a_test"), F.min(F.when(~F.col("t"), F.col("candidate"))).alias("other")
    )
    at = callers.select("call", "call_file", "key").where("call is not null").distinct()
    at = at.select("call", "key", test("call_file").alias("o"), F.explode(_places(F.col("call_file"))).alias("p"))
    j = at.select("call", "key", "o", "p.rank", "p.place").join(there, ["key", "rank", "place"])
    j = j.groupBy("call", "rank", "o").agg(F.sum("n").alias("n"), F.sum("n_test").alias("n_test"), F.min("a_test").alias("a_test"), F.min("other").alias("other"))
    whole = F.when(F.col("rank") == 0, F.struct("o", "n", "n_test", "a_test", "other"))
    g = j.groupBy("call").agg(F.collect_list(F.struct("rank", "o", "n", "n_test", "a_test", "other")).alias("rows"), F.sum(whole["n"]).alias("n_all"), F.sum(whole["n_test"]).alias("tests"))
    j = g.select("call", "n_all", "tests", F.inline("rows"))
    every = (F.col("n_all") == 1) | (F.col("o") & (F.col("tests") == 0))
    k = F.when(every, F.col("n")).when(F.col("o"), F.col("n_test")).otherwise(F.col("n") - F.col("n_test"))
    name = F.when(every, F.coalesce("a_test", "other")).when(F.col("o"), F.col("a_test")).otherwise(F.col("other"))
    kept = j.select("call", "rank", k.alias("k"), name.alias("candidate")).where("k > 0").groupBy("call", "rank").agg(F.sum("k").alias("k"), F.min("candidate").alias("candidate"))
    one = kept.groupBy("call").agg(F.max(F.struct("rank", "k", "candidate")).alias("b"), F.sum(F.when(F.col("rank") == 0, F.col("k"))).alias("n"))
    return one.where("n = 1 or (b.k = 1 and b.rank > 0)").select("call", "b.candidate")


def nearest_candidates(calls: DataFrame) -> DataFrame:
    """``nearest_among`` for listed pairs (call, call_file, candidate, file)."""
    key = F.struct("call", "call_file").alias("key")
    return nearest_among(calls.select("call", "call_file", key), calls.select(key, "candidate", "file"))


def member_calls(calls: DataFrame, receiver_types: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, relation, confidence`` of calls on receivers whose type is known; one plan for every language.

    ``calls``: caller, receiver, callee, source_file. ``receiver_types``: source_file, receiver, type_name; an upper-case
    receiver is its own type. The type must have one class definition, and that class own one such method.
    """
    t = receiver_types.select("source_file", "receiver", "type_name")
    j = calls.join(t, ["source_file", "receiver"], "left")
    own = F.when(F.col("receiver").rlike("^[A-Z]"), F.col("receiver"))
    j = j.withColumn("type_name", F.coalesce("type_name", own)).where("type_name is not null")
    classes = nodes.where("label not like '%()' and source_file <> ''").groupBy(F.col("label").alias("type_name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("cls")).where("n = 1").drop("n")
    methods = edges.where("relation = 'method'").join(nodes.select(F.col("id").alias("dst"), X.callable_key(F.col("label")).alias("m")), "dst")
    methods = methods.groupBy(F.col("src").alias("cls"), "m").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).where("n = 1").drop("n")
    found = j.join(classes, "type_name").join(methods, "cls").where(F.lower("callee") == F.col("m")).where("caller <> dst")
    out = found.select(F.col("caller").alias("src"), "dst", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence")).distinct()
    return out.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def import_guided_calls(calls: DataFrame, imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls through an imported name: (caller, callee, source_file) with (source_file, alias, module, name).

    (module stem, name) must have one definition; the edge is EXTRACTED.
    """
    stem = F.regexp_replace(X.basename(F.col("source_file")), r"\.[^.]+$", "")
    index = nodes.select("id", stem.alias("module"), F.regexp_replace("label", r"\(\)$", "").alias("name"))
    index = index.groupBy("module", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst")).where("n = 1").drop("n")
    j = calls.join(imports.withColumnRenamed("alias", "callee"), ["source_file", "callee"]).withColumn("module", F.substring_index("module", ".", -1))
    return j.join(index, ["module", "name"]).select(F.col("caller").alias("src"), "dst", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence")).distinct()


def qualified_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, relation`` of imports (src, qualified) of names such as ``a.b.C``: the only definition C in a file b or folder a/b."""
    parts = F.split("qualified", r"[.:/\\]+")
    i = imports.select("src", F.element_at(parts, -1).alias("name"), F.get(parts, F.size(parts) - 2).alias("module"))
    stem = F.regexp_replace(X.basename(F.col("source_file")), r"\.[^.]+$", "")
    folder = F.element_at(F.concat(F.array(F.lit("")), F.split(F.regexp_replace("source_file", "/?[^/]*$", ""), "/")), -1)
    d = nodes.select("id", F.regexp_replace("label", r"^\.|\(\)$", "").alias("name"), F.explode(F.array_distinct(F.array(stem, folder))).alias("module"))
    index = d.groupBy("module", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1").drop("n")
    return i.join(index, ["module", "name"]).where("src <> dst").select("src", "dst", F.lit("imports").alias("relation")).distinct()


def symbol_external(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """``ref, target, place``: definitions (doc, symbol, id) for references (ref, doc, symbol): same document, else the only one, else external."""
    local = definitions.groupBy("doc", "symbol").agg(F.min("id").alias("l"))
    glob = definitions.groupBy("symbol").agg(F.count_distinct("id").alias("n"), F.min("id").alias("g")).where("n = 1").drop("n")
    j = refs.join(local, ["doc", "symbol"], "left").join(glob, "symbol", "left")
    place = F.when(F.col("l").isNotNull(), "local").when(F.col("g").isNotNull(), "global").otherwise("external")
    return j.select("ref", F.coalesce("l", "g", F.concat(F.lit("ext:"), "symbol")).alias("target"), place.alias("place"))


def community_lookup(nodes: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, label``: the community's label under each node's id and label; the smallest community id as text wins."""
    m = members.join(labels, "community", "left").withColumn("c", F.col("community").cast("string"))
    m = m.withColumn("name", F.coalesce("label", F.concat(F.lit("Community "), "c"))).select("id", "c", "name")
    k = m.select(F.col("id").alias("key"), "c", "name").unionByName(m.join(nodes.select("id", F.col("label").alias("key")), "id").select("key", "c", "name"))
    return k.where("key is not null").groupBy("key").agg(F.min(F.struct("c", "name")).alias("m")).select("key", F.col("m.name").alias("label"))
