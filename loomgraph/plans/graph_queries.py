"""Graph measures over the star-schema knowledge graph, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import analysis, community, components, graph, iterate, packing
from loomgraph.plans.registry import query
from loomgraph.sinks import export
from loomgraph.sources.star import read

KG = ("kg_edges", "kg_nodes")
DEG = """deg AS (SELECT id, CAST(coalesce(k, 0) AS BIGINT) AS degree FROM kg_nodes LEFT JOIN
  (SELECT i, count(*) AS k FROM (SELECT src AS i FROM kg_edges UNION ALL SELECT dst FROM kg_edges) t GROUP BY i) d ON i = id)"""
EC = """ec AS (SELECT e.*, CAST(a.community AS BIGINT) AS cs, CAST(b.community AS BIGINT) AS cd FROM kg_edges e JOIN kg_nodes a ON e.src = a.id JOIN kg_nodes b ON e.dst = b.id)"""
SYM = "sym AS (SELECT src AS a, dst AS b, relation FROM kg_edges UNION ALL SELECT dst, src, relation FROM kg_edges)"


def kg(spark, sf):
    edges, nodes = read(spark, sf, *KG)
    return nodes, edges


def members(nodes):
    return nodes.select("id", "community")


@query(f"""
WITH {DEG}
SELECT id, label, degree, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM (
  SELECT id, label, degree FROM deg JOIN kg_nodes USING (id)
  WHERE file_type <> 'x' AND NOT (label = regexp_extract(source_file, '[^/]*$') OR (starts_with(label, '.') AND ends_with(label, '()'))
        OR (ends_with(label, '()') AND degree <= 1))
    AND regexp_extract(source_file, '[^/]*$') LIKE '%.%'
    AND lower(label) NOT IN ({", ".join(f"'{b}'" for b in graph.BUILTIN_LABELS)})
  ORDER BY degree DESC, id LIMIT 10) t
""", KG)
def hub_nodes(spark, sf):
    return graph.hub_nodes(*kg(spark, sf))


@query("""
WITH s AS (SELECT count(*) AS n_edges, count(*) FILTER (confidence = 'EXTRACTED') AS n_extracted,
  count(*) FILTER (confidence = 'INFERRED') AS n_inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS n_ambiguous FROM kg_edges)
SELECT (SELECT count(*) FROM kg_nodes) AS n_nodes, *, CAST(round_even(n_extracted * 100 / n_edges, 0) AS BIGINT) AS pct_extracted,
  CAST(round_even(n_inferred * 100 / n_edges, 0) AS BIGINT) AS pct_inferred, CAST(round_even(n_ambiguous * 100 / n_edges, 0) AS BIGINT) AS pct_ambiguous FROM s
""", KG)
def graph_stats(spark, sf):
    return graph.graph_stats(*kg(spark, sf))


@query(f"WITH {DEG} SELECT degree, count(*) AS n FROM deg GROUP BY degree", KG)
def degree_histogram(spark, sf):
    return graph.degree_histogram(*kg(spark, sf))


@query(f"WITH {DEG} SELECT degree AS threshold FROM deg ORDER BY degree LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.99) AS BIGINT) FROM deg)", KG)
def hub_p99_threshold(spark, sf):
    return graph.degree_at(graph.degree(*kg(spark, sf)), 0.99)


@query("SELECT e.src, e.dst, relation, confidence, a.label AS src_label, a.source_file AS src_source_file, b.label AS dst_label, b.source_file AS dst_source_file FROM kg_edges e JOIN kg_nodes a ON e.src = a.id JOIN kg_nodes b ON e.dst = b.id", KG)
def edge_enrichment(spark, sf):
    n, e = kg(spark, sf)
    return graph.enriched_edges(n, e, "label", "source_file")


@query("SELECT e.* FROM kg_edges e WHERE src IN (SELECT id FROM kg_nodes WHERE id NOT LIKE '%7') AND dst IN (SELECT id FROM kg_nodes WHERE id NOT LIKE '%7')", KG)
def dangling_prune(spark, sf):
    n, e = kg(spark, sf)
    return graph.without_dangling(n.where("id not like '%7'"), e)


@query("""
SELECT community, n_nodes, coalesce(k, 0) AS n_edges, CASE WHEN n_nodes <= 1 THEN 1.0::DOUBLE ELSE round(coalesce(k, 0) / (n_nodes * (n_nodes - 1) / 2.0::DOUBLE), 6) END AS cohesion
FROM (SELECT CAST(community AS BIGINT) AS community, count(*) AS n_nodes FROM kg_nodes GROUP BY 1) s
LEFT JOIN (SELECT CAST(a.community AS BIGINT) AS community, count(DISTINCT least(src, dst) || ' ' || greatest(src, dst)) AS k
           FROM kg_edges JOIN kg_nodes a ON src = a.id JOIN kg_nodes b ON dst = b.id WHERE a.community = b.community GROUP BY 1) i USING (community)
""", KG)
def community_cohesion(spark, sf):
    n, e = kg(spark, sf)
    return community.cohesion(e, members(n))


@query(f"""
WITH {DEG}, r AS (SELECT CAST(community AS BIGINT) AS community, id, label, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS k FROM kg_nodes JOIN deg USING (id))
SELECT community, id, regexp_replace(label, '\\(\\)$', '') AS label FROM r WHERE k = 1
""", KG)
def community_hub_label(spark, sf):
    n, e = kg(spark, sf)
    return community.hub_labels(n.drop("community"), e, members(n))


@query("""
SELECT community, n_nodes, row_number() OVER (ORDER BY n_nodes DESC, low) - 1 AS new_id
FROM (SELECT CAST(community AS BIGINT) AS community, count(*) AS n_nodes, min(id) AS low FROM kg_nodes GROUP BY 1) t
""", KG)
def community_reindex(spark, sf):
    return community.reindexed(members(kg(spark, sf)[0]))


@query("SELECT CAST(community AS BIGINT) AS community, substr(sha256(string_agg(concat(id, chr(0)), '' ORDER BY id)), 1, 16) AS signature FROM kg_nodes GROUP BY 1", KG)
def community_signature(spark, sf):
    return community.signatures(members(kg(spark, sf)[0]))


@query(f"WITH {EC} SELECT least(cs, cd) AS src, greatest(cs, cd) AS dst, count(*) AS weight FROM ec WHERE cs <> cd GROUP BY 1, 2", KG)
def community_meta_graph(spark, sf):
    n, e = kg(spark, sf)
    return community.meta_graph(e, members(n))


@query("""
WITH h AS (SELECT o_orderkey AS h, unnest(['C:' || o_custkey, 'O:' || o_orderkey]) AS id FROM orders
           UNION ALL SELECT l_orderkey, 'P:' || l_partkey FROM lineitem),
g AS (SELECT h, array_to_string(list_sort(list(DISTINCT CAST(community AS INTEGER))), ',') AS communities, count(DISTINCT community) AS k FROM h JOIN kg_nodes USING (id) GROUP BY h)
SELECT 'H:' || h AS hyperedge, communities FROM g WHERE k >= 2
""", KG)
def community_hyperedges(spark, sf):
    n, _ = kg(spark, sf)
    o, li = read(spark, sf, "orders", "lineitem")
    m = o.select(F.concat(F.lit("H:"), "o_orderkey").alias("id"), F.explode(F.array(F.concat(F.lit("C:"), "o_custkey"), F.concat(F.lit("O:"), "o_orderkey"))).alias("m"))
    m = m.unionByName(li.select(F.concat(F.lit("H:"), "l_orderkey").alias("id"), F.concat(F.lit("P:"), "l_partkey").alias("m")))
    h = m.groupBy("id").agg(F.collect_set("m").alias("nodes"))
    return community.meta_hyperedges(h, members(n)).withColumn("communities", F.array_join("communities", ","))


@query(f"""
WITH {EC}, x AS (SELECT src AS id, cd AS o FROM ec WHERE cs <> cd UNION ALL SELECT dst, cs FROM ec WHERE cs <> cd)
SELECT id, count(DISTINCT o) AS reach FROM x GROUP BY id
""", KG)
def bridge_reach(spark, sf):
    n, e = kg(spark, sf)
    return community.bridge_reach(e, members(n))


@query("SELECT source_file, array_to_string(list_sort(list(DISTINCT CAST(community AS INTEGER))), ',') AS communities, count(*) AS n_nodes FROM kg_nodes GROUP BY source_file", KG)
def community_file_index(spark, sf):
    n, _ = kg(spark, sf)
    return community.community_index(n.drop("community"), members(n))


@query(f"""
WITH {EC}, r AS (SELECT least(cs, cd) AS ca, greatest(cs, cd) AS cb, src, dst, relation, confidence,
  row_number() OVER (PARTITION BY least(cs, cd), greatest(cs, cd) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 WHEN 'EXTRACTED' THEN 2 ELSE 3 END, src, dst, relation) AS k
  FROM ec WHERE cs <> cd)
SELECT ca, cb, src, dst, relation, confidence FROM r WHERE k = 1
""", KG)
def cross_community_surprise(spark, sf):
    n, e = kg(spark, sf)
    return community.cross_community_surprises(e, members(n))


_CAT = "CASE WHEN {0} LIKE '%.py' THEN 'code' WHEN {0} LIKE '%.pdf' THEN 'paper' ELSE 'doc' END"


@query(f"""
WITH {DEG}, n AS (SELECT kg_nodes.*, degree, {_CAT.format("source_file")} AS cat, split_part(source_file, '/', 1) AS top,
  (label = regexp_extract(source_file, '[^/]*$') OR (ends_with(label, '()') AND degree <= 1)) AS fnode FROM kg_nodes JOIN deg USING (id)),
j AS (SELECT e.src, e.dst, e.relation, e.confidence, a.cat AS ca, b.cat AS cb, a.top AS ta, b.top AS tb, a.community AS ka, b.community AS kb, a.degree AS da, b.degree AS db,
  (e.relation IN ('calls', 'uses') AND e.confidence = 'INFERRED' AND ((a.cat = 'code' AND b.cat = 'doc') OR (a.cat = 'doc' AND b.cat = 'code'))) AS void
  FROM kg_edges e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id
  WHERE a.source_file <> b.source_file AND e.relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND NOT a.fnode AND NOT b.fnode),
s AS (SELECT *, CASE WHEN void THEN 0 WHEN confidence = 'AMBIGUOUS' THEN 3 WHEN confidence = 'INFERRED' THEN 2 ELSE 1 END AS c,
  CASE WHEN NOT void AND ca <> cb THEN 2 ELSE 0 END AS k, CASE WHEN NOT void AND ta <> tb THEN 2 ELSE 0 END AS d, CASE WHEN NOT void AND ka <> kb THEN 1 ELSE 0 END AS m,
  CASE WHEN least(da, db) <= 2 AND greatest(da, db) >= 5 THEN 1 ELSE 0 END AS h FROM j)
SELECT src, dst, relation, CAST(c + k + d + m + h AS BIGINT) AS score,
  concat_ws('; ', CASE WHEN c > 1 THEN lower(confidence) || ' link' END, CASE WHEN k > 0 THEN 'crosses file kinds' END, CASE WHEN d > 0 THEN 'crosses directories' END,
            CASE WHEN m > 0 THEN 'crosses communities' END, CASE WHEN h > 0 THEN 'peripheral node meets hub' END) AS reasons FROM s
""", KG)
def surprise_score(spark, sf):
    return analysis.surprises(*kg(spark, sf))


@query("""
WITH c AS (SELECT id, confidence, count(*) AS n FROM (SELECT src AS id, confidence FROM kg_edges UNION ALL SELECT dst, confidence FROM kg_edges) t GROUP BY 1, 2)
SELECT id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, confidence) AS k FROM c) t WHERE k = 1
""", KG)
def confidence_mode(spark, sf):
    return analysis.confidence_mode(kg(spark, sf)[1])


def raw_edges(spark, sf):
    (li,) = read(spark, sf, "lineitem")
    src = F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(F.concat(F.lit("P:"), "l_partkey"))
    dst = F.concat(F.lit("S:"), F.when(F.col("l_linenumber") == 6, F.lit(0)).otherwise(F.col("l_suppkey")))
    return li.select(src.alias("src"), dst.alias("dst"), F.when(F.col("l_returnflag") == "R", "uses").otherwise("calls").alias("relation"), F.when(F.col("l_linestatus") == "O", "INFERRED").otherwise("EXTRACTED").alias("confidence"), F.concat(F.lit("l"), "l_linenumber").alias("context"))


_RAW = """raw AS (SELECT CASE WHEN l_linenumber = 7 THEN '' ELSE 'P:' || l_partkey END AS src, 'S:' || CASE WHEN l_linenumber = 6 THEN 0 ELSE l_suppkey END AS dst,
  CASE WHEN l_returnflag = 'R' THEN 'uses' ELSE 'calls' END AS relation, CASE WHEN l_linestatus = 'O' THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, 'l' || l_linenumber AS context FROM lineitem)"""


@query(f"""
WITH {_RAW}, f AS (SELECT raw.*, src = '' AS missing, src <> '' AND (src NOT IN (SELECT id FROM kg_nodes) OR dst NOT IN (SELECT id FROM kg_nodes)) AS dangling FROM raw),
v AS (SELECT * FROM f WHERE NOT missing AND NOT dangling)
SELECT (SELECT count(*) FROM f) AS n_raw, (SELECT count(*) FROM f WHERE missing) AS n_missing, (SELECT count(*) FROM f WHERE dangling) AS n_dangling,
  (SELECT count(*) FROM v WHERE src = dst) AS n_self_loops, (SELECT count(*) FROM v) AS n_valid,
  (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM v) t) AS n_directed_pairs,
  (SELECT count(*) FROM (SELECT src, dst FROM v GROUP BY 1, 2 HAVING count(DISTINCT relation) > 1) t) AS n_relation_variants,
  (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM v) t) AS n_undirected_pairs,
  (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT src, dst, relation, confidence FROM v) t) AS n_exact_duplicates,
  (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM v) t) AS n_collapsed
""", ("kg_nodes",))
def multigraph_diagnostics(spark, sf):
    return graph.multigraph_diagnostics(read(spark, sf, "kg_nodes")[0], raw_edges(spark, sf))


@query(f"""
WITH {_RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY relation DESC, confidence DESC, context DESC) AS k FROM raw)
SELECT src, dst, relation, confidence, context FROM r WHERE k = 1
""")
def edge_collapse(spark, sf):
    return graph.collapsed_edges(raw_edges(spark, sf), directed=True)


@query("SELECT user_id AS id, event_type AS label, CAST(value AS DOUBLE) AS value, event_id AS ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) t WHERE k = 1")
def dedupe_nodes_last(spark, sf):
    (ev,) = read(spark, sf, "events")
    rows = ev.select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), F.col("value").cast("double").alias("value"), F.col("event_id").alias("ord"))
    return graph.resolve_duplicates(rows, ["id"], "ord", "last").select("id", "label", "value", "ord")


@query("SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2, 3")
def dedupe_edges_first(spark, sf):
    (li,) = read(spark, sf, "lineitem")
    e = li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph.resolve_duplicates(e, ["src", "dst", "relation"], "ord", "first").select("src", "dst", "relation", "ord")


@query("""
WITH idx AS (SELECT lower(trim(p_name)) AS k, min('P:' || p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) <= 40 AND count(DISTINCT p_partkey) = 1),
n AS (SELECT lower(n_name) AS k, min('N:' || n_nationkey) AS id FROM nation GROUP BY 1 HAVING count(*) = 1)
SELECT upper(n_name) || ' ' AS ref, n.id AS resolved FROM nation LEFT JOIN n ON trim(lower(upper(n_name) || ' ')) = n.k
""")
def endpoint_alias_resolve(spark, sf):
    (nat,) = read(spark, sf, "nation")
    refs = nat.select(F.concat(F.upper("n_name"), F.lit(" ")).alias("ref"))
    targets = nat.select(F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return graph.endpoint_aliases(refs, targets, F.trim(F.lower("ref")), F.lower("label")).select("ref", "resolved")


def old_new(spark, sf):
    n, e = kg(spark, sf)
    (o,) = read(spark, sf, "orders")
    late = o.where("o_orderdate >= timestamp'1998-01-01 00:00:00'").select(F.concat(F.lit("O:"), "o_orderkey").alias("id"))
    old_n = n.join(late, "id", "left_anti")
    old_e = graph.without_dangling(old_n, e)
    return (old_n, old_e), (n.where("id not like 'C:%9'"), e.where("src not like 'C:%9'"))


_OLD = """late AS (SELECT 'O:' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
old_n AS (SELECT * FROM kg_nodes WHERE id NOT IN (SELECT id FROM late)),
old_e AS (SELECT * FROM kg_edges WHERE src NOT IN (SELECT id FROM late) AND dst NOT IN (SELECT id FROM late)),
new_n AS (SELECT * FROM kg_nodes WHERE id NOT LIKE 'C:%9'), new_e AS (SELECT * FROM kg_edges WHERE src NOT LIKE 'C:%9')"""


@query(f"""
WITH {_OLD}, oe AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, relation FROM old_e), ne AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, relation FROM new_e)
SELECT 'node' AS kind, 'added' AS change, id AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS relation FROM new_n WHERE id NOT IN (SELECT id FROM old_n)
UNION ALL SELECT 'node', 'removed', id, NULL, NULL FROM old_n WHERE id NOT IN (SELECT id FROM new_n)
UNION ALL SELECT 'edge', 'added', * FROM (SELECT * FROM ne EXCEPT SELECT * FROM oe) t
UNION ALL SELECT 'edge', 'removed', * FROM (SELECT * FROM oe EXCEPT SELECT * FROM ne) t
""", KG)
def graph_diff(spark, sf):
    (on, oe), (nn, ne) = old_new(spark, sf)
    return analysis.graph_diff(on, oe, nn, ne)


_FACTS = """{0} AS (SELECT source_file AS f, id AS fact FROM {1} UNION SELECT unnest([a.source_file, b.source_file]), src || '|' || relation || '|' || dst FROM {2} JOIN {1} a ON src = a.id JOIN {1} b ON dst = b.id)"""
_CHANGED = f"""{_OLD}, {_FACTS.format("fo", "old_n", "old_e")}, {_FACTS.format("fn", "new_n", "new_e")},
changed AS (SELECT DISTINCT f AS source_file FROM ((SELECT * FROM fo EXCEPT SELECT * FROM fn) UNION ALL (SELECT * FROM fn EXCEPT SELECT * FROM fo)) t)"""


@query(f"WITH {_CHANGED} SELECT source_file FROM changed", KG)
def changed_files(spark, sf):
    return analysis.changed_files(*old_new(spark, sf))


@query(f"""
WITH {_CHANGED}, p AS (SELECT DISTINCT source_file FROM kg_nodes WHERE source_file NOT LIKE 'parts/%')
SELECT coalesce(c.source_file, p.source_file) AS source_file, CASE WHEN c.source_file IS NULL THEN 'untouched' WHEN p.source_file IS NULL THEN 'outside' ELSE 'inside' END AS place,
  CASE WHEN (SELECT count(*) FROM changed) = 0 THEN 'NO_CHANGES' WHEN EXISTS (SELECT 1 FROM changed WHERE source_file NOT IN (SELECT source_file FROM p)) THEN 'DEVIATION' ELSE 'CLEAN' END AS verdict
FROM changed c FULL JOIN p ON c.source_file = p.source_file
""", KG)
def impact_check(spark, sf):
    changed = analysis.changed_files(*old_new(spark, sf))
    predicted = kg(spark, sf)[0].where("source_file not like 'parts/%'").select("source_file")
    return analysis.contract_check(changed, predicted)


_IMPACT = "back AS (SELECT dst AS a, src AS b, relation FROM kg_edges WHERE relation IN ('calls', 'uses', 'imports_from', 'references'))"


@query(f"""
WITH {_IMPACT}, d1 AS (SELECT b AS id, min(relation || ' ' || a) AS r FROM back WHERE a = 'S:1' AND b <> 'S:1' GROUP BY 1),
d2 AS (SELECT b AS id, min(relation || ' ' || a) AS r FROM back JOIN d1 ON a = d1.id WHERE b NOT IN (SELECT id FROM d1) AND b <> 'S:1' GROUP BY 1)
SELECT id, 1::BIGINT AS depth, split_part(r, ' ', 1) AS relation FROM d1 UNION ALL SELECT id, 2, split_part(r, ' ', 1) FROM d2
""", KG)
def reverse_impact_d2(spark, sf):
    return iterate.reverse_impact(kg(spark, sf)[1], "S:1", 2)


def _walk2(seed, k):
    return f"""a{k} AS (SELECT DISTINCT b AS id FROM back WHERE a = '{seed}' AND b <> '{seed}'),
b{k} AS (SELECT DISTINCT b AS id FROM back JOIN a{k} ON a = a{k}.id WHERE b NOT IN (SELECT id FROM a{k}) AND b <> '{seed}')"""


@query(f"""
WITH {_IMPACT}, {_walk2("S:1", 0)}, {_walk2("S:2", 1)},
u AS (SELECT id, 0 AS k, 'S:1' AS target, 1 AS depth FROM a0 UNION ALL SELECT id, 0, 'S:1', 2 FROM b0 UNION ALL SELECT id, 1, 'S:2', 1 FROM a1 UNION ALL SELECT id, 1, 'S:2', 2 FROM b1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, depth) AS x FROM u)
SELECT id, target, CAST(depth AS BIGINT) AS depth, source_file FROM r JOIN kg_nodes USING (id) WHERE x = 1 AND id NOT IN ('S:1', 'S:2')
""", KG)
def impact_predict_multi(spark, sf):
    n, e = kg(spark, sf)
    return iterate.impact_prediction(n, e, ["S:1", "S:2"], 2)


@query(f"""
WITH {DEG}, {SYM}, lim AS (SELECT greatest(50, (SELECT degree FROM deg ORDER BY degree LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.99) AS BIGINT) FROM deg))) AS t),
open_ AS (SELECT id FROM deg, lim WHERE degree < t),
l1 AS (SELECT DISTINCT b AS id FROM sym WHERE a = 'N:3' AND b <> 'N:3'),
l2 AS (SELECT DISTINCT b AS id FROM sym WHERE a IN (SELECT id FROM l1 INTERSECT SELECT id FROM open_) AND b NOT IN (SELECT id FROM l1) AND b <> 'N:3'),
l3 AS (SELECT DISTINCT b AS id FROM sym WHERE a IN (SELECT id FROM l2 INTERSECT SELECT id FROM open_) AND b NOT IN (SELECT id FROM l1 UNION SELECT id FROM l2) AND b <> 'N:3')
SELECT 'N:3' AS id, 0::BIGINT AS depth UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3
""", KG)
def bfs_hub_blocked(spark, sf):
    n, e = kg(spark, sf)
    return iterate.bfs(n, e, spark.createDataFrame([("N:3",)], "id string"), 3)


PAIRS = [("R:0", "O:1"), ("C:1", "S:1"), ("N:3", "R:1"), ("C:5", "C:5"), ("R:2", "no such node"), ("P:1", "N:4")]


@query(f"""
WITH {SYM}, pairs(src, dst) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PAIRS)}),
w AS (SELECT DISTINCT src AS o, src AS id, 0 AS d FROM pairs UNION SELECT o, b, d + 1 FROM w JOIN sym ON a = w.id WHERE d < 4)
SELECT pairs.src, pairs.dst, CAST(min(d) AS BIGINT) AS hops FROM pairs JOIN w ON w.o = pairs.src AND w.id = pairs.dst GROUP BY 1, 2
""", KG)
def shortest_path_len(spark, sf):
    return iterate.shortest_paths(kg(spark, sf)[1], spark.createDataFrame(PAIRS, "src string, dst string"), 4)


@query(f"""
WITH {DEG}, {SYM} SELECT id, degree FROM deg WHERE id IN (SELECT b FROM sym WHERE a = 'S:1' INTERSECT SELECT b FROM sym WHERE a = 'S:2') AND id NOT IN ('S:1', 'S:2')
""", KG)
def common_neighbors(spark, sf):
    n, e = kg(spark, sf)
    return graph.common_neighbours(n, e, "S:1", "S:2")


@query(f"WITH {DEG}, x AS (SELECT dst AS id, relation, 'out' AS direction FROM kg_edges WHERE src = 'P:1' UNION SELECT src, relation, 'in' FROM kg_edges WHERE dst = 'P:1') SELECT id, relation, direction, degree FROM x JOIN deg USING (id) ORDER BY degree DESC, id, relation, direction LIMIT 12", KG)
def neighbor_listing(spark, sf):
    n, e = kg(spark, sf)
    return graph.ranked_neighbours(n, e, "P:1")


@query("""
WITH e AS (SELECT src AS a, dst AS b FROM kg_edges WHERE relation IN ('contains', 'references')),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT a AS id, a AS r FROM s UNION SELECT s.b, w.r FROM w JOIN s ON s.a = w.id)
SELECT id AS node, min(r) AS component FROM w GROUP BY id
""", KG)
def connected_components(spark, sf):
    e = kg(spark, sf)[1].where("relation in ('contains', 'references')")
    return components.connected_components(e)


@query("""
WITH c2 AS (SELECT a.src_n AS a, a.dst_n AS b FROM trade a JOIN trade z ON z.src_n = a.dst_n AND z.dst_n = a.src_n WHERE a.src_n < a.dst_n),
p3 AS (SELECT a.src_n AS s, a.dst_n AS x, b.dst_n AS y FROM trade a JOIN trade b ON b.src_n = a.dst_n WHERE a.src_n < a.dst_n AND b.dst_n > a.src_n AND b.dst_n <> a.dst_n),
p4 AS (SELECT p3.*, t.dst_n AS z FROM p3 JOIN trade t ON t.src_n = y WHERE t.dst_n > s AND t.dst_n NOT IN (x, y)),
p5 AS (SELECT p4.*, t.dst_n AS u FROM p4 JOIN trade t ON t.src_n = z WHERE t.dst_n > s AND t.dst_n NOT IN (x, y, z)),
al AS (SELECT 2 AS length, concat_ws('>', a, b) AS cycle FROM c2
 UNION ALL SELECT 3, concat_ws('>', s, x, y) FROM p3 JOIN trade t ON t.src_n = y AND t.dst_n = s
 UNION ALL SELECT 4, concat_ws('>', s, x, y, z) FROM p4 JOIN trade t ON t.src_n = z AND t.dst_n = s
 UNION ALL SELECT 5, concat_ws('>', s, x, y, z, u) FROM p5 JOIN trade t ON t.src_n = u AND t.dst_n = s)
SELECT CAST(length AS BIGINT) AS length, cycle FROM al
""", ("trade",))
def trade_cycles(spark, sf):
    (t,) = read(spark, sf, "trade")
    return iterate.bounded_cycles(t.select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")), 5, None)


_DEPS = "deps AS (SELECT DISTINCT a.source_file AS src, b.source_file AS dst FROM kg_edges JOIN kg_nodes a ON src = a.id JOIN kg_nodes b ON dst = b.id WHERE relation = 'imports_from' AND a.source_file <> b.source_file)"


@query(f"WITH {_DEPS} SELECT src, dst FROM deps", KG)
def file_dependencies(spark, sf):
    return iterate.file_dependencies(*kg(spark, sf))


@query(f"""
WITH {_DEPS}, s(f) AS (VALUES ('parts/Brand#11.py'), ('parts/Brand#12.py')), d1 AS (SELECT DISTINCT dst AS f FROM deps WHERE src IN (SELECT f FROM s) AND dst NOT IN (SELECT f FROM s)),
d2 AS (SELECT DISTINCT dst AS f FROM deps WHERE src IN (SELECT f FROM d1) AND dst NOT IN (SELECT f FROM s UNION SELECT f FROM d1))
SELECT f AS id, 0::BIGINT AS depth FROM s UNION ALL SELECT f, 1 FROM d1 UNION ALL SELECT f, 2 FROM d2
""", KG)
def dep_closure(spark, sf):
    deps = iterate.file_dependencies(*kg(spark, sf))
    return iterate.import_closure(deps, spark.createDataFrame([("parts/Brand#11.py",), ("parts/Brand#12.py",)], "id string"), 2)


@query(f"WITH {_DEPS} SELECT DISTINCT src AS id FROM deps WHERE src LIKE '%5.py' AND dst = 'supply/n3.py'", KG)
def tests_for_closure(spark, sf):
    deps = iterate.file_dependencies(*kg(spark, sf))
    return iterate.tests_for(deps, spark.createDataFrame([("supply/n3.py",)], "id string"), lambda c: c.endswith("5.py"))


@query("""
SELECT id, CASE WHEN file_type IN ('rationale', 'concept') THEN 'concept' WHEN starts_with(label, '.') AND ends_with(label, '()') THEN 'method' WHEN ends_with(label, '()') THEN 'function'
  WHEN label = regexp_extract(source_file, '[^/]*$') THEN 'file' WHEN file_type IN ('document', 'paper', 'image') THEN file_type WHEN regexp_matches(label, '^[A-Z][A-Za-z0-9]*$') THEN 'class' ELSE 'symbol' END AS kind FROM kg_nodes
""", KG)
def node_kind(spark, sf):
    n, _ = kg(spark, sf)
    return n.select("id", X.node_kind(F.col("label"), F.col("file_type"), F.col("source_file")).alias("kind"))


_USE = """round(CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END + CASE confidence WHEN 'EXTRACTED' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN relation IN ('calls', 'uses', 'method') THEN 1.0::DOUBLE WHEN relation IN ('imports', 'imports_from') THEN 0.6::DOUBLE WHEN relation = 'contains' THEN -0.2::DOUBLE WHEN relation = 'rationale_for' THEN -0.6::DOUBLE ELSE 0.0::DOUBLE END, 6)"""


@query(f"SELECT src, dst, {_USE} AS usefulness FROM kg_edges", KG)
def edge_usefulness(spark, sf):
    e = kg(spark, sf)[1]
    return e.select("src", "dst", analysis.edge_usefulness(F.col("relation"), F.col("confidence")).alias("usefulness"))


@query(f"WITH s AS (SELECT src, dst, {_USE} AS u FROM kg_edges) SELECT id, round(sum(u), 4) AS score FROM (SELECT src AS id, u FROM s UNION ALL SELECT dst, u FROM s) t GROUP BY id", KG)
def edge_score_sum(spark, sf):
    return analysis.edge_score_sum(kg(spark, sf)[1])


@query("""
WITH g AS (SELECT split_part(a.source_file, '/', 1) AS s, split_part(b.source_file, '/', 1) AS d, relation, count(*) AS k FROM kg_edges JOIN kg_nodes a ON src = a.id JOIN kg_nodes b ON dst = b.id GROUP BY 1, 2, 3)
SELECT s AS src_section, d AS dst_section, CAST(sum(k) AS BIGINT) AS n, (arg_min(relation, (-k, relation))) AS top_relation FROM g WHERE s <> d GROUP BY 1, 2
""", KG)
def section_edges(spark, sf):
    return analysis.section_edges(*kg(spark, sf))


@query(f"WITH {DEG}, m AS (SELECT greatest(1, max(degree)) AS t FROM deg) SELECT id, round(10 + 30 * degree / t::DOUBLE, 1) AS size, degree >= 0.15 * t AS show_label FROM deg, m", KG)
def display_payload(spark, sf):
    return export.display_nodes(*kg(spark, sf))


@query("""
SELECT 'MERGE (n:' || upper(file_type[1]) || file_type[2:] || ' {id: ''' || id || '''}) SET n.label = ''' || replace(label, '''', '\\''') || ''';' AS statement FROM kg_nodes
UNION ALL SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) MERGE (a)-[:' || upper(relation) || ' {confidence: ''' || confidence || '''}]->(b);' FROM kg_edges
""", KG)
def cypher_script(spark, sf):
    return export.cypher(*kg(spark, sf))


@query("""
WITH p AS (SELECT trim(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+', '/', 'g'), '/') AS path FROM pages),
c AS (SELECT path, count(*) AS n FROM p WHERE path <> '' GROUP BY path),
x AS (SELECT n, string_split(path, '/') AS parts FROM c), y AS (SELECT n, parts, unnest(range(1, len(parts) + 1)) AS depth FROM x)
SELECT array_to_string(parts[1:depth], '/') AS prefix, CAST(depth AS BIGINT) AS depth, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY 1, 2
""")
def path_rollup(spark, sf):
    (pages,) = read(spark, sf, "pages")
    p = pages.select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"))
    p = p.select(F.trim(F.regexp_replace("path", "/+", "/"), F.lit("/")).alias("path")).where("path <> ''")
    return export.path_rollup(p.groupBy("path").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT 'node' AS row_kind, id AS row_id, 'bad file_type' AS error FROM kg_nodes WHERE FALSE UNION ALL SELECT 'edge', src || '->' || dst, 'unknown source' FROM kg_edges WHERE src LIKE '%7' UNION ALL SELECT 'edge', src || '->' || dst, 'unknown target' FROM kg_edges WHERE dst LIKE '%7'", KG)
def schema_validation(spark, sf):
    n, e = kg(spark, sf)
    return graph.validation_report(n.where("id not like '%7'"), e)


@query("""
WITH f AS (SELECT source_file, regexp_extract(source_file, '[^/]*$') AS b, community FROM kg_nodes),
pr AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS number, 'repo/supply/n' || s_nationkey || '.py' AS path FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
hit AS (SELECT DISTINCT number, source_file FROM pr JOIN (SELECT DISTINCT source_file FROM f) t ON path = source_file OR ends_with(path, '/' || source_file))
SELECT number, count(*) AS n_nodes, count(DISTINCT community) AS n_communities, array_to_string(list_sort(list(DISTINCT CAST(community AS INTEGER))), ',') AS communities FROM hit JOIN f USING (source_file) GROUP BY number
""", ("kg_nodes",))
def pr_impact(spark, sf):
    return packing.pr_impact(_prs(spark, sf), *_nm(spark, sf))


def _nm(spark, sf):
    (n,) = read(spark, sf, "kg_nodes")
    return n, members(n)


def _prs(spark, sf):
    li, s = read(spark, sf, "lineitem", "supplier")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.col("l_orderkey").cast("long").alias("number"), F.concat(F.lit("repo/supply/n"), "s_nationkey", F.lit(".py")).alias("path")).distinct()


@query("""
WITH pr AS (SELECT DISTINCT l_orderkey AS number, 'supply/n' || s_nationkey || '.py' AS path FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT CAST(community AS VARCHAR) AS community, count(DISTINCT number) AS n_prs FROM pr JOIN kg_nodes ON path = source_file GROUP BY 1 HAVING count(DISTINCT number) > 1
""", ("kg_nodes",))
def pr_conflicts(spark, sf):
    return packing.pr_conflicts(packing.pr_impact(_prs(spark, sf), *_nm(spark, sf)))


@query()
def community_detection(spark, sf):
    n, e = kg(spark, sf)
    return community.cluster(n, e)


@query()
def betweenness_sampled(spark, sf):
    n, e = kg(spark, sf)
    return iterate.betweenness(n, e)


@query()
def suggested_questions(spark, sf):
    n, e = kg(spark, sf)
    return analysis.suggested_questions(n.drop("community"), e, members(n))


@query()
def community_articles(spark, sf):
    n, e = kg(spark, sf)
    return export.community_articles(n, e, members(n))


@query()
def depth_first_order(spark, sf):
    n, e = kg(spark, sf)
    order = iterate.depth_first(n, e, "R:0", 2)
    return spark.createDataFrame(list(enumerate(order)), "pos long, id string")
