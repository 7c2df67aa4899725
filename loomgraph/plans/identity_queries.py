"""Identity, build, section and manifest queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import build, history, resolution, sections
from loomgraph.plans.graph_queries import DEG, KG, kg, members
from loomgraph.plans.registry import query
from loomgraph.plans.text_queries import _COUP, _SCARS
from loomgraph.sources import manifests
from loomgraph.sources.star import read

# Parts as symbols: the same name in files of several brands; some parsed, some reported by a model.
_SYM = """sy AS (SELECT 'P' || p_partkey AS id, split_part(p_name, ' ', 1) AS label, 'b' || p_size || '/' || replace(p_brand, '#', '') || '.py' AS source_file,
  CASE WHEN p_partkey % 3 = 0 THEN 'ast' END AS origin, CASE WHEN p_partkey % 2 = 0 THEN 'L' || p_size END AS loc FROM part)"""


def symbols(spark, sf):
    (p,) = read(spark, sf, "part")
    return p.select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("label"),
        F.concat(F.lit("b"), "p_size", F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".py")).alias("source_file"),
        F.when(F.col("p_partkey") % 3 == 0, "ast").alias("_origin"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("L"), "p_size")).alias("source_location"),
    )


@query(f"""
WITH {_SYM}, n AS (SELECT *, regexp_extract(source_file, '[^/]*$') AS name, coalesce(origin, '') = 'ast' AS ast FROM sy WHERE label <> ''),
g AS (SELECT name, label, count(*) FILTER (ast) AS na, min(id) FILTER (ast) AS a, min(id) FILTER (NOT ast AND loc IS NOT NULL) AS o, count(DISTINCT source_file) FILTER (NOT ast AND loc IS NOT NULL) AS f FROM n GROUP BY 1, 2),
t AS (SELECT name, label, coalesce(a, o) AS new FROM g WHERE na < 2 AND (f < 2 OR na = 1) AND coalesce(a, o) IS NOT NULL)
SELECT max(id) AS old, any_value(new) AS new FROM n JOIN t USING (name, label) WHERE NOT ast AND id <> new GROUP BY name, label
""")
def ghost_merge(spark, sf):
    return resolution.ghosts(symbols(spark, sf))


@query("""
WITH s AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS id, 'b' || p_size || '/x.py' AS source_file FROM part), m AS (SELECT id FROM s GROUP BY id HAVING count(*) > 1)
SELECT CASE WHEN id IN (SELECT id FROM m) THEN trim(regexp_replace(lower(source_file || '_' || id), '[^a-z0-9]+', '_', 'g'), '_') ELSE id END AS id, source_file FROM s
""")
def colliding_ids(spark, sf):
    (p,) = read(spark, sf, "part")
    n = p.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("id"), F.concat(F.lit("b"), "p_size", F.lit("/x.py")).alias("source_file"), F.lit(None).cast("string").alias("type")).distinct()
    e = n.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("calls").alias("relation"), "source_file")
    return resolution.split_collisions(n, e)[0].select("id", "source_file")


@query("""
WITH c AS (SELECT regexp_replace(p_name, '[^A-Za-z]', '', 'g') || p_size AS label, min('P' || p_partkey) AS id, count(*) AS k FROM part GROUP BY 1)
SELECT 'stub_' || label AS old, id AS new FROM c WHERE k = 1
""")
def stub_rewire(spark, sf):
    (p,) = read(spark, sf, "part")
    label = F.concat(F.regexp_replace("p_name", "[^A-Za-z]", ""), "p_size")
    real = p.select(F.concat(F.lit("P"), "p_partkey").alias("id"), label.alias("label"), F.lit("a.py").alias("source_file"))
    stubs = real.select(F.concat(F.lit("stub_"), "label").alias("id"), "label", F.lit(None).cast("string").alias("source_file")).distinct()
    e = stubs.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("references").alias("relation"), F.lit("a.py").alias("source_file"))
    return resolution.rewire_stubs(real.unionByName(stubs), e)[2]


_FAM = """fam AS (SELECT id, CASE WHEN source_file LIKE '%.py' THEN 'python' END AS f FROM kg_nodes)"""


@query(f"""
WITH {_FAM} SELECT src, dst, relation, confidence FROM kg_edges LEFT JOIN fam a ON src = a.id LEFT JOIN fam b ON dst = b.id
WHERE NOT (relation = 'calls' AND confidence = 'INFERRED' AND a.f IS DISTINCT FROM b.f)
""", KG)
def phantom_edges(spark, sf):
    n, e = kg(spark, sf)
    return resolution.phantom_edges_dropped(n, e).select("src", "dst", "relation", "confidence")


@query("""
WITH c AS (SELECT DISTINCT s_suppkey AS call, 'b' || s_nationkey || '/Brand11.py' AS cf, 'P' || p_partkey AS cand, 'b' || p_size || '/' || replace(p_brand, '#', '') || '.py' AS f FROM supplier JOIN part ON p_partkey % 97 = s_suppkey % 97),
t AS (SELECT *, CASE WHEN f = cf THEN 0 WHEN split_part(f, '/', 1) = split_part(cf, '/', 1) THEN 1 ELSE 2 END AS tier, count(*) OVER (PARTITION BY call) AS n FROM c),
b AS (SELECT *, min(tier) OVER (PARTITION BY call) AS best FROM t)
SELECT call, min(cand) AS candidate FROM b WHERE tier = best GROUP BY call HAVING any_value(n) = 1 OR (count(*) = 1 AND any_value(best) < 2)
""")
def nearest_candidates(spark, sf):
    s, p = read(spark, sf, "supplier", "part")
    f = F.concat(F.lit("b"), "p_size", F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".py"))
    callers = s.select(F.col("s_suppkey").alias("call"), F.concat(F.lit("b"), "s_nationkey", F.lit("/Brand11.py")).alias("call_file"), (F.col("s_suppkey") % 97).alias("key"))
    return resolution.nearest_among(callers, p.select((F.col("p_partkey") % 97).alias("key"), F.concat(F.lit("P"), "p_partkey").alias("candidate"), f.alias("file")))


@query("""
WITH d AS (SELECT DISTINCT 'd' || p_size AS doc, p_brand AS symbol, 'd' || p_size || '#' || p_brand AS id FROM part WHERE p_retailprice > 1000),
r AS (SELECT 'r' || p_partkey AS ref, 'd' || p_size AS doc, CASE WHEN p_partkey % 50 = 0 THEN 'none' ELSE p_brand END AS symbol FROM part),
g AS (SELECT symbol, min(id) AS g FROM d GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT ref, coalesce(d.id, g, 'ext:' || r.symbol) AS target, CASE WHEN d.id IS NOT NULL THEN 'local' WHEN g IS NOT NULL THEN 'global' ELSE 'external' END AS place
FROM r LEFT JOIN d ON r.doc = d.doc AND r.symbol = d.symbol LEFT JOIN g ON r.symbol = g.symbol
""")
def symbol_index_resolve(spark, sf):
    (p,) = read(spark, sf, "part")
    doc = F.concat(F.lit("d"), "p_size").alias("doc")
    d = p.where("p_retailprice > 1000").select(doc, F.col("p_brand").alias("symbol")).distinct().withColumn("id", F.concat_ws("#", "doc", "symbol"))
    r = p.select(F.concat(F.lit("r"), "p_partkey").alias("ref"), doc, F.when(F.col("p_partkey") % 50 == 0, "none").otherwise(F.col("p_brand")).alias("symbol"))
    return resolution.symbol_external(r, d)


@query("""
WITH m AS (SELECT id, label, CAST(community AS VARCHAR) AS c, CASE WHEN community % 2 = 0 THEN 'even ' || community ELSE 'Community ' || community END AS name FROM kg_nodes),
k AS (SELECT id AS key, c, name FROM m UNION ALL SELECT label, c, name FROM m)
SELECT key, arg_min(name, (c, name)) AS label FROM k GROUP BY key
""", KG)
def community_lookup(spark, sf):
    n, _ = kg(spark, sf)
    m = members(n)
    labels = m.select("community").distinct().where("community % 2 = 0").withColumn("label", F.concat(F.lit("even "), "community"))
    return resolution.community_lookup(n, m, labels)


@query("""
WITH n AS (SELECT 'D' || doc_id AS id, text AS label, CASE WHEN doc_id % 5 = 0 THEN 'rationale' ELSE 'document' END AS ft FROM documents),
s AS (SELECT id, trim(label) AS t FROM n WHERE ft = 'rationale' AND (length(label) >= 80 OR len(regexp_extract_all(label, '[^\\x20\\x09-\\x0D]+')) >= 8) AND regexp_matches(label, '[.!?:]'))
SELECT n.id, s.t AS rationale FROM n LEFT JOIN s ON s.id = 'D' || (CAST(substr(n.id, 2) AS BIGINT) - 1) WHERE ft <> 'rationale'
""")
def fragment_cleanup(spark, sf):
    (d,) = read(spark, sf, "documents")
    n = d.select(F.concat(F.lit("D"), "doc_id").alias("id"), F.col("text").alias("label"), F.when(F.col("doc_id") % 5 == 0, "rationale").otherwise("document").alias("file_type"))
    e = d.where("doc_id % 5 = 0").select(F.concat(F.lit("D"), "doc_id").alias("src"), F.concat(F.lit("D"), F.col("doc_id") + 1).alias("dst"), F.lit("rationale_for").alias("relation"))
    return build.sanitised(n, e)[0].select("id", "rationale")


@query("SELECT src, dst, relation, confidence FROM kg_edges WHERE confidence = 'EXTRACTED' AND relation IN ('calls', 'uses', 'method', 'inherits', 'implements')", KG)
def preferred_edges(spark, sf):
    return sections.preferred(sections.drawable(kg(spark, sf)[1]))


ARCHETYPES = {"trade": ["order", "orders", "supply"], "people": ["customer", "crm"], "goods": ["parts", "green", "red"]}
_ARCH = ", ".join(f"('{w}', '{k}', {i})" for i, (k, ws) in enumerate(ARCHETYPES.items()) for w in ws)


@query(f"""
WITH a(tok, section, ord) AS (VALUES {_ARCH}), n AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS k FROM kg_nodes),
t AS (SELECT CAST(community AS BIGINT) AS community, unnest(regexp_extract_all(lower(label || ' ' || source_file), '[a-z0-9_]+')) AS tok FROM n WHERE k <= 80),
g AS (SELECT community, section, ord, count(*) AS hits FROM t JOIN a USING (tok) GROUP BY ALL HAVING count(*) >= 2)
SELECT community, section, hits FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY hits DESC, ord) AS r FROM g) x WHERE r = 1
""", KG)
def keyword_sections(spark, sf):
    n, _ = kg(spark, sf)
    # the first nodes of a community are the operator's own sample
    return sections.keyword_sections(n, members(n), ARCHETYPES)


@query(f"""
WITH {_COUP}, {_SCARS}, d AS (SELECT 'danger' AS kind, row_number() OVER (ORDER BY danger DESC, edits DESC, path) AS rank, path, CAST(danger AS VARCHAR) AS detail FROM scars WHERE danger > 0),
c AS (SELECT 'couple' AS kind, row_number() OVER (ORDER BY confidence DESC, support DESC, path, partner) AS rank, path, partner AS detail FROM couples WHERE path < partner)
SELECT * FROM d WHERE rank <= 5 UNION ALL SELECT * FROM c WHERE rank <= 5
""", ("basket",))
def scar_summary(spark, sf):
    (b,) = read(spark, sf, "basket")
    return sections.scar_summary(history.danger(b), history.cochange(b, min_confidence=0.05))


@query("""
WITH a AS (SELECT DISTINCT n_name || 'S' AS name FROM nation), b AS (SELECT DISTINCT n_name AS symbol FROM nation)
SELECT name, symbol, ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, symbol) AS k FROM
 (SELECT name, symbol, round(1 - levenshtein(lower(name), lower(symbol)) / greatest(length(name), length(symbol))::DOUBLE, 6) AS ratio FROM a, b WHERE name <> symbol
   AND len(list_intersect([substr(lower(name), i, 3) FOR i IN range(1, length(name) - 1)], [substr(lower(symbol), i, 3) FOR i IN range(1, length(symbol) - 1)])) > 0) t WHERE ratio >= 0.7) u WHERE k <= 3
""")
def nearest_symbols(spark, sf):
    (n,) = read(spark, sf, "nation")
    return sections.nearest_symbols(n.select(F.concat("n_name", F.lit("S")).alias("name")).distinct(), n.select(F.col("n_name").alias("name")))


@query(f"""
WITH {DEG} SELECT CAST((SELECT sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) FROM documents) * 100 // 75 AS BIGINT) AS corpus_tokens,
 CAST(sum(greatest(1, CAST(floor(length(label || ' ' || source_file) / 4) AS BIGINT))) AS BIGINT) AS subgraph_tokens,
 round(CAST((SELECT sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) FROM documents) * 100 // 75 AS BIGINT) / sum(greatest(1, CAST(floor(length(label || ' ' || source_file) / 4) AS BIGINT)))::DOUBLE, 1) AS ratio
FROM kg_nodes WHERE id = 'R:1' OR id IN (SELECT dst FROM kg_edges WHERE src = 'R:1')
""", KG)
def token_reduction(spark, sf):
    n, e = kg(spark, sf)
    words = read(spark, sf, "documents")[0].agg(F.sum(X.word_count(F.col("text")))).first()[0]
    return sections.token_reduction(n, e, words, spark.createDataFrame([("R:1",)], "id string"), 1)


@query("SELECT CAST(conv_id AS VARCHAR) AS doc, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id")
def conversation_documents(spark, sf):
    return manifests.conversations_documents(read(spark, sf, "conversations")[0])


@query()
def community_notes(spark, sf):
    n, e = kg(spark, sf)
    return sections.community_notes(n, e, members(n))


@query()
def build_graph(spark, sf):
    n = symbols(spark, sf).withColumn("file_type", F.lit("tool")).withColumn("ord", F.monotonically_increasing_id())
    (e,) = read(spark, sf, "kg_edges")
    e = e.where("src like 'P:%'").select(F.replace("src", F.lit(":"), F.lit("")).alias("src"), F.concat(F.lit("p"), F.regexp_extract("dst", "[0-9]+", 0)).alias("dst"), "relation", "confidence", F.lit(None).cast("string").alias("context"))
    return build.build(n, e)[1]
