"""Search, entity, history, verification, incremental and ingestion queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import analysis, entities, history, incremental, packing, search, verification
from loomgraph.operators.graph import without_dangling
from loomgraph.plans.graph_queries import DEG, KG, kg, old_new
from loomgraph.plans.registry import query
from loomgraph.sources import extract
from loomgraph.sources.star import BASKET, read
from loomgraph.streaming import changes

TERMS = ["forest", "green", "order"]
_TERMS = ", ".join(f"('{t}')" for t in TERMS)
_IDF = f"""idf AS (SELECT term, df, round(ln(1 + n / (1 + df)::DOUBLE), 9) AS idf FROM (SELECT term, count(*) FILTER (contains(lower(label), term)) AS df, count(*) AS n FROM kg_nodes, (VALUES {_TERMS}) t(term) GROUP BY term) x)"""
_SCORE = f"""m AS (SELECT id, label, lower(label) AS l, lower(source_file) AS f, sum(CASE WHEN contains(lower(label), term) THEN 1 ELSE 0 END) AS k FROM kg_nodes, (VALUES {_TERMS}) t(term) GROUP BY ALL),
s AS (SELECT id, label, round(CASE WHEN l = '{" ".join(TERMS)}' THEN 10000.0::DOUBLE * (SELECT max(idf) FROM idf) WHEN starts_with(l, '{" ".join(TERMS)}') THEN 1000.0::DOUBLE * (SELECT max(idf) FROM idf) ELSE 0.0::DOUBLE END
  + sum(CASE WHEN l = term THEN 1000.0::DOUBLE * idf * power(k / {len(TERMS)}.0::DOUBLE, 2) WHEN starts_with(l, term) THEN 100.0::DOUBLE * idf * power(k / {len(TERMS)}.0::DOUBLE, 2) WHEN contains(l, term) THEN 1.0::DOUBLE * idf ELSE 0.0::DOUBLE END
  + CASE WHEN contains(f, term) THEN 0.5::DOUBLE * idf ELSE 0.0::DOUBLE END), 4) AS score FROM m, idf GROUP BY id, label, l, f)"""


@query(f"WITH {_IDF} SELECT * FROM idf", KG)
def term_idf(spark, sf):
    return search.idf(kg(spark, sf)[0], TERMS)


@query(f"WITH {_IDF}, {_SCORE} SELECT id, label, score FROM s WHERE score > 0", KG)
def node_score(spark, sf):
    return search.node_scores(kg(spark, sf)[0], TERMS)


@query("SELECT id, tier FROM (SELECT id, CASE WHEN lower(source_file) = 'order' THEN 0::BIGINT WHEN lower(label) = 'order' THEN 1 WHEN starts_with(lower(label), 'order') THEN 2 WHEN contains(lower(label), 'order') THEN 3 END AS tier FROM kg_nodes) t WHERE tier IS NOT NULL", KG)
def find_node_tiers(spark, sf):
    return search.find_nodes(kg(spark, sf)[0], "order")


@query("""
WITH h AS (SELECT id, unnest([CASE WHEN id = 'order 17' THEN 0 END, CASE WHEN lower(label) = 'order 17' THEN 1 END, CASE WHEN regexp_replace(lower(label), '\\(\\)$', '') = 'order 17' THEN 2 END,
  CASE WHEN lower(source_file) = 'order 17' THEN 3 END, CASE WHEN contains(lower(label), 'order 17') THEN 4 END]) AS tier FROM kg_nodes)
SELECT min(id) AS id, CAST(tier AS BIGINT) AS tier FROM h WHERE tier IS NOT NULL GROUP BY tier HAVING count(*) = 1 ORDER BY tier LIMIT 1
""", KG)
def seed_resolve(spark, sf):
    return search.resolve_seed(kg(spark, sf)[0], "order 17")


@query("SELECT id FROM kg_nodes WHERE contains(lower(label), 'ord') AND contains(lower(label), 'rde') AND contains(lower(label), 'der') AND contains(lower(label), 'er ') AND contains(lower(label), 'r 1')", KG)
def trigram_candidates(spark, sf):
    return search.trigram_candidates(kg(spark, sf)[0], "order 1")


@query(f"""
WITH {DEG}, {_IDF}, {_SCORE}, top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, length(label), id) AS k FROM s WHERE score > 0 ORDER BY k LIMIT 3),
h AS (SELECT id FROM top WHERE k = 1 OR score >= 0.8 * (SELECT max(score) FROM top)),
p AS (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN lower(label) = term THEN 0 WHEN starts_with(lower(label), term) THEN 1 ELSE 2 END, degree DESC, id) AS k
      FROM kg_nodes JOIN deg USING (id), (VALUES {_TERMS}) t(term) WHERE contains(lower(label), term))
SELECT id FROM h UNION SELECT id FROM p WHERE k = 1
""", KG)
def query_seeds(spark, sf):
    n, e = kg(spark, sf)
    return search.query_seeds(n, e, TERMS)


@query("SELECT src, dst, relation, confidence, CASE relation WHEN 'calls' THEN 'call' WHEN 'imports_from' THEN 'import' ELSE relation END AS context FROM kg_edges WHERE relation IN ('calls', 'imports_from')", KG)
def context_filtered_edges(spark, sf):
    e = kg(spark, sf)[1].withColumn("context", F.when(F.col("relation") == "calls", "call").when(F.col("relation") == "imports_from", "import").otherwise(F.col("relation")))
    return search.context_filter(e, ["calls", "imports"])


@query("""
WITH l AS (SELECT DISTINCT p_name AS label FROM part UNION SELECT c_name FROM customer), c AS (SELECT label, unnest(string_split(label, '')) AS ch FROM l),
g AS (SELECT label, count(*) / any_value(length(label))::DOUBLE AS p FROM c GROUP BY label, ch)
SELECT label, round(-sum(p * log2(p)), 6) AS entropy FROM g GROUP BY label
""")
def label_entropy(spark, sf):
    p, c = read(spark, sf, "part", "customer")
    labels = p.select(F.col("p_name").alias("label")).union(c.select("c_name")).distinct()
    return labels.select("label", F.round(X.entropy(F.col("label")), 6).alias("entropy"))


_GRAMS = "g AS (SELECT DISTINCT p_name AS label, unnest([substr(lower(p_name), i, 3) FOR i IN range(1, length(p_name) - 1)]) AS t FROM part)"
_JAC = f"""{_GRAMS}, n AS (SELECT label, count(*) AS n FROM g GROUP BY 1),
j AS (SELECT a.label AS a, b.label AS b, count(*) AS k FROM g a JOIN g b USING (t) WHERE a.label < b.label GROUP BY 1, 2),
jac AS (SELECT a, b, round(k / (x.n + y.n - k)::DOUBLE, 6) AS jaccard FROM j JOIN n x ON a = x.label JOIN n y ON b = y.label)"""


@query(f"WITH {_JAC} SELECT a, b, jaccard FROM jac WHERE jaccard >= 0.4")
def shingle_jaccard_pairs(spark, sf):
    (p,) = read(spark, sf, "part")
    return entities.shingle_pairs(p.select(F.col("p_name").alias("label")).distinct(), 0.4)


@query(f"WITH {_JAC} SELECT a, b, round(jaro_winkler_similarity(a, b), 4) AS score FROM jac WHERE jaccard >= 0.3 AND round(jaro_winkler_similarity(a, b), 4) >= 0.85")
def fuzzy_pairs(spark, sf):
    (p,) = read(spark, sf, "part")
    return entities.fuzzy_pairs(p.select(F.col("p_name").alias("label")).distinct())


_PN = "pn AS (SELECT 'P:' || p_partkey AS id, p_name AS label, 'parts/' || p_brand || '.py' AS source_file FROM part)"
_MERGE = f"""{_PN}, k AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS k FROM pn),
map AS (SELECT id, first_value(id) OVER (PARTITION BY k, source_file ORDER BY length(id), id) AS winner FROM k WHERE k <> '')"""


def part_nodes(spark, sf):
    (p,) = read(spark, sf, "part")
    return p.select(F.concat(F.lit("P:"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.concat(F.lit("parts/"), "p_brand", F.lit(".py")).alias("source_file"))


@query(f"WITH {_MERGE} SELECT id, winner FROM map QUALIFY count(*) OVER (PARTITION BY winner) > 1")
def exact_label_merge(spark, sf):
    return entities.winners(entities.exact_label_groups(part_nodes(spark, sf)))


@query(f"""
WITH {_MERGE}, m AS (SELECT id, winner FROM map)
SELECT DISTINCT coalesce(a.winner, src) AS src, coalesce(b.winner, dst) AS dst, relation, confidence FROM kg_edges LEFT JOIN m a ON src = a.id LEFT JOIN m b ON dst = b.id
WHERE src = dst OR coalesce(a.winner, src) <> coalesce(b.winner, dst)
""", ("kg_edges",))
def entity_dedup_rewire(spark, sf):
    mapping = entities.winners(entities.exact_label_groups(part_nodes(spark, sf)))
    return entities.rewire(read(spark, sf, "kg_edges")[0], mapping)


@query()
def entity_dedup(spark, sf):
    """Customers and parts as documents: exact and guarded fuzzy merges."""
    n = part_nodes(spark, sf).withColumn("file_type", F.lit("document"))
    return entities.deduplicated(n, read(spark, sf, "kg_edges")[0])[2]


_COUP = """e AS (SELECT path, count(*) AS edits FROM basket GROUP BY path), z AS (SELECT commit_id FROM basket GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
f AS (SELECT DISTINCT commit_id, path FROM basket WHERE commit_id IN (SELECT commit_id FROM z)),
p AS (SELECT a.path AS path, b.path AS partner, count(*) AS support FROM f a JOIN f b USING (commit_id) WHERE a.path <> b.path GROUP BY 1, 2 HAVING count(*) >= 3),
couples AS (SELECT path, partner, support, round(support / edits::DOUBLE, 6) AS confidence FROM p JOIN e USING (path) WHERE round(support / edits::DOUBLE, 6) >= 0.05)"""


@query(f"WITH {_COUP} SELECT path, partner, support, confidence FROM couples", ("basket",))
def cochange_pairs(spark, sf):
    return history.cochange(read(spark, sf, "basket")[0], min_confidence=0.05)


@query(f"WITH {_COUP} SELECT *, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, support DESC, partner) AS rank FROM couples QUALIFY rank <= 8", ("basket",))
def cochange_partners(spark, sf):
    return history.partners(history.cochange(read(spark, sf, "basket")[0], min_confidence=0.05))


_SCARS = """scars AS (SELECT path, count(*) AS edits, count(*) FILTER (starts_with(subject, 'fix')) AS fix_edits, count(*) FILTER (starts_with(subject, 'Revert')) AS revert_edits,
 CASE WHEN count(*) >= 3 THEN round(least(1.0::DOUBLE, (count(*) FILTER (starts_with(subject, 'fix')) + 2 * count(*) FILTER (starts_with(subject, 'Revert'))) / count(*)::DOUBLE), 3) ELSE 0.0::DOUBLE END AS danger FROM basket GROUP BY path)"""


@query(f"WITH {_SCARS} SELECT * FROM scars", ("basket",))
def danger_score(spark, sf):
    return history.danger(read(spark, sf, "basket")[0])


@query(f"""
WITH {_COUP}, {_SCARS}, plan(path) AS (VALUES ('supply/s1.py'), ('supply/s2.py'), ('supply/s3.py'))
SELECT path, 'danger' AS kind, CAST(danger AS VARCHAR) AS detail FROM scars WHERE path IN (SELECT path FROM plan) AND danger >= 0.3
UNION ALL SELECT path, 'partner', partner FROM couples WHERE path IN (SELECT path FROM plan) AND partner NOT IN (SELECT path FROM plan)
""", ("basket",))
def edit_warnings(spark, sf):
    (b,) = read(spark, sf, "basket")
    plan = spark.createDataFrame([(f"supply/s{i}.py",) for i in (1, 2, 3)], "path string")
    return history.edit_warnings(plan, history.danger(b), history.cochange(b, min_confidence=0.05))


@query("""
WITH m AS (SELECT DISTINCT node, doc, ts, outcome = 'useful' AS pos, power(0.5::DOUBLE, greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / 86400.0::DOUBLE) / 30.0::DOUBLE) AS w FROM outcome),
g AS (SELECT node, round(sum(CASE WHEN pos THEN w ELSE -w END), 6) AS score, count(DISTINCT doc) FILTER (pos) AS n_pos, count(DISTINCT doc) FILTER (NOT pos) AS n_neg, max(ts) AS last FROM m GROUP BY node)
SELECT *, CASE WHEN n_neg > 0 THEN CASE WHEN abs(score) < 1e-6 THEN 'contested_even' WHEN score > 0 THEN 'contested_useful' ELSE 'contested_dead_end' END WHEN n_pos >= 2 THEN 'preferred' ELSE 'tentative' END AS verdict FROM g WHERE n_pos > 0
""", ("outcome",))
def lesson_scores(spark, sf):
    return history.lesson_scores(read(spark, sf, "outcome")[0], "2024-01-31 00:00:00")


@query("SELECT question, doc, outcome FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ts DESC, doc DESC) AS k FROM outcome) t WHERE k = 1", ("outcome",))
def lesson_latest(spark, sf):
    return history.latest_by(read(spark, sf, "outcome")[0], "question", ["ts", "doc"], "doc", "outcome")


@query("SELECT node, doc, row_number() OVER (PARTITION BY node ORDER BY ts DESC, doc DESC) AS rank FROM outcome QUALIFY rank <= 5", ("outcome",))
def lesson_provenance(spark, sf):
    return history.provenance(read(spark, sf, "outcome")[0])


@query("SELECT node, outcome FROM (SELECT node, outcome, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, outcome) AS k FROM outcome GROUP BY 1, 2) t WHERE k = 1", ("outcome",))
def plurality_vote(spark, sf):
    return history.plurality(read(spark, sf, "outcome")[0], "node", "outcome")


#: (number, subject, relation, object, insight) of the claims made about every nation and its region.
_SAID = (
    (0, "r_name", "contains", "n_name", 0), (1, "n_name", "contains", "r_name", 100), (2, "r_name", "contains", "'no such node'", 200),
    (3, "n_name", "uses", "r_name", 300), (4, "n_name", "exists", "''", 400), (5, "'no such node'", "exists", "''", 500),
    (6, "n_name", "defined_in", "'geo/nation.tbl'", 600), (7, "n_name", "defined_in", "'geo/region.tbl'", 700),
    (8, "r_name", "defines", "n_name", 800), (9, "n_name", "connected", "concat('Customer#', lpad(cast(n_nationkey + 1 as varchar(9)), 9, '0'))", 900),
)
_CLAIMS = " UNION ALL ".join(
    f"SELECT n_nationkey * 10 + {k} AS claim_id, {s} AS subject, '{r}' AS relation, {o} AS object, n_regionkey + {i} AS insight_id FROM nr" for k, s, r, o, i in _SAID
)


def claims(spark, sf):
    r, n = read(spark, sf, "region", "nation")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    out = spark.sql(_CLAIMS.replace("FROM nr", "FROM {nr}"), nr=nr)
    return out.withColumn("claim_id", F.col("claim_id").cast("long"))


_VERDICT = f"""nr AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), c AS ({_CLAIMS}),
l AS (SELECT subject AS label FROM c UNION SELECT object FROM c),
m AS (SELECT l.label, id, source_file, length(n.label) AS k, CASE WHEN lower(l.label) IN (lower(n.label), regexp_replace(lower(n.label), '\\(\\)$', '')) THEN 0 ELSE 1 END AS t
      FROM l JOIN kg_nodes n ON len(regexp_extract_all(l.label, '\\w+')) > 0 AND list_has_all(regexp_extract_all(lower(n.label), '\\w+'), regexp_extract_all(lower(l.label), '\\w+'))),
res AS (SELECT *, count(*) OVER (PARTITION BY label, t, k) = 1 AS sure, row_number() OVER (PARTITION BY label ORDER BY t, k, id) AS rank FROM m QUALIFY rank <= 8),
e AS (SELECT DISTINCT src, dst, CASE relation WHEN 'imports_from' THEN 'imports' ELSE relation END AS rel FROM kg_edges),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
p AS (SELECT claim_id, CASE relation WHEN 'defines' THEN 'contains' ELSE relation END AS rel, x.id AS src, y.id AS dst, x.sure AND y.sure AS sure
      FROM c JOIN res x ON x.label = subject JOIN res y ON y.label = object WHERE relation NOT IN ('exists', 'defined_in') AND x.id <> y.id),
q AS (SELECT p.*, EXISTS (FROM e WHERE e.src = p.src AND e.dst = p.dst AND e.rel = p.rel) AS same, EXISTS (FROM e WHERE e.src = p.src AND e.dst = p.dst) AS fwd,
             EXISTS (FROM e WHERE e.src = p.dst AND e.dst = p.src AND e.rel = p.rel) AS turned, EXISTS (FROM e WHERE e.src = p.dst AND e.dst = p.src) AS rev FROM p),
loose AS (SELECT DISTINCT src, dst FROM q WHERE NOT fwd AND NOT rev),
n1 AS (SELECT DISTINCT src, dst, b AS x FROM loose JOIN u ON a = src), n2 AS (SELECT DISTINCT src, dst, b AS y FROM loose JOIN u ON a = dst),
near AS (SELECT src, dst FROM n1 JOIN n2 USING (src, dst) WHERE x = y UNION SELECT n1.src, n1.dst FROM n1 JOIN u ON u.a = x JOIN n2 ON n2.src = n1.src AND n2.dst = n1.dst AND n2.y = u.b),
w AS (SELECT claim_id, CASE WHEN same OR rel = 'connected' AND (fwd OR rev) THEN 3 WHEN fwd THEN 2 WHEN turned AND sure THEN 0 WHEN rev OR near.src IS NOT NULL THEN 2 WHEN sure THEN 0 ELSE 1 END AS worth
      FROM q LEFT JOIN near ON near.src = q.src AND near.dst = q.dst
      UNION ALL SELECT claim_id, 3 FROM c WHERE relation = 'exists' AND subject IN (SELECT label FROM res)
      UNION ALL SELECT claim_id, CASE WHEN bool_or(contains(lower(source_file), lower(object))) THEN 3 WHEN arg_min(sure, rank) THEN 0 ELSE 1 END FROM c JOIN res ON label = subject WHERE relation = 'defined_in' GROUP BY claim_id),
v AS (SELECT claim_id, insight_id, ['REFUTED', 'UNKNOWN', 'VERIFIED_INDIRECT', 'VERIFIED'][coalesce(max(worth), 1) + 1] AS verdict FROM c LEFT JOIN w USING (claim_id) GROUP BY ALL)"""


@query(f"WITH {_VERDICT} SELECT CAST(claim_id AS BIGINT) AS claim_id, verdict FROM v", KG)
def claim_verdicts(spark, sf):
    n, e = kg(spark, sf)
    return verification.claim_verdicts(claims(spark, sf), n, e)


@query(f"WITH {_VERDICT} SELECT verdict, count(*) AS n FROM v GROUP BY verdict", KG)
def verdict_summary(spark, sf):
    n, e = kg(spark, sf)
    return verification.verdict_summary(verification.claim_verdicts(claims(spark, sf), n, e))


@query(f"""
WITH {_VERDICT}, g AS (SELECT insight_id, CASE WHEN bool_and(starts_with(verdict, 'VERIFIED')) THEN 'ADMITTED' ELSE 'REJECTED' END AS status FROM v GROUP BY 1)
SELECT CAST(insight_id AS BIGINT) AS insight_id, status, CASE WHEN status = 'ADMITTED' THEN 'm' || row_number() OVER (PARTITION BY status ORDER BY insight_id) END AS memory_id FROM g
""", KG)
def memory_admit(spark, sf):
    n, e = kg(spark, sf)
    c = claims(spark, sf)
    return verification.admit(c, verification.claim_verdicts(c, n, e))


@query(f"""
WITH {_VERDICT}, g AS (SELECT insight_id, bool_and(starts_with(verdict, 'VERIFIED')) AS good, CASE WHEN insight_id % 2 = 0 THEN 'active' ELSE 'quarantined' END AS was FROM v GROUP BY 1)
SELECT CAST(insight_id AS BIGINT) AS insight_id, CASE WHEN good THEN 'active' ELSE 'quarantined' END AS status,
 CASE WHEN good AND was = 'quarantined' THEN 'resurrected' WHEN good THEN 'confirmed' WHEN was = 'active' THEN 'quarantined' ELSE 'still_bad' END AS change FROM g
""", KG)
def memory_reverify(spark, sf):
    n, e = kg(spark, sf)
    c = claims(spark, sf)
    memory = c.select("insight_id").distinct().withColumn("status", F.when(F.col("insight_id") % 2 == 0, "active").otherwise("quarantined"))
    return verification.reverify(memory, c, verification.claim_verdicts(c, n, e))


@query(f"""
WITH {DEG}, c AS (SELECT label, source_file, degree FROM kg_nodes JOIN deg USING (id) WHERE file_type = 'code'),
s AS (SELECT regexp_replace(label, '\\(\\)$', '') AS name, 'callable' AS kind, degree FROM c WHERE ends_with(label, '()') UNION ALL SELECT label, 'class', degree FROM c WHERE regexp_matches(label, '^[A-Z][A-Za-z0-9_]*$')
 UNION ALL SELECT unnest(string_split(regexp_replace(source_file, '\\.[^./]+$', ''), '/')), 'module', 0 FROM c)
SELECT name, kind, max(degree) AS degree FROM s WHERE name <> '' GROUP BY 1, 2
""", KG)
def symbol_space(spark, sf):
    return verification.symbol_space(*kg(spark, sf))


_MAN = """cur AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0),
man AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 0)"""


def manifests(spark, sf):
    (d,) = read(spark, sf, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    cur = d.where("doc_id % 11 <> 0").select(path, F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return cur, d.where("doc_id % 10 <> 0").select(path, F.md5("text").alias("hash"))


@query(f"""
WITH {_MAN} SELECT coalesce(cur.path, man.path) AS path, CASE WHEN cur.path IS NULL THEN 'deleted' WHEN man.path IS NULL THEN 'new' WHEN cur.hash = man.hash THEN 'unchanged' ELSE 'changed' END AS state
FROM cur FULL JOIN man ON cur.path = man.path
""")
def manifest_diff(spark, sf):
    return incremental.manifest_diff(*manifests(spark, sf))


@query(f"""
WITH {_MAN} SELECT coalesce(cur.path, man.path) AS path, coalesce(cur.hash, man.hash) AS ast_hash, CASE WHEN cur.hash IS NULL OR cur.hash = man.hash THEN man.hash END AS semantic_hash
FROM cur FULL JOIN man ON cur.path = man.path
""")
def manifest_upsert(spark, sf):
    cur, man = manifests(spark, sf)
    old = man.select("path", F.col("hash").alias("ast_hash"), F.col("hash").alias("semantic_hash"))
    return incremental.manifest_upsert(old, cur, "ast")


@query(f"WITH {_MAN} SELECT path, hash IN (SELECT hash FROM man) AS hit FROM cur")
def cache_split(spark, sf):
    return incremental.cache_split(*manifests(spark, sf))


@query("""
WITH fresh AS (SELECT id, upper(label) AS label, file_type, source_file, community FROM kg_nodes WHERE source_file LIKE 'supply/n1%'),
n AS (SELECT * FROM kg_nodes WHERE source_file NOT IN (SELECT source_file FROM fresh) AND source_file <> 'crm/BUILDING.md' UNION ALL SELECT * FROM fresh)
SELECT id, label, file_type, source_file, CAST(community AS BIGINT) AS community FROM n
""", KG)
def incremental_replace(spark, sf):
    n, _ = kg(spark, sf)
    fresh = n.where("source_file like 'supply/n1%'").withColumn("label", F.upper("label"))
    gone = spark.createDataFrame([("crm/BUILDING.md",), ("supply/n1.py",)], "source_file string")
    return incremental.replace_sources(n, fresh, gone)


@query("WITH late AS (SELECT id FROM kg_nodes WHERE id LIKE 'C:%9') SELECT id FROM late WHERE id NOT IN (SELECT id FROM kg_nodes WHERE source_file = 'crm/BUILDING.md')", KG)
def shrink_guard(spark, sf):
    n, _ = kg(spark, sf)
    return incremental.unaccounted_losses(n, n.where("id not like 'C:%9'"), n.where("source_file = 'crm/BUILDING.md'"))


@query("SELECT 'repo::' || id AS id, label, id AS local_id, 'repo' AS repo FROM kg_nodes", KG)
def repo_prefix(spark, sf):
    n, e = incremental.prefixed(*kg(spark, sf), "repo")
    return n.select("id", "label", "local_id", "repo")


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN regexp_matches(lower(url), '(twitter|//x)\\.com/') THEN 'tweet' WHEN regexp_matches(lower(url), 'youtube\\.com/|youtu\\.be/') THEN 'youtube'
 WHEN contains(lower(url), 'github.com/') THEN 'github' WHEN regexp_matches(lower(url), '\\.pdf($|[?#])') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(png|jpe?g|gif|webp)($|[?#])') THEN 'image' ELSE 'webpage' END AS kind FROM pages""")
def url_kind(spark, sf):
    return read(spark, sf, "pages")[0].select("page_id", X.url_kind(F.col("url")).alias("kind"))


@query("""SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 8000) AS text FROM pages""")
def html_text(spark, sf):
    return read(spark, sf, "pages")[0].select("page_id", X.html_text(F.col("html")).alias("text"))


@query("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"#]+)"', 1)) AS href FROM pages""")
def page_links(spark, sf):
    return extract.page_links(read(spark, sf, "pages")[0])


_SIG = " + ".join(f"CAST(regexp_matches(h, '{p}') AS INTEGER)" for p in extract.PAPER_SIGNALS)


@query(f"WITH d AS (SELECT doc_id, lower(substr(text, 1, 3000)) AS h FROM documents) SELECT doc_id, CASE WHEN {_SIG} >= 3 THEN 'paper' ELSE 'document' END AS kind FROM d")
def paper_signals(spark, sf):
    d = read(spark, sf, "documents")[0]
    return d.select("doc_id", extract.file_kind(F.concat("doc_id", F.lit(".txt")), F.col("text")).alias("kind"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_words, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS n_tokens FROM documents")
def word_counts(spark, sf):
    d = read(spark, sf, "documents")[0]
    return d.select("doc_id", X.word_count(F.col("text")).alias("n_words"), X.token_estimate(F.col("text")).alias("n_tokens"))


@query("SELECT lang AS kind, count(*) AS n_files, CAST(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_words FROM documents GROUP BY lang")
def corpus_stats(spark, sf):
    return extract.corpus_stats(read(spark, sf, "documents")[0].select(F.col("lang").alias("kind"), "text"))


@query("""
SELECT count(*) AS n_files, CAST(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_words, sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) >= 50000 AS needs_graph,
 CASE WHEN sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) > 500000 THEN 'many words' WHEN count(*) > 500 THEN 'many files' WHEN sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) < 50000 THEN 'small corpus' END AS warning FROM documents
""")
def corpus_verdict(spark, sf):
    return extract.corpus_verdict(corpus_stats(spark, sf))


@query("SELECT doc_id, sha256(text || chr(0) || 'docs/' || doc_id || '.txt') AS hash FROM documents")
def content_hash(spark, sf):
    d = read(spark, sf, "documents")[0]
    return d.select("doc_id", X.content_hash(F.col("text"), F.concat(F.lit("docs/"), "doc_id", F.lit(".txt"))).alias("hash"))


@query("SELECT id, trim(regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g'), '_') AS norm_id, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm_label FROM kg_nodes", KG)
def id_normalisation(spark, sf):
    n, _ = kg(spark, sf)
    return n.select("id", X.ascii_id(F.col("id")).alias("norm_id"), X.norm_label(F.col("label")).alias("norm_label"))


@query("""SELECT DISTINCT source_file, split_part(source_file, '/', 1) AS top, CASE WHEN source_file LIKE '%.py' THEN 'code' WHEN source_file LIKE '%.pdf' THEN 'paper' ELSE 'doc' END AS category, CASE WHEN source_file LIKE '%.py' THEN 'python' END AS family FROM kg_nodes""", KG)
def file_families(spark, sf):
    f = kg(spark, sf)[0].select("source_file").distinct()
    c = F.col("source_file")
    return f.select("source_file", X.top_dir(c).alias("top"), X.file_category(c).alias("category"), X.language_family(c).alias("family"))


@query("""
WITH e AS (SELECT ts, count(*) AS k FROM events GROUP BY ts), g AS (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) > 300 THEN 1 ELSE 0 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (ORDER BY ts) AS run FROM g)
SELECT min(ts) AS batch_start, max(ts) AS batch_end, CAST(sum(k) AS BIGINT) AS n FROM r GROUP BY run
""")
def debounce_batches(spark, sf):
    return changes.debounce_batches(read(spark, sf, "events")[0], 300)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf):
    return changes.tumbling_counts(read(spark, sf, "events")[0], "1 hour", "10 minutes", "event_type")


@query("SELECT id, count(*) AS degree FROM (SELECT 'U:' || user_id AS id FROM events UNION ALL SELECT 'T:' || event_type FROM events) t GROUP BY id")
def stream_degree(spark, sf):
    e = read(spark, sf, "events")[0].select(F.concat(F.lit("U:"), "user_id").alias("src"), F.concat(F.lit("T:"), "event_type").alias("dst"))
    return changes.running_degree(e)


@query("""
WITH f AS (SELECT 'd/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS t, row_number() OVER (ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS k FROM documents),
w AS (SELECT path, k, t AS used, 0::BIGINT AS chunk FROM f WHERE k = 1
 UNION ALL SELECT f.path, f.k, CASE WHEN w.used + f.t > 60000 THEN f.t ELSE w.used + f.t END, CASE WHEN w.used + f.t > 60000 THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN f ON f.k = w.k + 1)
SELECT path, chunk FROM w
""", ("trade",))
def token_pack(spark, sf):
    d = read(spark, sf, "documents")[0]
    files = d.select(F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), X.token_estimate(F.col("text")).alias("n_tokens"))
    return packing.pack_tokens(files)


@query("SELECT backend, tokens, round(tokens * price / 1e6, 6) AS cost FROM (VALUES ('a', 3.0::DOUBLE), ('b', 0.25::DOUBLE)) p(backend, price), (SELECT CAST(sum(greatest(1, CAST(floor(length(text) / 4) AS BIGINT))) AS BIGINT) AS tokens FROM documents) t")
def cost_estimate(spark, sf):
    d = read(spark, sf, "documents")[0].select(X.token_estimate(F.col("text")).alias("n_tokens"))
    return packing.cost(d, {"a": 3.0, "b": 0.25})


def _last(mark: str, backwards: str) -> str:
    """End of a slice before the last ``mark`` of its window ``w`` (null without one, or where the window begins with it)."""
    at = f"length(w) - position({backwards} IN reverse(w)) - length({mark}) + 1"
    return f"CASE WHEN contains(w, {mark}) AND {at} > 0 THEN b + {at} + 1 END"


_SLICE_END = f"""CASE WHEN b + 4000 >= n THEN n ELSE coalesce({_last("chr(10) || '#'", "('#' || chr(10))")}, {_last("chr(10) || chr(10)", "(chr(10) || chr(10))")},
  {_last("chr(10)", "chr(10)")}, b + 4000) END"""


@query(f"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT path, 0::BIGINT AS part, b, CAST({_SLICE_END} AS BIGINT) AS e FROM (SELECT path, n, 0::BIGINT AS b, substr(text, 1, 4000) AS w FROM d WHERE n > 0) t
  UNION ALL SELECT path, part + 1, b, CAST({_SLICE_END} AS BIGINT) FROM (SELECT s.path, s.part, d.n, s.e AS b, substr(d.text, s.e + 1, 4000) AS w FROM s JOIN d USING (path) WHERE s.e < d.n) t)
SELECT path, part, b AS "start", e AS "end" FROM s
""")
def document_slices(spark, sf):
    d = read(spark, sf, "documents")[0]
    return extract.slices(d.select(F.col("doc_id").cast("string").alias("path"), "text"))


@query()
def markdown_fragments(spark, sf):
    d = read(spark, sf, "documents")[0]
    files = d.select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("path"), "text")
    n, _, _ = extract.exploded(extract.extract(files))
    return n


@query()
def graph_query(spark, sf):
    n, e = kg(spark, sf)
    return search.query_graph(n, e, "which nation contains the forest green part")
