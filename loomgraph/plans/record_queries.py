"""Labels, paths, records, manifests and resolution over records derived from the star tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import safety
from loomgraph.functions import text as X
from loomgraph.operators import history, incremental, packing, resolution, sections, verification
from loomgraph.plans.graph_queries import KG, kg
from loomgraph.plans.registry import query
from loomgraph.sinks import drawing, export
from loomgraph.sources import extract, manifests
from loomgraph.sources.star import read

WORD = "split_part(p_name, ' ', 1)"
BRAND = "replace(p_brand, '#', '')"


@query("""
SELECT x.s_name AS a, y.s_name AS b FROM supplier x JOIN supplier y ON y.s_suppkey - x.s_suppkey IN (1, 9, 10, 11, 90)
WHERE damerau_levenshtein(x.s_name, y.s_name) <= 1
""")
def near_names(spark, sf):
    (s,) = read(spark, sf, "supplier")
    a = s.select(F.col("s_name").alias("a"), F.expr("explode(transform(array(1, 9, 10, 11, 90), d -> s_suppkey + d))").alias("k"))
    return a.join(s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("b")), "k").where(X.one_edit(F.col("a"), F.col("b"))).select("a", "b")


_PAIR = f"lower({WORD}) || p_size AS a, lower(CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE {WORD} END) || p_size % 7 AS b"


@query(f"SELECT p_partkey, a, b FROM (SELECT p_partkey, {_PAIR} FROM part) t WHERE rtrim(a, '0123456789') = rtrim(b, '0123456789') AND a <> b")
def variant_labels(spark, sf):
    (p,) = read(spark, sf, "part")
    return p.selectExpr("p_partkey", *_PAIR.replace("AS a, ", "AS a\n").split("\n")).where(X.variant_pair(F.col("a"), F.col("b")))


@query("""
SELECT doc_id, len(n) AS n_numbers, array_to_string(list_sort(list_transform(n, lambda x: ltrim(x, '0'))), ' ') AS numbers
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS n FROM documents) t
""")
def number_tokens(spark, sf):
    (d,) = read(spark, sf, "documents")
    n = d.select("doc_id", X.numeric_tokens(F.col("text")).alias("n"))
    return n.select("doc_id", F.size("n").alias("n_numbers"), F.array_join("n", " ").alias("numbers"))


_PATH = f"concat(CASE p_partkey % 4 WHEN 0 THEN './' WHEN 1 THEN '../' WHEN 2 THEN '/' ELSE '.hidden/' END, {BRAND}, chr(92), p_type, '.py') AS path"


@query(f"SELECT p_partkey, ltrim(replace(path, chr(92), '/'), './') AS path FROM (SELECT p_partkey, {_PATH} FROM part) t")
def bare_paths(spark, sf):
    (p,) = read(spark, sf, "part")
    return p.selectExpr("p_partkey", _PATH).select("p_partkey", X.bare_path(F.col("path")).alias("path"))


@query("SELECT p_partkey, substr(repeat(p_name || p_type, p_size), 1, 256) AS label FROM part")
def clean_labels(spark, sf):
    (p,) = read(spark, sf, "part")
    raw = F.expr("repeat(concat(p_name, chr(9), p_type, chr(10), chr(127)), p_size)")
    return p.select("p_partkey", X.sanitized_label(raw).alias("label"))


@query("""
SELECT p_partkey, CAST(CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_size * 1073741824 + 536870912
  WHEN 4 THEN p_size * 1099511627776 ELSE 7 END AS BIGINT) AS bytes FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part) t
""")
def size_literals(spark, sf):
    (p,) = read(spark, sf, "part")
    text = F.expr("""CASE p_partkey % 8 WHEN 0 THEN concat(p_size) WHEN 1 THEN concat(p_size, 'KB') WHEN 2 THEN concat(' ', p_size, ' mb ') WHEN 3 THEN concat(p_size, '.5GiB')
      WHEN 4 THEN concat(p_size, 'T') WHEN 5 THEN concat(p_size, 'XB') WHEN 6 THEN 'MB' END""")
    return p.select("p_partkey", X.size_literal(text, 7).alias("bytes"))


_PR = """o_orderkey AS number, o_orderkey % 11 = 0 AS is_draft, CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'PENDING' END AS ci_status,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CHANGES_REQUESTED' WHEN '2' THEN 'APPROVED' END AS review_decision"""


@query(f"""
WITH s AS (SELECT number, CASE WHEN is_draft THEN 'draft' WHEN ci_status = 'FAILURE' THEN 'failing' WHEN review_decision = 'CHANGES_REQUESTED' THEN 'changes'
  WHEN ci_status = 'PENDING' THEN 'pending' WHEN review_decision = 'APPROVED' THEN 'approved' ELSE 'open' END AS status FROM (SELECT {_PR} FROM orders) t)
SELECT number, status, CAST(list_position(['approved', 'open', 'changes', 'failing', 'pending', 'draft'], status) AS BIGINT) AS rank FROM s
""")
def pr_status(spark, sf):
    (o,) = read(spark, sf, "orders")
    return packing.pr_ladder(spark.sql(f"SELECT {_PR} FROM {{o}}", o=o))


@query("""
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'bash' WHEN 2 THEN 'node' WHEN 3 THEN 'python' END AS program FROM supplier
""")
def shebang_programs(spark, sf):
    (s,) = read(spark, sf, "supplier")
    line = F.expr("""CASE s_suppkey % 6 WHEN 0 THEN concat('#!/usr/bin/env python3.', s_suppkey) WHEN 1 THEN '#! /bin/bash -e' WHEN 2 THEN '#!/usr/bin/env -S NODE_ENV=x node --flag'
      WHEN 3 THEN '#!/opt/python2.7' WHEN 4 THEN '#!/usr/bin/env' END""")
    return s.select("s_suppkey", manifests.interpreter_column(line).alias("program"))


@query("SELECT DISTINCT path FROM basket WHERE path = 'supply/s7.py'", ("basket",))
def file_by_suffix(spark, sf):
    return history.unique_suffix(read(spark, sf, "basket")[0].select("path"), "s7.py")


@query("""
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS commit_id, 'fix: ' || o_orderstatus AS subject, 'orders/' || o_orderpriority || '.sql' AS path FROM orders
""")
def log_commits(spark, sf):
    (o,) = read(spark, sf, "orders")
    piece = F.expr("concat(chr(1), 'fix: ', o_orderstatus, ' ', chr(2), chr(10), 'orders/', o_orderpriority, '.sql', chr(10), 'web/yarn.lock', chr(10))")
    logs = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", piece.alias("piece")))).alias("p"))
    return history.quiet(history.parse_log(logs.select("o_custkey", F.array_join("p.piece", "").alias("value")), "o_custkey"))


@query("""
SELECT src, dst, relation, confidence, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 ELSE 0.2 END::DOUBLE AS confidence_score FROM kg_edges
""", KG)
def export_edges(spark, sf):
    return export.export_rows(*kg(spark, sf))[1]


@query("SELECT id, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm_label FROM kg_nodes", KG)
def export_nodes(spark, sf):
    return export.export_rows(*kg(spark, sf))[0].select("id", "norm_label")


@query("""
SELECT s_suppkey AS id, CASE WHEN s_nationkey % 5 = 0 THEN 'gone' WHEN s_suppkey % 2 = s_nationkey % 2 THEN 'fresh' ELSE 'stale' END AS state FROM supplier
""")
def overlay_freshness(spark, sf):
    s, n = read(spark, sf, "supplier", "nation")
    notes = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("source_file"), (F.col("s_suppkey") % 2).alias("fingerprint"))
    return incremental.overlay_state(notes, n.where("n_nationkey % 5 <> 0").select(F.concat(F.lit("n"), "n_nationkey").alias("path"), (F.col("n_nationkey") % 2).alias("hash")))


@query("""
SELECT id, label FROM (SELECT p_brand AS id, p_name AS label, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size <= 25 THEN 0 ELSE 1 END, p_name) AS k FROM part WHERE p_partkey % 7 <> 0) t WHERE k = 1
""")
def attached_hyperedges(spark, sf):
    (p,) = read(spark, sf, "part")
    h = p.select(F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand")).alias("id"), F.col("p_name").alias("label"), "p_size")
    return incremental.attach_hyperedges(h.where("p_size <= 25").drop("p_size"), h.where("p_size > 25").drop("p_size"))


@query(f"""
WITH n AS (SELECT 'P' || p_partkey AS id, {WORD} AS name, {BRAND} AS stem, 'b' || p_size AS folder FROM part),
m AS (SELECT id, name, stem AS module FROM n UNION SELECT id, name, folder FROM n),
one AS (SELECT module, name, min(id) AS dst FROM m GROUP BY ALL HAVING count(DISTINCT id) = 1)
SELECT DISTINCT 'I' || p_partkey AS src, dst, 'imports' AS relation FROM part JOIN one ON module = 'b' || (p_size % 10) AND name = {WORD}
""")
def qualified_imports(spark, sf):
    (p,) = read(spark, sf, "part")
    nodes = p.selectExpr("concat('P', p_partkey) AS id", f"concat({WORD}, '()') AS label", f"concat('b', p_size, '/', {BRAND}, '.py') AS source_file")
    return resolution.qualified_imports(p.selectExpr("concat('I', p_partkey) AS src", f"concat('app.b', p_size % 10, '.', {WORD}) AS qualified"), nodes)


@query(f"""
WITH one AS (SELECT p_size, {WORD} AS name, min('P' || p_partkey) AS dst FROM part GROUP BY ALL HAVING count(*) = 1),
i AS (SELECT DISTINCT p_brand, p_size % 9 AS alias, p_size, {WORD} AS name FROM part)
SELECT DISTINCT 'K' || p.p_partkey AS src, dst, 'calls' AS relation, 'EXTRACTED' AS confidence FROM part p JOIN i ON i.p_brand = p.p_brand AND i.alias = p.p_size % 9 JOIN one ON one.p_size = i.p_size AND one.name = i.name
""")
def import_guided_calls(spark, sf):
    (p,) = read(spark, sf, "part")
    file, alias = f"concat({BRAND}, '.py') AS source_file", "concat('f', p_size % 9) AS {}"
    nodes = p.selectExpr("concat('P', p_partkey) AS id", f"concat({WORD}, '()') AS label", "concat('lib/m', p_size, '.py') AS source_file")
    imports = p.selectExpr(file, alias.format("alias"), "concat('lib.m', p_size) AS module", f"{WORD} AS name").distinct()
    return resolution.import_guided_calls(p.selectExpr("concat('K', p_partkey) AS caller", alias.format("callee"), file), imports, nodes)


@query(f"""
WITH m AS (SELECT DISTINCT {BRAND} AS brand, {WORD} AS word FROM part)
SELECT DISTINCT 'P' || p_partkey AS src, 'M:' || brand || ':' || word AS dst, 'calls' AS relation, 'INFERRED' AS confidence FROM part JOIN m ON word = {WORD} AND brand = 'Brand' || (p_partkey % 25 + 1) WHERE p_partkey % 3 <> 2
""")
def member_calls(spark, sf):
    (p,) = read(spark, sf, "part")
    m = p.selectExpr(f"{BRAND} AS brand", f"{WORD} AS word").distinct()
    classes = m.selectExpr("concat('K:', brand) AS id", "brand AS label", "concat(brand, '.py') AS source_file").distinct()
    nodes = classes.unionByName(m.selectExpr("concat('M:', brand, ':', word) AS id", "concat('.', word, '()') AS label", "concat(brand, '.py') AS source_file"))
    edges = m.selectExpr("concat('K:', brand) AS src", "concat('M:', brand, ':', word) AS dst", "'method' AS relation")
    # receivers: a class by its name, a variable of a known type, a variable that nobody declares
    calls = p.selectExpr(
        "concat('P', p_partkey) AS caller", "concat(element_at(array('Brand', 'v', 'w'), cast(p_partkey % 3 + 1 AS int)), p_partkey % 25 + 1) AS receiver",
        f"upper({WORD}) AS callee", "'app.py' AS source_file",
    )
    types = spark.range(1, 26).selectExpr("'app.py' AS source_file", "concat('v', id) AS receiver", "concat('Brand', id) AS type_name")
    return resolution.member_calls(calls, types, nodes, edges)


@query("""
SELECT c_custkey, 0::BIGINT AS claim_no, c_name AS subject, CASE c_custkey % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'defined_in' ELSE 'exists' END AS relation,
 CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment || '.py' ELSE '' END AS object FROM customer
UNION ALL SELECT c_custkey, 1, 'Base', 'inherits', c_name FROM customer WHERE c_custkey % 2 = 0
""")
def mined_claims(spark, sf):
    (c,) = read(spark, sf, "customer")
    text = F.expr("""concat('First, `', c_name, CASE c_custkey % 3 WHEN 0 THEN concat('` calls `', c_mktsegment, '`') WHEN 1 THEN concat('` is defined in `', c_mktsegment, '.py`') ELSE '` is here' END, '. ',
      CASE WHEN c_custkey % 2 = 0 THEN concat('`Base` inherits `', c_name, '`! ') ELSE '' END, 'Nothing else.')""")
    return verification.extract_claims(c.select("c_custkey", text.alias("text")), "c_custkey")


@query("""
SELECT doc, 'query' AS type, strftime(ts, '%Y-%m-%d') AS date, question, outcome, CASE WHEN doc % 2 = 0 THEN 'see ' || node END AS correction, node || '|n' || doc AS nodes FROM outcome
""", ("outcome",))
def memory_front_matter(spark, sf):
    (o,) = read(spark, sf, "outcome")
    text = F.expr("""concat('---\\ntype: "query"\\ndate: ', date_format(ts, 'yyyy-MM-dd'), '\\nquestion: "', question, '"\\noutcome: ', outcome, '\\n',
      CASE WHEN doc % 2 = 0 THEN concat('correction: "see ', node, '"\\n') ELSE '' END, 'source_nodes: ["', node, '", "n', doc, '"]\\n---\\noutcome: not this\\n')""")
    return extract.front_matter(o.select("doc", text.alias("text"))).withColumn("nodes", F.array_join("source_nodes", "|")).drop("source_nodes")


@query("""
SELECT 's' || s_suppkey || '/Cargo.toml' AS path, 'pkg_s' || s_suppkey AS src, 'pkg_s' || (s_suppkey + 1) AS dst, 'crate_depends_on' AS relation, 's' || s_suppkey AS label
FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)
""")
def crate_dependencies(spark, sf):
    (s,) = read(spark, sf, "supplier")
    text = F.expr("""concat('[package]\\nname = "s', s_suppkey, '"\\n[dependencies]\\nserde = "1"\\ns', s_suppkey + 1, ' = "0.1"\\n')""")
    return manifests.crate_edges(s.select(F.expr("concat('s', s_suppkey, '/Cargo.toml')").alias("path"), text.alias("text")))


@query("""
WITH f AS (SELECT s_suppkey AS k, 'c' || s_suppkey || '/mcp.json' AS path FROM supplier)
SELECT path, 'c' || k || '_mcp_json' AS src, 'mcp_svc' || k AS dst, 'contains' AS relation, 'svc' || k AS label FROM f
UNION ALL SELECT path, 'mcp_svc' || k, 'pkg_org_p' || k % 7, 'uses', '@org/p' || k % 7 FROM f UNION ALL SELECT path, 'mcp_svc' || k, 'env_token', 'requires_env', 'TOKEN' FROM f
""")
def service_configs(spark, sf):
    (s,) = read(spark, sf, "supplier")
    text = F.expr("""concat('{"mcpServers": {"svc', s_suppkey, '": {"command": "run", "args": ["-y", "@org/p', s_suppkey % 7, '"], "env": {"TOKEN": "x"}}}}')""")
    return manifests.service_edges(s.select(F.expr("concat('c', s_suppkey, '/mcp.json')").alias("path"), text.alias("text")))


@query(f"""
WITH b AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 2 = 0 THEN upper({WORD}) ELSE {WORD} END) AS base FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY p_partkey) AS k FROM b)
SELECT p_partkey AS id, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM k
""")
def safe_file_names(spark, sf):
    (p,) = read(spark, sf, "part")
    return export.safe_names(p.selectExpr("p_partkey AS id", f"concat(CASE WHEN p_partkey % 2 = 0 THEN upper({WORD}) ELSE {WORD} END, '?:') AS label"))


_LINK = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat('ftp', substr(url, 5)) WHEN 2 THEN concat('http://', page_id % 256, '.', page_id * 7 % 256, '.3.4:80/x')
 WHEN 3 THEN concat('https://user@172.', page_id % 40, '.1.1?q') WHEN 4 THEN 'HTTP://Metadata.Google.Internal./v1' WHEN 5 THEN concat('http://100.', page_id % 256, '.0.9#f')
 WHEN 6 THEN concat('http://', page_id * 40000000) ELSE concat('http://192.', page_id % 3 * 84, '.', page_id % 5, '.7/') END AS link"""


@query(f"""
WITH l AS (SELECT page_id, {_LINK} FROM pages),
h AS (SELECT *, lower(split_part(link, ':', 1)) AS scheme, rtrim(split_part(regexp_replace(lower(regexp_extract(link, '://([^/?#]*)', 1)), '^.*@', ''), ':', 1), '.') AS host FROM l),
a AS (SELECT *, regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS quad, TRY_CAST(split_part(host, '.', 1) AS BIGINT) AS a, TRY_CAST(split_part(host, '.', 2) AS BIGINT) AS b, TRY_CAST(split_part(host, '.', 3) AS BIGINT) AS c FROM h)
SELECT page_id, link, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host IN ('metadata.google.internal', 'metadata.google.com') THEN 'host'
  WHEN regexp_matches(host, '^[0-9]+$') THEN 'address'
  WHEN quad AND (a IN (0, 10, 127) OR a >= 240 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
    OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) THEN 'address' END AS refusal
FROM a
""")
def url_safety(spark, sf):
    (p,) = read(spark, sf, "pages")
    return p.selectExpr("page_id", _LINK).select("page_id", "link", safety.url_refusal(F.col("link")).alias("refusal"))


_WAY = f"""concat(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/srv/graph/' WHEN 2 THEN '/srv/graphs/' ELSE './' END, {BRAND}, repeat('/..', CAST(p_size % 5 AS INT)), '//x/./',
 CASE p_partkey % 3 WHEN 0 THEN 'graph.json' WHEN 1 THEN '../graph/y' ELSE '..' END) AS path"""


@query(f"""
WITH p AS (SELECT p_partkey, {_WAY} FROM part),
r AS (SELECT *, list_reduce(list_prepend('', str_split(CASE WHEN path LIKE '/%' THEN path ELSE '/srv/graph/' || path END, '/')),
  lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x IN ('', '.') THEN acc ELSE acc || '/' || x END) AS full_path FROM p)
SELECT p_partkey, path, full_path = '/srv/graph' OR full_path LIKE '/srv/graph/%' AS allowed FROM r
""")
def path_safety(spark, sf):
    (p,) = read(spark, sf, "part")
    return p.selectExpr("p_partkey", _WAY).select("p_partkey", "path", safety.inside(F.col("path"), "/srv/graph").alias("allowed"))


@query("""
WITH s AS (SELECT community, count(*) AS n, row_number() OVER (ORDER BY community) - 1 AS k, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS across FROM kg_nodes GROUP BY 1),
b AS (SELECT *, k % across AS c, k // across AS r, CAST(ceil(sqrt(n)) AS BIGINT) AS cols FROM s),
z AS (SELECT *, greatest(600, 220 * cols) AS w, greatest(400, 100 * CAST(ceil(n / cols::DOUBLE) AS BIGINT) + 120) AS h FROM b),
cx AS (SELECT c, coalesce(sum(m) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 80 * c AS x FROM (SELECT c, max(w) AS m FROM z GROUP BY 1) t),
ry AS (SELECT r, coalesce(sum(m) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 80 * r AS y FROM (SELECT r, max(h) AS m FROM z GROUP BY 1) t),
n AS (SELECT id, community, row_number() OVER (PARTITION BY community ORDER BY label, id) - 1 AS i FROM kg_nodes)
SELECT id, CAST(community AS BIGINT) AS community, CAST(x + 20 + (i % cols) * 200 AS BIGINT) AS x, CAST(y + 80 + (i // cols) * 80 AS BIGINT) AS y
FROM n JOIN z USING (community) JOIN cx USING (c) JOIN ry USING (r)
""", KG)
def canvas_layout(spark, sf):
    return drawing.canvas_cards(kg(spark, sf)[0])


_FUNCTION = f"SELECT concat('f', p_partkey) AS id, concat({WORD}, p_partkey * 7 % 997, '()') AS label, 'code' AS file_type, concat('parts/', lower({BRAND}), '.py') AS source_file FROM part"
_CALL = f"SELECT concat('f', p_partkey) AS caller, upper(concat({WORD}, p_partkey * 11 % 997)) AS callee, p_partkey % 5 = 0 AS is_member, concat('parts/', lower({BRAND}), '.py') AS source_file FROM part"
_NEEDS = """SELECT concat('file:', source_file) AS src, CASE WHEN p % 2 = 0 THEN concat('parts_', other) ELSE other END AS dst, 'imports_from' AS relation, 'EXTRACTED' AS confidence, source_file
 FROM (SELECT DISTINCT concat('parts/', lower(replace(p_brand, '#', '')), '.py') AS source_file, concat('brand', 1 + p_size % 25) AS other, p_size % 2 AS p FROM part WHERE p_partkey % 3 = 0) t
 UNION ALL SELECT concat('f', p_partkey), concat('f', p_partkey + 1), 'calls', 'EXTRACTED', 'x.py' FROM part"""


@query(f"""
WITH n AS ({_FUNCTION}), c AS ({_CALL}), e AS ({_NEEDS}),
i AS (SELECT lower(replace(label, '()', '')) AS k, id AS dst, source_file AS df FROM n),
j AS (SELECT DISTINCT caller, i.k, i.dst, CASE WHEN df = c.source_file THEN 0 WHEN m.dst IS NOT NULL THEN 1 ELSE 2 END AS tier
  FROM c JOIN i ON lower(callee) = i.k AND caller <> i.dst
  LEFT JOIN e m ON m.relation = 'imports_from' AND m.source_file = c.source_file AND replace(m.dst, 'parts_', '') = regexp_extract(df, '/(.*)[.]py$', 1)
  WHERE NOT is_member),
b AS (SELECT caller, k, min(tier) AS tier FROM j GROUP BY 1, 2),
g AS (SELECT caller, k, tier, count(DISTINCT dst) AS n, min(dst) AS dst FROM j JOIN b USING (caller, k, tier) GROUP BY 1, 2, 3)
SELECT caller AS src, g.dst, 'calls' AS relation, CASE WHEN min(tier) < 2 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence
FROM g WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = caller AND e.dst = g.dst) GROUP BY ALL
""")
def call_resolution(spark, sf):
    (p,) = read(spark, sf, "part")
    n, c, e = (spark.sql(sql.replace("FROM part", "FROM {part}"), part=p) for sql in (_FUNCTION, _CALL, _NEEDS))
    return extract.resolved_calls(n, e, c)


@query(f"""
WITH s AS (SELECT split_part(source_file, '/', 1) AS section, count(*) AS n FROM kg_nodes GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, section) AS k FROM s)
SELECT CASE WHEN k <= 3 THEN section ELSE 'other' END AS section, CAST(sum(n) AS BIGINT) AS n, min(k) AS rank FROM r GROUP BY 1
""", KG)
def section_ranks(spark, sf):
    n = kg(spark, sf)[0]
    return sections.ranked_sections(n.select(F.split_part("source_file", F.lit("/"), F.lit(1)).alias("section")), 3)


_INSIGHT = f"concat(p_name, ' of ', {BRAND})"


@query(f"""
WITH m AS (SELECT p_partkey AS insight_id, regexp_extract_all(lower({_INSIGHT}), '[a-z0-9_]+') AS w, list_transform(str_split(p_type, ' '), lambda x: lower(x)) AS a FROM part),
s AS (SELECT insight_id, CAST(list_sum(list_transform(['promo', 'economy', 'small', 'widget', 'brand19'], lambda t: CASE WHEN list_contains(a, t) THEN 2 WHEN list_contains(w, t) THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM m)
SELECT insight_id, score FROM s WHERE score > 0 ORDER BY score DESC, insight_id LIMIT 25
""")
def insight_recall(spark, sf):
    (p,) = read(spark, sf, "part")
    memory = p.selectExpr("p_partkey AS insight_id", f"{_INSIGHT} AS insight", "split(p_type, ' ') AS anchors")
    return verification.recall(memory, "Promo economy: small widget, Brand19", 25)
