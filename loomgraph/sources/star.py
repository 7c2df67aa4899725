"""Derived inputs over the star schema: a typed graph, trade links, baskets, outcomes.

The definitions are SQL that Spark and other engines read alike, so that any engine sees the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.runtime import ensure_importable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

KG_EDGES = """
SELECT concat('R:', r_regionkey) AS src, concat('N:', n_nationkey) AS dst, 'contains' AS relation, 'EXTRACTED' AS confidence
  FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('C:', c_custkey), concat('N:', c_nationkey), 'references', 'EXTRACTED' FROM customer
UNION ALL SELECT concat('S:', s_suppkey), concat('N:', s_nationkey), 'references', 'EXTRACTED' FROM supplier
UNION ALL SELECT concat('C:', o_custkey), concat('O:', o_orderkey), 'calls',
          CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' ELSE 'AMBIGUOUS' END FROM orders
UNION ALL SELECT DISTINCT concat('O:', l_orderkey), concat('P:', l_partkey), 'uses', 'INFERRED' FROM lineitem
UNION ALL SELECT DISTINCT concat('P:', l_partkey), concat('S:', l_suppkey), 'imports_from', 'EXTRACTED' FROM lineitem
"""
KG_NODES = """
SELECT concat('R:', r_regionkey) AS id, r_name AS label, 'concept' AS file_type, 'geo/region.tbl' AS source_file,
       100 + r_regionkey AS community FROM region
UNION ALL SELECT concat('N:', n_nationkey), n_name, 'concept', 'geo/nation.tbl', 100 + n_regionkey FROM nation
UNION ALL SELECT concat('C:', c_custkey), c_name, 'document', concat('crm/', c_mktsegment, '.md'), c_nationkey FROM customer
UNION ALL SELECT concat('S:', s_suppkey), s_name, 'code', concat('supply/n', s_nationkey, '.py'), s_nationkey FROM supplier
UNION ALL SELECT concat('O:', o_orderkey), concat('order ', o_orderkey), 'paper',
          concat('orders/', year(o_orderdate), '.pdf'), c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat('P:', p_partkey), concat(p_name, '()'), 'code', concat('parts/', p_brand, '.py'),
          p_size % 25 FROM part
"""
TRADE = """
SELECT src_n, dst_n FROM (
  SELECT c_nationkey AS src_n, s_nationkey AS dst_n,
         row_number() OVER (PARTITION BY c_nationkey
                            ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC, s_nationkey) AS rk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) t WHERE rk <= 3
"""
BASKET = """
SELECT DISTINCT l_orderkey AS commit_id, concat('supply/s', l_suppkey, '.py') AS path,
       CASE o_orderstatus WHEN 'F' THEN 'fix: prices' WHEN 'P' THEN 'Revert "prices"' ELSE 'feat: prices' END AS subject
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
OUTCOME = """
SELECT event_id AS doc, user_id AS node, ts, CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'error' THEN 'dead_end'
       WHEN 'signup' THEN 'corrected' END AS outcome, concat('q', event_id % 97) AS question
FROM events WHERE event_type IN ('purchase', 'error', 'signup')
"""
VIEWS = {"kg_edges": KG_EDGES, "kg_nodes": KG_NODES, "trade": TRADE, "basket": BASKET, "outcome": OUTCOME}


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Derived inputs (or plain tables) by name, over the Parquet tables of ``sf_dir``."""
    ensure_importable(spark)
    out = []
    for name in names:
        if name in VIEWS:
            sql = VIEWS[name]
            frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in sql}
            for t in frames:  # table names become parameters of the statement: no shared view is touched
                sql = _replace_word(sql, t)
            out.append(spark.sql(sql, **{f"_{t}": f for t, f in frames.items()}))
        else:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out


def _replace_word(sql: str, table: str) -> str:
    import re

    return re.sub(rf"(FROM|JOIN) {table}\b", rf"\1 {{_{table}}}", sql)


def prelude(*names: str) -> str:
    """The same inputs as a WITH clause for another SQL engine."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
