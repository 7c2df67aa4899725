"""Queries of the training-data operators and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe import bpe_round_trip
from loomgraph.llm.embeddings import near_vectors
from loomgraph.llm.fingerprints import fingerprint_pairs
from loomgraph.llm.licenses import DIGESTS, NOTICES, STEPS, TEXTS, license_scan
from loomgraph.llm.minhash import minhash_components
from loomgraph.llm.mixing import mixed_sizes
from loomgraph.llm.pii import pii_spans
from loomgraph.llm.quality import quality_scores
from loomgraph.llm.substrings import repeated_windows_removed
from loomgraph.llm.urlfilter import judge_urls
from loomgraph.runtime import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows_removed(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = (
        op1_bpe_round_trip, op2_quality_classifier, op3_embedding_near_dedup, op4_pii, op5_fingerprints,
        op6_substring_dedup, op7_url_filter, op8_source_mix, op9_license_scan, op10_minhash_near_dedup,
    )
    return {f.__name__: f for f in named}


_OP7 = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT u.*, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

# Components by closure over both directions of the links; the smallest id that is reached names them.
_REACH = """reach(node, other) AS (SELECT a, b FROM links UNION SELECT node, b FROM reach JOIN links ON other = a),
comp AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)"""

_OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH},
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN comp ON node = vec_id
"""

_WINDOW = ", ".join(f"lead(w, {j}) OVER o" for j in range(1, 20))
_OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d),
windows AS (SELECT doc_id, k, lead(w, 19) OVER o AS last, concat_ws(' ', w, {_WINDOW}) AS win FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
again AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1 AS late FROM windows WHERE last IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM again WHERE late),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS kept FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM d) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = d.doc_id
"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op9() -> str:
    def norm(x: str) -> str:
        out = f"lower(coalesce({x}, ''))"
        for pattern, new in STEPS:
            out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(re.sub('[$]([0-9])', chr(92) + chr(92) + chr(92) + '1', new))}, 'g')"
        return out.replace("'\n'", "chr(10)")

    digest = r"sha256(trim(regexp_replace({}, '\s+', ' ', 'g')))"
    rows = [(t, i, "text") for i, ts in TEXTS.items() for t in ts] + [(t, i, "line") for i, ts in NOTICES.items() for t in ts]
    known = ", ".join("(" + ", ".join(map(_sql_text, r)) + ")" for r in rows)
    hashed = ", ".join("(" + ", ".join(map(_sql_text, (d, i, "text"))) + ")" for i, ds in DIGESTS.items() for d in ds)
    return f"""
WITH known AS (SELECT DISTINCT {digest.format(norm("t"))} AS digest, i AS license_id, kind FROM (VALUES {known}) v(t, i, kind)
               UNION SELECT * FROM (VALUES {hashed}) w(digest, license_id, kind)),
texts AS (SELECT digest, min(license_id) AS license_id FROM known WHERE kind = 'text' GROUP BY digest),
n AS (SELECT doc_id, {norm("text")} AS norm FROM documents),
lines AS (SELECT DISTINCT doc_id, sha256(trim(l)) AS digest FROM (SELECT doc_id, unnest(string_split(norm, chr(10))) AS l FROM n) t),
notices AS (SELECT doc_id, count(*) AS k, string_agg(license_id, ',' ORDER BY license_id) AS ids
            FROM (SELECT DISTINCT doc_id, license_id FROM lines JOIN known USING (digest) WHERE kind = 'line') t GROUP BY doc_id)
SELECT n.doc_id, {digest.format("norm")} AS digest, texts.license_id AS license_id,
       coalesce(k, 0) AS n_notices, coalesce(ids, '') AS notices
FROM n LEFT JOIN texts ON texts.digest = {digest.format("norm")} LEFT JOIN notices USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": _OP3, "op6_substring_dedup": _OP6, "op7_url_filter": _OP7,
        "op9_license_scan": _op9(), "op10_minhash_near_dedup": _OP10,
    }
