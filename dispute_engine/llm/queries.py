"""Registered queries of this package, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (binary_output, bpe, exact, jaccard, langid, lexical, lm_scoring, packing, quality, sharding, toxicity,
               urls, whitening)
from .shared import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), urls.rules_frame(spark))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(spark, _table(spark, sf_dir, "documents"))


def op7_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    binary_output.write_ids(_table(spark, sf_dir, "documents"), path)
    return binary_output.read_ids(spark, path)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(spark, _table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), TREE, sharding.grown(TREE))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The 16 shards of op12: two regions of two racks of four shards, equal weights.
TREE = sharding.layout(16)

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_url_filters": op5_url_filters,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_binary_output": op7_binary_output,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}

URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path
  FROM cut)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'block'
       WHEN (host = 'net' OR host LIKE '%.net') AND (path LIKE '/es/%' OR path LIKE '/fr/%') THEN 'block'
       ELSE 'allow' END AS verdict
FROM split"""

EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s) AS n, sha256(array_to_string(list_sort(s), chr(10))) AS class FROM sets),
classes AS (SELECT class, min(doc_id) AS id, any_value(s) AS s, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY class),
elements AS (SELECT id, n, unnest(s) AS e FROM classes),
pairs AS (
  SELECT a.id AS x, b.id AS y FROM elements a JOIN elements b ON a.e = b.e AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT id, id AS found FROM classes UNION SELECT r.id, l.y FROM reach r JOIN links l ON r.found = l.x),
lowest AS (SELECT id, min(found) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM sized d LEFT JOIN classes c ON d.class = c.class LEFT JOIN lowest l ON c.id = l.id"""

ORACLES = {
    "op5_url_filters": URL_SQL,
    "op6_exact_dedup": EXACT_SQL,
    "op9_jaccard_join": JACCARD_SQL,
    "op12_sharding": sharding.sql_of(TREE, sharding.grown(TREE)),
    "op13_lexical_search": lexical.SQL,
}
