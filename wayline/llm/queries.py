"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import alignment, exact_dedup, filter_audit, html_extract, langid, minhash, mixing, nbest, packing, prefix_tokens, quality, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.token_counts(table(spark, sf_dir, "documents"))


def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_block_labels": op2_block_labels,
        "op3_ppm_language": op3_ppm_language,
        "op4_pairwise_quality": op4_pairwise_quality,
        "op5_simhash_groups": op5_simhash_groups,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_minhash_fingerprints": op7_minhash_fingerprints,
        "op8_subword_toxicity": op8_subword_toxicity,
        "op9_prefix_token_counts": op9_prefix_token_counts,
        "op10_nbest_pieces": op10_nbest_pieces,
        "op11_token_alignment": op11_token_alignment,
        "op12_filter_audit": op12_filter_audit,
        "op13_window_packing": op13_window_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op12_filter_audit": OP12_SQL}


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

OP12_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), f AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
  FROM w
), v AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails FROM f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l p, l q, l r, l s, l u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), n AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM v GROUP BY ALL
), k AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
h AS (
  SELECT n.*, filter_order, step, fails[ascii(filter_order[step]) - 64] AS now,
    len(list_filter(range(1, step), lambda s: fails[ascii(filter_order[s]) - 64])) > 0 AS before, len(list_filter(fails, lambda y: y)) AS many
  FROM n, k
), r AS (
  SELECT part, filter_order, step, filter_order[step] AS filter,
    sum(CASE WHEN NOT now AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN now AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN now AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN now AND many = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN now AND NOT before AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN now AND NOT before AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM h GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
