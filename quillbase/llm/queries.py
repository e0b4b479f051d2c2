"""Queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, html_extract, language_id, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_line_dedup(spark, sf_dir):
    out = line_dedup.deduplicated(_read(spark, sf_dir, "documents"), min_words=1)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op4_minhash(spark, sf_dir):
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op6_html_extract(spark, sf_dir):
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op7_language_id(spark, sf_dir):
    return language_id.language_id(_read(spark, sf_dir, "documents"))


def op8_embeddings(spark, sf_dir):
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality_classifier, op3_line_dedup, op4_minhash, op5_quality_rules, op6_html_extract, op7_language_id, op8_embeddings, op9_toxicity, op10_packing)}

#: SQL of the same result from sizes, by sorting; the query itself uses histograms.
MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM v) = 0 THEN most ELSE least(most, (SELECT level FROM v) * weight) END AS target FROM l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
r AS (SELECT *, greatest(0.0, target - times * source_size) AS rest FROM k),
c AS (SELECT d.doc_id, d.size, d.h, r.source_size, r.target, r.times, r.rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (times + CASE WHEN rest > 0 AND (upto < rest OR (upto - own < rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
ORACLE_SQL: dict[str, str] = {"op1_mixing": MIXING_SQL}
