"""From documents to packed sequences: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); run() writes each result as Parquet in the shared checkpoint folder and reads
it again for the next. All but the last return the columns of documents. All but the first begin with shrink_heaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm import line_dedup, minhash, mixing, packing, toxicity
from quillbase.llm.common import checkpoint, shrink_heaps

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC_FROM or more go. The network learns from this stage's documents that have labels."""
    params = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, params, keep=tuple(docs.columns), name="__score")
    return scored.where(F.col("__score") < TOXIC_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to earlier ones go, and documents that lose every word by it; n_chars follows the text."""
    shrink_heaps(spark)
    out = line_dedup.deduplicated(docs, min_words=1)
    out = out.where((F.col("__n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("__n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, that of the least id."""
    shrink_heaps(spark)
    return minhash.deduplicated(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a document taken twice is two rows."""
    shrink_heaps(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    shrink_heaps(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]
#: SQL can't express a trained network or the packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs
