"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, exact_dedup, mixing, simhash, toxicity
from millrace.llm.common import job, keep, kept, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the model is fitted on all labelled documents it may sample."""
    job(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.judged(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles."""
    job(spark)
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken twice is two rows."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, their number, and whether decoding them gives the text again."""
    job(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.withColumn("doc", F.struct("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")))
    out = bpe.round_trip(rows, path, public_tokenizers.PATTERN, id_col="doc")
    return out.select("doc.doc_id", "doc.source", F.size("ids").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("doc.sha")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: The toxicity model and SimHash can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written and reread as the next one's docs.

    A stage's intermediate tables and its predecessor's rows are deleted once its own rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = kept()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since=start, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
