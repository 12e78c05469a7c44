"""The library's records over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.store import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, voice, source, dim, value: embeddings in long form; a vector's number stands for its source."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("utt"), F.col("label").alias("voice"), (F.col("vec_id") % 2).alias("source"), F.posexplode("embedding").alias("dim", "v")).select("utt", "voice", "source", "dim", F.col("v").cast("double").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, voice, dim, frame, value: a vector as eight dimensions of eight frames."""
    long = frames(spark, sf_dir)
    return long.select("utt", "voice", (F.col("dim") % 8).alias("dim"), F.floor(F.col("dim") / 8).alias("frame"), "value")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus records of documents: 15 characters a second stand for the duration, labels for the score."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("mos"))
    rows = docs.join(labels, "doc_id", "left")
    return rows.select("doc_id", F.col("source").alias("teacher"), F.col("lang").alias("voice"), "text", (F.length("text") / 150.0).alias("duration_s"), "mos")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, start, end, word: events as timed words; an event lasts a twentieth of the hour in seconds by its value."""
    ev = table(spark, sf_dir, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start")
    return ev.select(F.col("user_id").alias("key"), "event_id", start, F.col("event_type").alias("word"), "value")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the driver ends."""
    return new_folder(spark, "plans")
