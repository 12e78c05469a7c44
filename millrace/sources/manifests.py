"""Scans and sinks (S)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import strip_markers
from millrace.operators.order import indexed

MANIFEST = (
    "utt_id string, text string, teacher string, voice string, wav_path string, sample_rate int, duration_s double, "
    "tags array<string>, license string, quality double, hash string, token_frames array<int>"
)


def read_manifest(spark: SparkSession, path: str, limit: int | None = None, schema: str = MANIFEST) -> DataFrame:
    """Records of a JSON-lines manifest; blank lines have no record. limit: the first so many by id. None at all is an error."""
    rows = spark.read.schema(schema).json(path).where("utt_id IS NOT NULL")
    if rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows if limit is None else rows.orderBy("utt_id").limit(limit)


def resolve_manifest(spark: SparkSession, folder: str, name: str | None = None) -> str:
    """The first of kept, curated/kept and manifest that exists, on any file system Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    tried = [name] if name else ["kept.jsonl", "curated/kept.jsonl", "manifest.jsonl"]
    for one in tried:
        found = path(f"{folder}/{one}")
        if found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
            return f"{folder}/{one}"
    raise FileNotFoundError(f"none of {tried} in {folder}")


def write_curation(df: DataFrame, out: str, report: DataFrame) -> None:
    """Kept and rejected records in folders of their own, and the report."""
    df.write.mode("overwrite").partitionBy("keep").parquet(f"{out}/records")
    report.write.mode("overwrite").json(f"{out}/report")


def write_shards(df: DataFrame, out: str, items: int = 500) -> DataFrame:
    """Writes files of at most so many items; returns the index (path, n)."""
    df.write.mode("overwrite").option("maxRecordsPerFile", items).parquet(out)
    return df.sparkSession.read.parquet(out).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))


def corpus_meta(df: DataFrame, mix: DataFrame) -> DataFrame:
    """One row: mix (name to weight), records and hours."""
    weights = mix.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "weight")))).alias("mix"))
    return df.agg(F.count("*").alias("n"), (F.coalesce(F.sum("duration_s"), F.lit(0.0)) / 3600).alias("hours")).crossJoin(weights)  # one row each


# The markers around a book's text.
BOOK_START, BOOK_END = "*** START OF THE PROJECT GUTENBERG", "*** END OF THE PROJECT GUTENBERG"


def read_books(spark: SparkSession, paths: str | list[str], start: str = BOOK_START, end: str = BOOK_END) -> DataFrame:
    """(path, text): whole files without header and footer."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", strip_markers(F.col("value"), start, end).alias("text"))


def parse_wav(data: bytes, max_seconds: float | None = None) -> tuple[int, np.ndarray]:
    """(sample rate, samples in -1 to 1) of 16-bit PCM; channels are averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate, channels = 12, 0, 1
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            channels, rate = int.from_bytes(data[at + 10 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 16], "little")
        elif kind == b"data":
            x = np.frombuffer(data, "<i2", min(size, len(data) - at - 8) // 2, at + 8)
            x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1) / 32768
            return rate, x if max_seconds is None else x[: int(max_seconds * rate)]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode_waves(files: DataFrame, max_seconds: float | None = None) -> DataFrame:
    """files: path, content. (path, sample_rate, wav); what can't be read has a null signal."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rates, waves = [], []
            for data in batch.column(1):
                try:
                    rate, wav = parse_wav(data.as_py() or b"", max_seconds)
                except ValueError:
                    rate, wav = None, None
                rates.append(rate)
                waves.append(wav)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates, pa.int32()), pa.array(waves, pa.list_(pa.float32()))], names=["path", "sample_rate", "wav"])

    return files.select("path", "content").mapInArrow(run, "path string, sample_rate int, wav array<float>")


def load_waves(spark: SparkSession, path: str, max_seconds: float | None = None) -> DataFrame:
    """(path, sample_rate, wav) of the WAV files under a path."""
    return decode_waves(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path), max_seconds)


def rebuild_manifest(files: DataFrame, texts: DataFrame, voices: list[str]) -> DataFrame:
    """files: path; texts: idx, text. Records of files whose name holds the number of a text; voice is number mod voices."""
    idx = F.nullif(F.regexp_extract("path", r"(\d+)[^/\d]*$", 1), F.lit("")).cast("bigint")
    voice = F.element_at(F.array(*map(F.lit, voices)), (F.col("idx") % len(voices) + 1).cast("int"))
    return files.withColumn("idx", idx).join(texts, "idx").withColumn("voice", voice)


def merge_shards(shards: list[DataFrame], fail: bool = True) -> DataFrame:
    """All shards' records with ids s{i}_… and paths shard{i}/…; a repeated id is an error, or dropped."""
    parts = [df.withColumn("utt_id", F.concat(F.lit(f"s{i}_"), "utt_id")).withColumn("wav_path", F.concat(F.lit(f"shard{i}/"), "wav_path")) for i, df in enumerate(shards)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    twice = out.groupBy("utt_id").count().where("count > 1")
    if fail and not twice.isEmpty():
        raise ValueError(f"repeated ids: {[r[0] for r in twice.limit(5).collect()]}")
    return out if fail else out.dropDuplicates(["utt_id"])


def shard_prompts(df: DataFrame, key: str, n: int) -> DataFrame:
    """Adds shard: the row's place by key, modulo n."""
    return indexed(df, key, "__i").withColumn("shard", F.pmod("__i", F.lit(n))).drop("__i")


def rebase_paths(df: DataFrame, root: str, base: str) -> DataFrame:
    """wav_path relative to base, for a corpus under root; the root is kept in corpus_root."""
    prefix = root.removeprefix(base).strip("/")
    return df.withColumn("wav_path", F.concat(F.lit(f"{prefix}/" if prefix else ""), F.regexp_replace("wav_path", "^/+", ""))).withColumn("corpus_root", F.lit(root))


def evidence_manifest(claims: DataFrame, files: DataFrame) -> DataFrame:
    """claims: claim, path; files: path, content. (claim, path, status, sha256): copied where the file is there."""
    joined = claims.join(files.select("path", F.sha2("content", 256).alias("sha256")), "path", "left")
    status = F.when(F.col("path").isNull(), "no_source").when(F.col("sha256").isNull(), "retained").otherwise("copied")
    return joined.select("claim", "path", status.alias("status"), "sha256")
