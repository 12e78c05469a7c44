"""Importance resampling towards a target distribution, with hashed n-gram features in Arrow kernels.

A text is lower-cased (A-Z only) and split at every run of ASCII characters other than letters and digits; features are all
runs of `low` to `high` consecutive words, joined by one blank. Words are dictionary-encoded a batch at a time, n-grams are shifted
dictionary indices, and only distinct n-grams are hashed: the CRC-32 of a longer one goes on from that of its beginning. A feature's bucket
is its CRC modulo `buckets`. A bucket's gain is floor(1000 ln of the ratio of its smoothed shares in the target and in the
corpus); a document's weight is the sum of its features' gains. Adding Gumbel noise to the weights and taking the highest
scores draws without replacement in proportion to exp(weight / 1000).

The corpus is read twice: once for the buckets' counts (a task adds up its own, so `buckets` rows a task move), once
for the weights. The only broadcast is the gain of each bucket. Ranks come from one sort by ranges of the rows that may be
drawn: a lower bound on the last score drawn is found first, so about the share drawn is sorted, and no range is one key's,
as rows are numbered.

Rules: null text has no words. A null id is hashed as an empty string and comes after all ids in ties; repeated rows are rows of their own. Rows
with equal score and id are ranked by features, then arbitrarily (they are alike). Only documents of at least `least` words are drawn. Empty tables
give empty results; without a target text all buckets have the gain of a count of zero. Only id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import batches, keep, partitions

#: Between words: all ASCII characters other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters handled at once.
SLICE = 2_000_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(the words in order as dictionary indices, the dictionary, each text's words)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    coded = pc.filter(flat, real).dictionary_encode()
    doc = pc.filter(doc, real).to_numpy(zero_copy_only=False)
    dictionary = [w.encode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), dictionary, np.bincount(doc, minlength=len(texts))


def feature_buckets(texts: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each feature's bucket, its text's number, each text's words). Features of one length follow one another in order."""
    index, dictionary, sizes = words_of(texts)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(index))  # words from here to the text's end
    doc = np.repeat(np.arange(len(sizes)), sizes)
    gram, crc = index, np.fromiter(map(zlib.crc32, dictionary), np.int64, len(dictionary))
    found, owner = [], []
    for n in range(1, high + 1):
        if n > 1:  # the grams of n - 1 words, each with the word after it
            fits = left >= n
            at = np.flatnonzero(fits)
            pairs = np.full(len(index), -1, np.int64)
            pairs[at] = gram[at] * max(1, len(dictionary)) + index[at + n - 1]
            distinct, back = np.unique(pairs[at], return_inverse=True)
            first, last = np.divmod(distinct, max(1, len(dictionary)))
            crc = np.fromiter((zlib.crc32(b" " + dictionary[w], c) for c, w in zip(crc[first].tolist(), last.tolist())), np.int64, len(distinct))
            gram = np.full(len(index), -1, np.int64)
            gram[at] = back
        if n >= low:
            at = np.flatnonzero(left >= n)
            found.append(np.take(crc, gram[at]) % buckets)
            owner.append(doc[at])
    return np.concatenate(found), np.concatenate(owner), sizes


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for start, stop in batches(texts.to_pylist(), SLICE):
        yield start, texts.slice(start, stop - start)


def bucket_counts(docs: DataFrame, low: int = 1, high: int = 2, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, n): the features of all texts in each bucket that has any."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in it:
            for _, texts in _slices(batch.column(0)):
                total += np.bincount(feature_buckets(texts, low, high, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain, from bucket_counts() of both; `buckets` numbers in all."""
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = s.join(t, "bucket", "full_outer").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()
    counts = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    all_s, all_t = sum(r.s for r in both), sum(r.t for r in both)
    known = corpus.sparkSession.createDataFrame([(r.bucket, r.s, r.t) for r in both], "bucket bigint, s bigint, t bigint")
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1.0) * F.lit(float(all_s + buckets)) / ((s + 1.0) * F.lit(float(all_t + buckets)))
    rows = counts.join(F.broadcast(known), "bucket", "left").select("bucket", F.floor(1000.0 * F.log(ratio)).cast("bigint").alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.gain for r in rows]
    return out


def weighted(docs: DataFrame, gain: np.ndarray, low: int = 1, high: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            out = np.zeros((3, batch.num_rows), np.int64)
            for start, texts in _slices(batch.column(1)):
                bucket, doc, words = feature_buckets(texts, low, high, len(own))
                order = np.argsort(doc, kind="stable")
                sizes = np.bincount(doc, minlength=len(texts))
                upto = np.concatenate([[0], np.cumsum(np.take(own, bucket[order]))])
                ends = np.cumsum(sizes)
                out[:, start : start + len(texts)] = sizes, words, upto[ends] - upto[ends - sizes]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, n_features bigint, n_words bigint, weight bigint")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """rows (score, id, n_features, node) in that order, score falling: adds rank to the first `most`."""
    order = [F.desc("score"), F.asc_nulls_last("id"), "n_features", "node"]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession, most), *order).withColumn("part", F.spark_partition_id())
    dealt = keep(dealt, "importance-ranges")  # written: rows keep their range
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    placed = dealt.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.withColumn("rank", F.when(rank <= most, rank)).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), low: int = 1, high: int = 2, buckets: int = 10_000, least: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_features, n_words, weight, score, rank (from 1; null where the row isn't drawn).

    share: numerator and denominator of the share of eligible rows to draw. target: texts in a column of the same name.
    """
    gain = gains(bucket_counts(docs, low, high, buckets, text_col), bucket_counts(target, low, high, buckets, text_col), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted(docs, gain, low, high, id_col, text_col).withColumn("score", F.col("weight") + noise.cast("bigint")).withColumn("node", F.monotonically_increasing_id())
    scored = keep(scored, "importance-scores")
    able = F.col("n_words") >= least
    n = scored.where(able).count()
    most = share[0] * n // share[1]
    # The sketch's rank is off by less than n / 10,000, so at least `most` rows lie at or above this score.
    floor = scored.where(able).agg(F.percentile_approx("score", max(0.0, 1 - most / n - 0.0005), 10_000)).first()[0] if most else None
    near = able & (F.col("score") >= F.lit(floor)) if most else F.lit(False)
    columns = ["id", "n_features", "n_words", "weight", "score", "node"]
    rest = scored.where(~near).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    out = rest.unionByName(_ranked(scored.where(near).select(*columns), most)) if most else rest
    return out.select(F.col("id").alias(id_col), "n_features", "n_words", "weight", "score", F.col("rank").cast("bigint").alias("rank"))
