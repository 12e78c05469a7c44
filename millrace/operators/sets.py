"""Unions, differences and merges (U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import remap_keys


def union_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """All corpora with their name in `corpus`; columns that one lacks are null there."""
    named = [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def merge_caches(base: DataFrame, extra: DataFrame, base_voices: DataFrame, extra_voices: DataFrame, base_print: str, extra_print: str) -> DataFrame:
    """base and extra items (id, voice, width, tag): extra's voices renumbered, each item tagged with the merge it came by.

    Refused before anything is written if fingerprints or widths differ. The base's statistics stay in force.
    """
    if base_print != extra_print:
        raise ValueError(f"fingerprints differ: {base_print} and {extra_print}")
    widths = base.select("width").union(extra.select("width")).distinct().limit(3).collect()
    if len(widths) > 1:
        raise ValueError(f"token widths differ: {sorted(r['width'] for r in widths)}")
    mapped = remap_keys(extra, extra_voices, base_voices).drop("voice").withColumnRenamed("merged_voice", "voice")
    names = base.join(base_voices.select("voice", "name"), "voice")
    both = names.withColumn("side", F.lit("0")).unionByName(mapped.withColumn("side", F.lit("1")))
    return both.withColumn("tag", F.concat_ws(">", F.nullif("tag", F.lit("")), "side")).drop("side")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, whose evaluation fails if a key of it is in b."""
    hit = a.join(b.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    found = F.raise_error(F.concat(F.lit("held-out key in the corpus: "), F.col("__k").cast("string")))
    return hit.where(F.when(F.col("__k").isNotNull(), found.cast("boolean")).otherwise(True)).select(a.columns)


def difference(everything: DataFrame, val: DataFrame, key: str) -> DataFrame:
    return everything.join(val.select(key).distinct(), key, "left_anti")


def union_keys(*tables: DataFrame) -> DataFrame:
    """Distinct keys (trimmed, lower-cased) of one-column tables."""
    keys = [t.select(F.lower(F.trim(t.columns[0])).alias("key")) for t in tables]
    return reduce(DataFrame.union, keys).where("key <> ''").distinct()
