"""Sorts, limits, top-k and samples (L). Samples are by hash, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.aggregates import spread_summary
from millrace.operators.order import indexed


def head(df: DataFrame, n: int, *rank: str) -> DataFrame:
    return df.orderBy(*rank).limit(n)


def top_groups(df: DataFrame, key: str, k: int = 6) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def select_row(df: DataFrame, measure: str | None = None, where: Column | None = None, order: str = "id") -> DataFrame:
    """The row with the largest measure, or the first row by order that meets a condition."""
    df = df if where is None else df.where(where)
    every = F.struct(*df.columns)
    best = F.min_by(every, F.col(order)) if measure is None else F.max_by(every, F.struct(F.col(measure), -F.col(order)))
    return df.agg(best.alias("r")).where("r IS NOT NULL").select("r.*")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows at most: the first in hash order (a top-k, not a sort)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("__h", h).orderBy("__h", id_col).limit(n).drop("__h")


def every_kth(df: DataFrame, key: str, k: int, *ties: str) -> DataFrame:
    """Every k-th row by key, from the first."""
    return indexed(df, key, "__i", ties=ties).where(F.col("__i") % k == 0).drop("__i")


def first_variant(df: DataFrame, options: Column, n: int, order: str) -> DataFrame:
    """Rows with a variant, with the first one, n rows at most by order."""
    return df.withColumn("variant", F.when(F.size(options) > 0, F.element_at(options, F.when(F.size(options) > 0, 1)))).where("variant IS NOT NULL").orderBy(order).limit(n)


def order_by_step(df: DataFrame, name: str, latest: int) -> DataFrame:
    """Rows whose name holds a number, the `latest` largest steps, in order of the step."""
    step = F.regexp_extract(name, r"(\d+)(?!.*\d)", 1)
    return df.withColumn("step", F.nullif(step, F.lit("")).cast("bigint")).where("step IS NOT NULL").orderBy(F.desc("step"), name).limit(latest).orderBy("step", name)


def best_row(df: DataFrame, key: str, metric: str, largest: bool = True) -> DataFrame:
    """By key, the row with the best metric; rows without one come last."""
    m = F.coalesce(F.col(metric), F.lit(-9.9e99 if largest else 9.9e99))
    rest = F.struct(*[c for c in df.columns if c != key])
    pick = F.max_by(rest, m) if largest else F.min_by(rest, m)
    return df.groupBy(key).agg(pick.alias("r")).select(key, "r.*")


def sweep(df: DataFrame, setting: str, value: str = "value", largest: bool = True) -> DataFrame:
    """(setting, mean, std, min, max, n, straddles_zero, verdict, best): a sweep's settings over their seeds, and the one of the best mean (the
    smallest setting of equals). A setting's mean less and plus its deviation tells it from zero or doesn't."""
    by = spread_summary(df, [setting], value)
    order = F.struct(F.when(F.isnan("mean") | F.col("mean").isNull(), 1).otherwise(0).alias("none"), (-F.col("mean") if largest else F.col("mean")).alias("m"), F.col(setting).alias("s"))
    top = by.agg(F.min(order).alias("t"))
    verdict = F.when(F.col("straddles_zero"), "indistinguishable from zero").otherwise("clear of zero")
    return by.withColumn("verdict", verdict).crossJoin(F.broadcast(top)).withColumn("best", F.col(setting).eqNullSafe(F.col("t.s"))).drop("t")  # one row
