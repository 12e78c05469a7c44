"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: \x20 and \x09-\x0D; nothing else does.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A broadcast side may hold at most this many rows; beyond it a shuffled join is used.
BROADCAST_ROWS = 100_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder in the warehouse where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/millrace-kept"


#: Rows of whole texts that a Python worker should be handed at once.
TEXTS = 1000


def job(spark: SparkSession) -> None:
    """Settings for a job over whole texts, to be called where the job starts; operators change no settings.

    Python workers are handed TEXTS rows at once unless the session sets a number itself: Arrow's default of
    10,000 whole texts would take each worker hundreds of megabytes.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(TEXTS))


_KEPT: list[str] = []


def keep(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and rereads it: cuts lineage and survives lost executors. codec: Parquet's, else the session's.

    Results are lazy and read these tables, so they stay until release() or the end of the driver.
    """
    spark = df.sparkSession
    atexit.unregister(_at_end)
    atexit.register(_at_end, spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Deletes the tables kept so far, from number `since` on, but for the files that a DataFrame reads; call it when
    the results that were built on them are written."""
    files = but.inputFiles() if but is not None else []
    stay = [p for p in _KEPT[since:] if any(p.rsplit("/", 1)[-1] in f for f in files)]
    gone = [p for p in _KEPT[since:] if p not in stay]
    _KEPT[since:] = stay
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at_end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone before
        release(spark)


def kept() -> int:
    """How many tables are kept: the number to give to release() later."""
    return len(_KEPT)


def bounded(rows: DataFrame, label: str, h: str, most: int) -> DataFrame:
    """The rows of the `most` smallest hashes (h, of 60 bits) of each label, repeated rows once. Labels must be few.

    The number of a label's distinct hashes, estimated with map-side combining, gives a threshold that more than `most`
    of them lie below (six deviations and a quarter more), and only rows below it are told apart and
    ranked: no task gets a label's rows, however often one repeats.
    """
    aim = 1.25 * (most + 6 * most**0.5 + 20)
    tau = rows.groupBy(label).agg((F.lit(aim * float(1 << 60)) / F.approx_count_distinct(h, 0.02)).alias("__tau"))
    below = rows.join(F.broadcast(tau), label).where(F.col(h) <= F.col("__tau")).drop("__tau").distinct()
    ranked = below.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy(h, *[c for c in rows.columns if c not in (label, h)])))
    return ranked.where(F.col("__n") <= most).drop("__n")


def passages(text: Column, key: Column, most: int, size: int = 2_000) -> Column:
    """A text of up to `most` characters as it is; of a longer one, stretches of `size` characters from all over it, `most` characters in all,
    in order: those whose places have the smallest hashes with the key."""
    places = F.sequence(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)
    drawn = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))).alias("h"), i.alias("i")))), 1, max(1, most // size))
    taken = F.array_sort(F.transform(drawn, lambda x: x["i"]))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(F.transform(taken, lambda i: F.substring(text, i * size + 1, F.lit(size))), " "))


def within_budget(rows: DataFrame, label: str, text: str, order: list[str], budget: int) -> DataFrame:
    """Rows of each label, in order, as long as their texts and those before them hold at most `budget` characters; the first one always.
    A label must have few rows (see bounded())."""
    upto = F.sum(F.length(text)).over(Window.partitionBy(label).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__upto", upto).where((F.col("__upto") <= budget) | (F.col("__upto") == F.length(text))).drop("__upto")


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def partitions(spark: SparkSession, rows: int = 0, each: int = 100_000) -> int:
    """Groups to hash rows into: at least the session's shuffle partitions, at most `each` rows in one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def attach(rows: DataFrame, classes: DataFrame, key: str, size: str, parts: int = 1000) -> DataFrame:
    """Inner join of many rows to one class row per key, where a key may hold a third of all rows.

    Keys with more than 1/parts of the rows number fewer than `parts`, whatever the data: these
    classes are broadcast and their rows never shuffle. All other keys meet in a shuffled join.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(1, total // parts)
    often, rare = classes.where(hot), classes.where(~hot)
    keys = F.broadcast(often.select(key))
    return rows.join(F.broadcast(often), key).unionByName(rows.join(keys, key, "left_anti").join(rare, key))


def join_hubs(rows: DataFrame, table: DataFrame, key: str, hubs: DataFrame) -> DataFrame:
    """rows joined to table (one row a key). hubs: fewer than a thousand keys that hold many rows each; what belongs to
    these is broadcast, so no task gets a hub's rows."""
    few = F.broadcast(hubs.select(key))
    often = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key)
    return often.unionByName(rows.join(few, key, "left_anti").join(table, key))


def batches(texts: list[str | None], most: int):
    """Yields (start, stop) runs of texts that together stay near `most` characters (one text at least)."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges [start, start + length), one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if ends.size else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
