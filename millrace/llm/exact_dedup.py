"""Exact deduplication against a minimal perfect hash over the digests seen so far.

The history's distinct digests are dealt to shards by hash. Each shard builds a minimal perfect hash:
levels of bits, where a key that is alone at its position in a level is placed there and the others go
on to the next level; its slot is the number of set bits before it. A slot holds the full 32-byte digest,
the winner's id and the copies so far. Incoming rows are grouped by digest before they move, then looked
up: the slot's digest is compared byte for byte, so a nonmember that lands on a used slot is told apart.
Members are repeats; nonmembers form groups of their own.

Rules: null text counts as empty; texts are equal when identical after lower-casing A-Z; the largest id
of a group wins. Rows with a null id never win over another id; a group of such rows alone has a null
winner and keeps all. Repeated rows with one id count apart and are kept or dropped together. Empty tables
give empty results. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, attach, keep, mix64, partitions, small

NO_ID = -(2**63)
SLOTS = "shard int, sizes array<int>, bits binary, digests binary, winners array<bigint>, copies array<bigint>"
CLASSES = "digest binary, keep_id bigint, group_size bigint, seen_before boolean"


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(text_digest(F.col(text_col))).alias("digest"))


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = np.full(len(keys), level * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for word in range(keys.shape[1]):
        mixed = mix64(mixed ^ keys[:, word])
    return (mixed % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """keys: distinct, n x 4 of uint64. Returns each key's slot (0 to n-1, all different) and the levels' bits."""
    levels, slots, alive, placed = [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while alive.size:
        size = max(8, -(-2 * alive.size // 8) * 8)
        at = _positions(keys[alive], len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        ok = bits[at]
        slots[alive[ok]] = placed + np.cumsum(bits)[at[ok]] - 1
        levels.append(bits)
        placed += int(bits.sum())
        alive = alive[~ok]
    return slots, levels


def find_slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each key; a key that was not built in gets some slot or -1."""
    out, alive, placed = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        at = _positions(keys[alive], level, bits.size)
        ok = bits[at]
        out[alive[ok]] = placed + np.cumsum(bits)[at[ok]] - 1
        placed += int(bits.sum())
        alive = alive[~ok]
    return out


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _build(rows: pa.Table) -> pa.Table:
    keys = _keys(rows["digest"])
    slots, levels = build_mph(keys)
    order = np.argsort(slots)
    return pa.table(
        {
            "shard": pa.array([rows["shard"][0].as_py()], pa.int32()),
            "sizes": pa.array([[x.size for x in levels]], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
            "digests": pa.array([keys[order].tobytes()], pa.binary()),
            "winners": pa.array([rows["winner"].to_numpy()[order]], pa.list_(pa.int64())),
            "copies": pa.array([rows["copies"].to_numpy()[order]], pa.list_(pa.int64())),
        }
    )


def _grouped(hashed: DataFrame, shards: int) -> DataFrame:
    """One row per digest; Spark combines on the map side, so a hot digest moves once per task."""
    rows = hashed.groupBy("digest").agg(F.coalesce(F.max("id"), F.lit(NO_ID)).alias("winner"), F.count("*").alias("copies"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def history_slots(hashed: DataFrame, shards: int) -> DataFrame:
    """The index over digests(): one row per shard. It can be stored and looked up by later batches."""
    return _grouped(hashed, shards).groupBy("shard").applyInArrow(_build, SLOTS)


def _look_up(rows: pa.Table, slots: pa.Table) -> pa.Table:
    new = _keys(rows["digest"])
    winners, copies = (rows[c].to_numpy().copy() for c in ("winner", "copies"))
    old, keep_id, size = np.zeros((0, 4), "<u8"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(new), bool)
    if slots.num_rows:
        old = np.frombuffer(slots["digests"][0].as_py(), "<u8").reshape(-1, 4)
        keep_id, size = (slots[c].combine_chunks().values.to_numpy().copy() for c in ("winners", "copies"))
        sizes = slots["sizes"][0].as_py()
        bits = np.unpackbits(np.frombuffer(slots["bits"][0].as_py(), np.uint8)).astype(bool)
        at = find_slots(new, np.split(bits, np.cumsum(sizes)[:-1]))
        fresh = (at < 0) | (old[at] != new).any(axis=1)
        hit = at[~fresh]
        keep_id[hit] = np.maximum(keep_id[hit], winners[~fresh])
        size[hit] += copies[~fresh]
    all_keys = np.concatenate([old, new[fresh]])
    ids = np.concatenate([keep_id, winners[fresh]])
    raw = all_keys.tobytes()
    return pa.table(
        {
            "digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()),
            "keep_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
            "group_size": pa.array(np.concatenate([size, copies[fresh]]), pa.int64()),
            "seen_before": pa.array(np.arange(len(ids)) < len(old)),
        }
    )


def classify(hashed: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """Every digest of the index and of the incoming digests(): its winner, copies and whether history had it."""
    rows = _grouped(hashed, shards)
    return rows.groupBy("shard").cogroup(slots.groupBy("shard")).applyInArrow(_look_up, CLASSES)


def exact_dedup(incoming: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of history and incoming: id_col, keep_id, group_size, kept, text_sha256, seen_before.

    seen_before: a row of history has this text.
    """
    rows, classes = _classified(incoming, history, id_col, text_col)
    return attach(rows, classes, "digest", "group_size").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "seen_before",
    )


def _classified(incoming: DataFrame, history: DataFrame | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of every row of history and incoming, and the CLASSES of the digests."""
    spark = incoming.sparkSession
    old = digests(incoming.limit(0) if history is None else history, id_col, text_col).withColumn("old", F.lit(True))
    rows = keep(old.unionByName(digests(incoming, id_col, text_col).withColumn("old", F.lit(False))), "digests")
    shards = partitions(spark, rows.count())
    past, new = rows.where("old").drop("old"), rows.where("NOT old").drop("old")
    classes = keep(classify(new, history_slots(past, shards), shards), "classes")
    return rows.drop("old"), classes


def split_by_age(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(history, incoming): the lower and the upper half of the id range; rows without an id are incoming."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    past = F.coalesce(F.col(id_col) <= F.lit(0 if low is None else (low + high) // 2), F.lit(False))
    return docs.where(past), docs.where(~past)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest id (null last); columns unchanged.

    A row goes if its group has another winner. Where several rows have the winner's id (a repeated id, or none at
    all), the first of them by content stays, after each task has chosen its own. Only rows of groups of two or more are
    looked at, by digest and id, and texts don't move unless these are too many to broadcast.
    """
    past, new = split_by_age(docs, id_col)
    rows, classes = _classified(new, past, id_col, text_col)
    found = attach(rows, classes.where("group_size > 1").select("digest", "keep_id", "group_size"), "digest", "group_size")
    pairs = found.groupBy("digest", "id").agg(F.first("keep_id").alias("keep_id"), F.count("*").alias("n"))
    pairs = pairs.select(F.col("digest").alias("d"), F.col("id").alias("i"), F.col("id").eqNullSafe(F.col("keep_id")).alias("won"), "n")
    odd = keep(pairs.where("n > 1 OR NOT won"), "exact-odd")
    many = odd.count()
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), F.unhex(text_digest(F.col(text_col))).alias("digest"))
    same = (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i"))
    rest = marked.join(small(odd, many), same, "left_anti")
    several = marked.join(small(odd.where("won"), many), same, "left_semi").groupBy("digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return rest.select("row").unionByName(several.select("row")).select("row.*")
