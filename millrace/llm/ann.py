"""Approximate nearest neighbours with a forest of random-projection trees.

Fitting: each tree splits a bounded sample of the vectors, level by level, by a hyperplane half-way between
two of a node's vectors drawn at random, until a leaf stands for `leaf` of the table's rows. The forest's size
is bounded by the sample, so it is broadcast.
Index: every distinct vector goes down every tree; (tree, leaf) is its place. Equal vectors are one entry with
their k + 1 smallest ids, which is all that k answers besides the query itself can need.
A leaf's rows are counted; one with more than TILE of them is cut into tiles.
Search: all trees share one priority queue. From the roots on, the queue gives the node with the largest
margin so far (the smaller of its parent's and the query's signed distance to the split), whose far side
joins the queue; a query ends when the leaves reached hold a given share of all rows. Queries of equal vectors are one.
Rerank: a tile of a leaf's entries and a tile of the queries that reached the leaf meet in one group. A matrix product gives
distances that are off by rounding; every entry that the bound of this error can't tell from the k nearest goes on
to the exact distance in double precision, so ties are settled by id alone. The best of all tiles follow by a window per query.

Rules: vectors that are null, empty, of another size than most, all zero, or hold null or non-finite components
take no part, as queries or as candidates. A row is never its own answer, but rows of equal vector are, and so are other rows of
its id. Ties go to the smaller id; rows with a null id take no part; every row counts, whatever its id or vector. Other columns
are not read. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import attach, keep, partitions, small

TILE = 16_384  #: entries of a leaf that one group reranks
PROBES = 16_384  #: queries of a leaf that one group reranks


@dataclass
class Forest:
    """Node i of tree t: its hyperplane (normal, offset) and children; a leaf's children are -1."""

    normal: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    weight: np.ndarray  #: rows that a leaf holds

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.repeat(self.roots[None, :], len(vectors), axis=0)
        for t in range(len(self.roots)):
            node = out[:, t]
            inner = np.flatnonzero(self.left[node] >= 0)
            while inner.size:
                at = node[inner]
                side = np.einsum("ij,ij->i", vectors[inner], self.normal[at]) > self.offset[at]
                node[inner] = np.where(side, self.right[at], self.left[at])
                inner = inner[self.left[node[inner]] >= 0]
            out[:, t] = node
        return out

    def search(self, vector: np.ndarray, rows: float) -> list[int]:
        """Leaves in the order in which the shared queue gives them, until they stand for so many rows."""
        margins = self.normal @ vector - self.offset
        queue = [(-np.inf, int(r)) for r in self.roots]
        heapq.heapify(queue)
        found, held = [], 0.0
        while queue and held < rows:
            bound, node = heapq.heappop(queue)
            while self.left[node] >= 0:
                m = margins[node]
                near, far = (self.right[node], self.left[node]) if m > 0 else (self.left[node], self.right[node])
                heapq.heappush(queue, (max(bound, abs(m)), int(far)))
                node = int(near)
            found.append(node)
            held += self.weight[node]
        return found


def fit(sample: np.ndarray, rows: int, trees: int, leaf: int, seed: int = 11) -> Forest:
    """rows: of the table that the sample stands for."""
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    each = rows / max(1, n)
    most = max(2, int(leaf / each))
    normal, offset, left, right, weight, roots = [], [], [], [], [], []

    def add() -> int:
        for column, value in ((normal, np.zeros(dim, np.float32)), (offset, 0.0), (left, -1), (right, -1), (weight, 0.0)):
            column.append(value)
        return len(left) - 1

    for _ in range(trees):
        roots.append(add())
        todo = [(roots[-1], np.arange(n))]
        while todo:
            node, own = todo.pop()
            weight[node] = len(own) * each
            if len(own) <= most:
                continue
            a, b = sample[rng.choice(own, 2, replace=False)]
            v = a - b
            v /= np.linalg.norm(v) + 1e-30
            side = sample[own] @ v
            cut = float(np.median(side))  # both sides alike large
            if not (side > cut).any():
                continue
            normal[node], offset[node], left[node], right[node] = v, cut, add(), add()
            todo += [(left[node], own[side <= cut]), (right[node], own[side > cut])]
    return Forest(np.array(normal, np.float32).reshape(-1, dim), np.array(offset), np.array(left), np.array(right), np.array(roots), np.array(weight))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part, v as array<float> or array<double>."""
    kind = rows.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(a: np.ndarray, b: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """(row of a, id, distance): the first three of nearest_rows()."""
    return [x[:3] for x in nearest_rows(a, b, ids, k)]


def nearest_rows(a: np.ndarray, b: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float, int, int]]:
    """(row of a, id, distance, row of b, place of the id): the ids of the k + 1 rows of b nearest to each row of a, by exact distance
    and smallest id; a row of b stands for all of its ids."""
    out: list[tuple[int, int, float, int, int]] = []
    if not len(b):
        return out
    low, most = np.array([x[0] for x in ids]), min(len(b), k + 1)
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    # Each of the three terms is a sum of dim products: its rounding error is under dim + 2 units of its size's bound.
    unit = 4 * (a.shape[1] + 4) * np.finfo(np.float64).eps
    step = max(1, 4_000_000 // len(b))
    for start in range(0, len(a), step):
        part, part2 = a[start : start + step], a2[start : start + step]
        near = part2[:, None] - 2 * (part @ b.T) + b2[None, :]
        error = unit * (part2[:, None] + b2[None, :])
        cut = np.partition(near + error, most - 1, axis=1)[:, most - 1]
        for i in range(len(part)):
            at = np.flatnonzero(near[i] - error[i] <= cut[i])
            exact = np.sqrt(((part[i] - b[at]) ** 2).sum(axis=1))
            for j in np.lexsort((low[at], exact))[:most]:
                out += [(start + i, own, float(exact[j]), int(at[j]), p) for p, own in enumerate(ids[at[j]])]
    return out


def search(
    rows: DataFrame,
    is_query,
    k: int = 10,
    trees: int = 4,
    leaf: int = 512,
    search_share: float = 1.2,
    sample_rows: int = 20_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found for each row of is_query
    (a condition on the id, as column `id`). search_share: the rows that the leaves searched
    stand for (a row counts once a tree), as a share of all; structured vectors need far less."""
    spark = rows.sparkSession
    table = keep(usable(rows, id_col, vec_col).withColumn("key", F.sha2(F.to_json(F.struct("v")), 256)), "ann")
    per = Window.partitionBy("key").orderBy("id")
    # The limit on the rank is applied before the shuffle, too, so a hot vector moves k + 1 ids a task.
    few = table.withColumn("n", F.row_number().over(per)).where(F.col("n") <= k + 1)
    distinct = few.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = keep(distinct, "ann-distinct")
    n = distinct.count()
    queries = table.where(is_query).select("id", "key")
    asked = queries.groupBy("key").agg(F.count("*").alias("asked"))
    first = distinct.orderBy("key").limit(sample_rows).select("v").toPandas()["v"]  # by hash: a bounded sample
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = np.stack(first.to_list()).astype(np.float64)
    kind = distinct.schema["v"].dataType.simpleString()
    dim = sample.shape[1]
    forest = fit(sample, n, trees, min(leaf, max(16, n // 32)))
    shared = spark.sparkContext.broadcast(vars(forest))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(**shared.value)
        for batch in it:
            at = forest.leaves(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at.astype(np.int32)), pa.list_(pa.int32()))], names=["key", "v", "ids", "leaves"])

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(**counted.value)
        for batch in it:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                at = [forest.search(v, search_share * n) for v in _matrix(part.column(1), dim)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.list_(pa.int32()))], names=["key", "v", "leaves"])

    def tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(**shared.value)
        total = np.zeros(len(forest.left), np.int64)
        for batch in it:
            total += np.bincount(forest.leaves(_matrix(batch.column(0), dim)).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["leaf", "n"])

    # A forest has at most twice as many nodes as the sample has rows, in each tree.
    held = {r["leaf"]: r["n"] for r in distinct.select("v").mapInArrow(tally, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    for node, rows_held in held.items():
        forest.weight[node] = rows_held
    large = spark.createDataFrame([(node, -(-m // TILE)) for node, m in held.items() if m > TILE], "leaf int, tiles int")
    large = small(large, len(held))
    counted = spark.sparkContext.broadcast(vars(forest))

    reached = keep(distinct.join(asked, "key").select("key", "v").mapInArrow(probe, f"key string, v {kind}, leaves array<int>"), "ann-probes")
    # Queries by leaf: a row a node of the forest at most.
    asking = {r["leaf"]: r["n"] for r in reached.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    crowded = spark.createDataFrame([(node, -(-m // PROBES)) for node, m in asking.items() if m > PROBES], "leaf int, crowds int")
    crowded = small(crowded, len(asking))

    def tiled(df: DataFrame, tile: Column, crowd: Column) -> DataFrame:
        parts = df.join(large, "leaf", "left").join(crowded, "leaf", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("crowds", F.coalesce("crowds", F.lit(1)))
        return parts.withColumn("tile", tile).withColumn("crowd", crowd)

    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = distinct.select("key", "v", "ids").mapInArrow(place, f"key string, v {kind}, ids array<bigint>, leaves array<int>")
    index = tiled(index.select(F.explode("leaves").alias("leaf"), "key", "v", "ids"), part("tiles"), every("crowds"))
    index = index.select("leaf", "tile", "crowd", F.xxhash64("key").alias("entry"), "v", "ids")
    probes = tiled(reached.select(F.explode("leaves").alias("leaf"), "key", "v"), every("tiles"), part("crowds")).select("leaf", "tile", "crowd", "key", "v")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found = nearest_rows(_matrix(left["v"], dim), _matrix(right["v"], dim) if right.num_rows else np.zeros((0, dim)), right["ids"].to_pylist(), k)
        keys, entries = left["key"].to_pylist(), right["entry"].to_pylist()
        cols = [keys[i] for i, *_ in found], [j for _, j, *_ in found], [x[2] for x in found], [entries[x[3]] for x in found], [x[4] for x in found]
        kinds = {"key": pa.string(), "vec_id": pa.int64(), "score": pa.float64(), "entry": pa.int64(), "place": pa.int32()}
        return pa.table({name: pa.array(values, t) for (name, t), values in zip(kinds.items(), cols)})

    cells = ["leaf", "tile", "crowd"]
    pairs = probes.groupBy(*cells).cogroup(index.groupBy(*cells)).applyInArrow(rerank, "key string, vec_id bigint, score double, entry bigint, place int")
    # A row is its vector (entry) and its place among the ids of that; trees find it again at the same distance.
    pairs = pairs.repartition(partitions(spark), "key").groupBy("key", "vec_id", "entry", "place").agg(F.min("score").alias("score"))
    by = Window.partitionBy("key").orderBy("score", "vec_id", "entry", "place")
    best = pairs.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    best = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id", "entry", "place"))).alias("best"))
    found = attach(queries, keep(best.join(asked, "key"), "ann-best"), "key", "asked")
    self_ = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("id")) & (x["entry"] == F.xxhash64("key"))), True)
    own = F.slice(F.filter("best", lambda _, i: i + 1 != self_), 1, k)
    return found.select(F.col("id").alias("query_id"), F.posexplode(own).alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), "b.vec_id", "b.score")
