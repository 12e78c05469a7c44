"""SimHash near-deduplication with BK-trees.

A fingerprint has 64 bits: a bit is 1 if it is set in over half the XXH64 hashes (seed 42) of a text's
shingles. Two fingerprints link if at most `radius` bits differ. Distinct fingerprints are linked, so exact
copies count once. If two of them differ in at most r bits, then of m > r blocks of bits at least m - r are
the same in both: each choice of m - r blocks is a shard key, and linked pairs meet in at least one shard. A
shard's fingerprints form a BK-tree, whose children are keyed by their Hamming distance to the parent; a
search follows only the edges within the radius. A task folds its links to stars on the smallest node of each component
before they leave it, and the stars of all shards are folded to components by label
propagation with pointer jumping over written tables.

Broadcasting all trees to all tasks would not be bounded, so a tree goes to the tasks of its own shard key.

A shard of more than `tile` fingerprints is hot. It is cut into tiles (see all_links): tiles are searched by themselves, then
one fingerprint of each tile's commonest component is searched against those of other tiles, and last of all, what is still outside the
shard's commonest component against the whole shard. So a third of all rows that are copies of each other
move a few times each, and no pair that could join two components is left out.

near_duplicates() links texts by the exact similarity (Jaccard) of their shingle sets; fingerprints only find
candidates. It takes a wider fingerprint: each hash is mixed anew for each of `width` words of 64 bits. Texts of
similarity s differ in about arccos(2s / (1 + s)) / pi of the bits, which sets the candidates' radius (three
standard errors of that share are added). Its shard keys are overlapping runs of bits of the fingerprint: of 12 bits for up to eighty million texts, of one bit
more for each doubling, with as many more words as keep a pair's chance of a run in common (settings_for). Few bits say little of a few shingles, so
sets of up to SHORT shingles are candidates by their shingles themselves as well (ngram_join), which misses none.
The components of candidate links are clouds; all pairs of a cloud are then compared by their sets (of 64-bit
hashes) but for those that other links join already, in tiles as above, and only pairs of the similarity asked for link. So no
link is false; a pair is missed only if no chain of candidates joins it.

Rules: A-Z is lower-cased; words are runs other than \\x20 and \\x09-\\x0D; a text with fewer words than a
shingle is one shingle; a text without words (empty or null) has fingerprint 0, which links like any other. Rows
with a null id take part, but never name a component unless all of its ids are null. Repeated rows share a
component. Only id and text columns are read. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import attach, join_hubs, keep, mix64, partitions, ragged, small

TILE = 20_000
#: A cloud's parts hold about so many texts and shingles.
PART, SHINGLES = 2_000, 500_000
#: Edges beyond which components() joins hubs apart.
MANY = 1_000_000
#: Sets of up to so many shingles are found by them.
SHORT = 32
#: Texts up to which fingerprints have 6 words and runs of 12 bits, which start every 10 bits.
TEXTS, STEP = 80_000_000, 10


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included, as rows of 8 big-endian bytes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), ends[len(parts) - n :].tolist()
    digests = b"".join(map(xxhash.xxh64_digest, [joined[a:b] for a, b in zip(first, last)], repeat(seed)))
    return np.frombuffer(digests, np.uint8).reshape(n, 8)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half the rows, as bytes."""
    n = len(hashes)
    if not n:
        return np.zeros(hashes.shape[1], np.uint8)
    lanes = np.unpackbits(hashes, axis=1).view(np.uint64)  # eight counters of a byte in each number
    counts = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    return int.from_bytes(majority(shingle_hashes(text, words)).tobytes(), "big")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    return np.unique(shingle_hashes(text, words).copy().view(">u8").ravel().astype(np.uint64))


def wide_fingerprint(own: np.ndarray, width: int) -> np.ndarray:
    """width words of 64 bits from a shingle set; a shingle counts once."""
    salts = mix64(np.arange(1, width + 1))
    mixed = mix64(own[:, None] ^ salts[None, :])
    return majority(mixed.astype(">u8").view(np.uint8).reshape(len(own), 8 * width)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = 4, width: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, w0, w1, ...: the fingerprint of every row in signed 64-bit numbers; width 0: the plain one."""
    names = [f"w{i}" for i in range(max(1, width))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.zeros((batch.num_rows, len(names)), np.uint64)
            for i, text in enumerate(batch.column(1)):
                fps[i] = wide_fingerprint(shingle_set(text.as_py(), words), width) if width else fingerprint(text.as_py(), words)
            cols = [pa.array(fps[:, i].copy().view(np.int64)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *names])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, " + ", ".join(f"{n} bigint" for n in names))


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - 2**64 if mask >= 2**63 else mask


def blocks_for(n: int, radius: int) -> list[tuple[int, int]]:
    """Shard keys (word, mask) for 64 bits: the fewest blocks at which a key tells about n values apart."""
    for m in range(radius + 1, 2 * radius + 2):
        cuts = np.linspace(0, 64, m + 1).astype(int)
        same = m - radius
        if 64 * same // m + 8 >= math.log2(max(2, n)) or m == 2 * radius + 1:
            return [(0, _signed([b for k in chosen for b in range(cuts[k], cuts[k + 1])])) for chosen in combinations(range(m), same)]
    raise AssertionError


class BkForest:
    """BK-trees of several groups, built and searched level by level with numpy."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """values: uint64, n x words; group: integers from 0."""
        self.values, self.base = values, 64 * values.shape[1] + 1
        groups = int(group.max()) + 1 if len(group) else 0
        edge_key, edge_child = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        parent, distance, left = group.astype(np.int64), np.zeros(len(values), np.int64), np.arange(len(values))
        self.roots = np.full(groups, -1, np.int64)
        for level in range(len(values) + 1):
            if not left.size:
                break
            keys, first, which = np.unique(parent * self.base + distance, return_index=True, return_inverse=True)
            node = left[first]
            if level:
                edge_key.append(keys)
                edge_child.append(node)
            else:
                self.roots[group[node]] = node
            owner = node[which]
            rest = left != owner
            left, parent = left[rest], owner[rest]
            distance = self.distance(values[left], parent)
        keys, children = np.concatenate(edge_key), np.concatenate(edge_child)
        order = np.argsort(keys)
        self.edges, self.children = keys[order], children[order]

    def distance(self, values: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(values ^ self.values[nodes]).sum(axis=1, dtype=np.int64)

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, value index) within the radius, each query in the tree of its group."""
        node, query = self.roots[group], np.arange(len(queries))
        found_q, found_v = [query[:0]], [query[:0]]
        while query.size:
            d = self.distance(queries[query], node)
            hit = d <= radius
            found_q.append(query[hit])
            found_v.append(node[hit])
            low = np.searchsorted(self.edges, node * self.base + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.edges, node * self.base + np.minimum(d + radius, self.base - 1), "right")
            query, node = np.repeat(query, high - low), self.children[ragged(low, high - low)]
        return np.concatenate(found_q), np.concatenate(found_v)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n-1 linked by (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _shard_links(fps: np.ndarray, group: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Spanning links (pairs of row numbers) of the groups; tree and query mark the rows on each side."""
    ids_t, ids_q = np.flatnonzero(tree), np.flatnonzero(query)
    forest = BkForest(fps[ids_t], group[ids_t])
    ids_q = ids_q[group[ids_q] < len(forest.roots)]
    ids_q = ids_q[forest.roots[group[ids_q]] >= 0]
    links = np.zeros((2, 0), np.int64)
    for k in range(0, len(ids_q), 2048):  # bounds the pairs held at once
        part = ids_q[k : k + 2048]
        q, v = forest.search(fps[part], group[part], radius)
        pairs = np.stack([part[q], ids_t[v]])
        links = np.concatenate([links, pairs[:, pairs[0] != pairs[1]]], axis=1)
        if links.shape[1] > 500_000 or k + 2048 >= len(ids_q):
            label = spanning(links[0], links[1], len(fps))
            own = np.flatnonzero(label != np.arange(len(fps)))
            links = np.stack([own, label[own]])
    return links


def folded(edges: DataFrame, each: int = 1_000_000) -> DataFrame:
    """(a, b): fewer edges with the same components, written; a task folds about `each` of them."""
    rows = keep(edges.select("a", "b"), "links")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in it]
        if held:
            nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            label = spanning(*at.reshape(2, -1), len(nodes))
            own = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])

    return keep(rows.coalesce(max(1, -(-rows.count() // each))).mapInArrow(run, "a bigint, b bigint"), "folded")


def all_links(rows: DataFrame, group: list[str], link, tile: int, tiled: bool) -> DataFrame:
    """(a, b): links whose components are those of all linked pairs within each group.

    rows: node (once a group), the group's columns, parts (tiles that the group is cut into), own (a row's tile) and what
    else link() reads; tiled: some group has several parts. link(cells) gives the links of each cell (group, x, y) between its rows marked tree and its rows marked
    query; it may leave out pairs of one comp, and pairs that its other links join.

    First each tile by itself. Then, for groups of several tiles: one node of each tile's commonest component, against the
    others' (a short cut only); then all nodes outside the group's commonest component against the whole group.
    """
    yes, no = F.lit(True), F.lit(False)
    cells = rows.withColumn("comp", F.col("node"))
    first = folded(link(cells.select("*", F.col("own").alias("x"), F.lit(0).alias("y"), yes.alias("tree"), yes.alias("query"))))
    if not tiled:
        return first
    hot = rows.where("parts > 1")

    def marked(edges: DataFrame) -> DataFrame:
        found = hot.select(*group, "own", "parts", "node").join(components(edges).withColumnRenamed("label", "comp"), "node", "left")
        return keep(found.withColumn("comp", F.coalesce("comp", "node")), "tiles")

    per = marked(first).groupBy(*group, "own", "parts", "comp").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    sent = per.groupBy(*group, "own", "parts").agg(F.max_by("node", F.struct("n", -F.col("comp"))).alias("node"))
    again = hot.join(sent.select(*group, "node"), [*group, "node"], "left_semi").withColumn("comp", F.col("node"))
    meet = (-1 - F.floor(F.col("own") / tile)).cast("int")  # so many tiles' nodes make a tile again
    second = link(again.select("*", meet.alias("x"), F.lit(0).alias("y"), yes.alias("tree"), yes.alias("query")))
    edges = folded(first.unionByName(second))
    state = marked(edges)
    sizes = state.groupBy(*group, "comp").agg(F.count("*").alias("n"))
    mains = sizes.groupBy(*group).agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    mains = keep(mains.where("others > 0").withColumn("cuts", F.ceil(F.col("others") / tile).cast("int")), "mains")
    several = mains.count()
    if not several:
        return edges
    left = hot.join(small(mains, several), group).join(state.select(*group, "node", "comp"), [*group, "node"])
    outside = left.where("comp <> main").withColumn("x", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int"))
    outside = outside.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("*", no.alias("tree"), yes.alias("query"))
    whole = left.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("y", F.col("own")).select("*", yes.alias("tree"), no.alias("query"))
    third = link(outside.unionByName(whole).drop("main", "others", "cuts"))
    return folded(edges.unionByName(third))


def links(distinct: DataFrame, radius: int, keys: list[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """distinct: node, w0, w1, ... with no fingerprint twice. (a, b): links between nodes, whose
    components are those of all pairs within the radius that share a shard key (word, mask)."""
    words = [c for c in distinct.columns if c.startswith("w")]
    n = distinct.count()
    table = [F.struct(F.lit(i).alias("table"), F.col(f"w{w}").bitwiseAND(F.lit(m).cast("bigint")).alias("value")) for i, (w, m) in enumerate(keys)]
    keyed = distinct.select("node", *words, F.explode(F.array(*table)).alias("k")).select("k.table", "k.value", "node", *words)
    # A shard with more than `tile` fingerprints is hot: there are fewer than keys * n / tile of these.
    hot = keyed.groupBy("table", "value").count().where(F.col("count") > tile)
    hot = keep(hot.select("table", "value", F.ceil(F.col("count") / tile).cast("int").alias("parts")), "simhash-hot")
    near = F.broadcast(hot) if len(keys) * n // tile <= 100_000 else hot
    rows = keyed.join(near, ["table", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = ["table", "value", "x", "y"]
    groups = partitions(distinct.sparkSession, len(keys) * n, 50_000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cols: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate([[0], np.cumsum((cols[1:, :4] != cols[:-1, :4]).any(axis=1))])
            fps = np.ascontiguousarray(cols[:, 7:]).view(np.uint64)
            a, b = cols[:, 4][_shard_links(fps, group, cols[:, 5] == 1, cols[:, 6] == 1, radius)]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[np.ndarray] = []
        for batch in it:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) < 50_000:
                continue
            cols = np.concatenate(held)
            last = (cols[:, :4] == cols[-1, :4]).all(axis=1)  # its group may go on in the next batch
            if not last.all():
                yield flush(cols[~last])
            held = [cols[last]]
        if held and sum(map(len, held)):
            yield flush(np.concatenate(held))

    def link(cells: DataFrame) -> DataFrame:
        # Rows are in order of node, so that stars hang on the smallest node.
        dealt = cells.select(*tiles, "node", F.col("tree").cast("int").alias("tree"), F.col("query").cast("int").alias("query"), *words)
        return dealt.repartition(groups, *tiles).sortWithinPartitions(*tiles, "node").mapInArrow(run, "a bigint, b bigint")

    return all_links(rows, ["table", "value"], link, tile, not hot.isEmpty())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. (node, label): a row for each node with an edge, equal labels for connected nodes.

    Each round a node takes the smallest label among its own, its neighbours' and its label's label, and
    passes it to the node that its old label names, so chains shorten by more than half. Each round's
    table is written; the loop ends when a round changes nothing. Past MANY edges, nodes with over a thousandth of all edges and
    labels of so many nodes are joined apart; with fewer edges no key has more rows than a task takes.
    """
    pairs = keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = keep(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "cc-labels")
    edges_in_all = pairs.count()
    if not edges_in_all:
        return labels
    spread, most = edges_in_all > MANY, edges_in_all // 1000
    hubs = keep(pairs.groupBy("b").count().where(F.col("count") > most), "cc-hubs") if spread else None

    def joined(rows: DataFrame, table: DataFrame, key: str, few: DataFrame | None) -> DataFrame:
        return join_hubs(rows, table, key, few) if spread else rows.join(table, key)

    while True:
        seen = joined(pairs, labels.select(F.col("node").alias("b"), "label"), "b", hubs).select(F.col("a").alias("node"), "label")
        large = labels.groupBy("label").count().where(F.col("count") > most) if spread else None
        jump = joined(labels, labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", large).select("node", F.col("next").alias("label"))
        low = seen.unionByName(jump).unionByName(labels).groupBy("node").agg(F.min("label").alias("low"))
        both = low.join(labels, "node")
        told = both.select("node", F.col("low").alias("label")).unionByName(both.select(F.col("label").alias("node"), F.col("low").alias("label")))
        new = keep(told.groupBy("node").agg(F.min("label").alias("label")), "cc-labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old")
        if changed.isEmpty():
            return new
        labels = new


def _classes(rows: DataFrame, radius: int, keys) -> DataFrame:
    """rows: id, w0, ... Adds component_id, and copies: the rows of equal fingerprint."""
    words = [c for c in rows.columns if c.startswith("w")]
    distinct = rows.groupBy(*words).agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    distinct = keep(distinct.withColumn("node", F.monotonically_increasing_id()), "simhash-distinct")  # written: ids stay
    keys = keys or blocks_for(distinct.count(), radius)
    label = components(links(distinct.select("node", *words), radius, keys))
    named = distinct.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    key = F.concat_ws(",", *words)
    classes = keep(_with_lowest(named, lowest).select(key.alias("fp"), "copies", "component_id"), "simhash-classes")
    return attach(rows.withColumn("fp", key), classes, "fp", "copies")


def _with_lowest(named: DataFrame, lowest: DataFrame) -> DataFrame:
    """Adds each label's component_id; a label may be that of a third of all fingerprints."""
    sizes = named.groupBy("label").agg(F.count("*").alias("members"))
    return attach(named, lowest.join(sizes, "label"), "label", "members")


def near_classes(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, fingerprint (16 hex digits), component_id, the smallest id that links reach."""
    rows = keep(fingerprints(docs, words, 0, id_col, text_col), "simhash")
    out = _classes(rows, radius, None)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def settings_for(n: int, similarity: float) -> tuple[int, int]:
    """(words of a fingerprint, bits of a run) for n texts: shards hold some 20,000 of them whatever n, and a pair at the similarity
    shares a run as surely as with 6 words and 12 bits."""
    bits = 12 + max(0, math.ceil(math.log2(max(1, n) / TEXTS)))
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    runs = lambda b: len(range(0, 65 - b, STEP))  # noqa: E731  of a word
    return math.ceil(6 * runs(12) / runs(bits) * same ** (12 - bits)), bits


def _prints(text: Column, words: int, width: int, similarity: float) -> Column:
    """w0, w1, ...: the wide fingerprint; s0, s1: a digest of the shingle set; size: its shingles; short: of a set of up to SHORT
    shingles those that its partners share some of (see ngram_join)."""
    from millrace.llm.ngram_join import extension, lacking, least_size

    names, share = [f"w{i}" for i in range(width)] + ["s0", "s1", "size"], Fraction(str(similarity))
    least = least_size(share)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in names) + ", short: array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        out, short = np.zeros((len(texts), len(names)), np.int64), []
        for i, one in enumerate(texts):
            own = shingle_set(one.as_py(), words)
            out[i, :width] = wide_fingerprint(own, width).view(np.int64)
            out[i, width : width + 2] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
            n = np.int64(len(own))
            out[i, -1] = n
            short.append(own[: int(lacking(n, share) + extension(n))].view(np.int64) if least <= n <= SHORT else own[:0].view(np.int64))
        cols = [pa.array(out[:, k].copy()) for k in range(len(names))]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in short])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *short])))
        return pa.StructArray.from_arrays([*cols, lists], names=[*names, "short"])

    return run(text)


def _sets(text: Column, words: int) -> Column:
    """The shingle set of a text as bytes."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), words).tobytes() for t in texts], pa.binary())

    return run(text)


def _exact_links(sets: list[np.ndarray], tree: np.ndarray, query: np.ndarray, comp: np.ndarray, similarity: Fraction) -> list[tuple[int, int]]:
    """Links between rows of the tree and of the query side, whose components are those of all such pairs
    with at least the similarity. Pairs that links join already, or that are of one comp, aren't compared."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    seen = np.zeros(int(flat.max(initial=-1)) + 1, np.int32)
    out, alone = [], bool((tree & query).all())
    _, label = np.unique(comp, return_inverse=True)
    for q in np.flatnonzero(query):
        # No overlap above the smaller set's size: other sizes can't reach the similarity.
        fits = tree & (np.minimum(size, size[q]) * similarity.denominator >= np.maximum(size, size[q]) * similarity.numerator)
        if alone:  # one part against itself: each pair once
            fits[q:] = False
        left = np.flatnonzero(fits & (label != label[q]))
        own = flat[start[q] : start[q] + size[q]]
        seen[own] = 1
        while left.size:
            part, left = left[:64], left[64:]
            ends = np.cumsum(size[part])
            common = np.concatenate([[0], np.cumsum(seen[flat[ragged(start[part], size[part])]])])
            common = common[ends] - common[ends - size[part]]
            hit = part[common * similarity.denominator >= (size[part] + size[q] - common) * similarity.numerator]
            if hit.size:
                out += [(int(q), int(h)) for h in hit]
                joined = np.append(label[hit], label[q])
                label[np.isin(label, joined)] = joined.min()
                left = left[label[left] != label[q]]
        seen[own] = 0
    return out


def verified(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """members: node, cloud, size; texts: node, text. (a, b): links between nodes of one cloud, whose components
    are those of all pairs of that cloud with at least the similarity. Tiles hold about PART nodes or SHINGLES shingles."""
    spark, share = members.sparkSession, Fraction(str(similarity))
    n, total = members.agg(F.count("*"), F.sum("size")).first()
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / SHINGLES)).cast("int")
    hot = keep(members.groupBy("cloud").agg(parts.alias("parts")).where("parts > 1"), "cloud-parts")
    placed = members.join(small(hot, hot.count()), "cloud", "left").select("node", "cloud", F.coalesce("parts", F.lit(1)).alias("parts"))
    rows = texts.join(small(placed, n), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    small_clouds = partitions(spark, total or 0, SHINGLES)

    def run(cell: pa.Table) -> pa.Table:
        cloud, node, comp = (cell[c].to_numpy() for c in ("cloud", "node", "comp"))
        tree, query = (np.array(cell[c].to_pylist(), bool) for c in ("tree", "query"))
        sets = [np.frombuffer(b.as_py(), np.uint64) for b in cell["set"]]
        order, found = np.lexsort([node, cloud]), []
        for rows in np.split(order, np.flatnonzero(np.diff(cloud[order])) + 1):
            found += [(node[rows[a]], node[rows[b]]) for a, b in _exact_links([sets[k] for k in rows], tree[rows], query[rows], comp[rows], share)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a.copy()), "b": pa.array(b.copy())})

    def link(cells: DataFrame) -> DataFrame:
        whole = F.col("parts") == 1  # small clouds share a group
        by = F.when(whole, F.pmod(F.xxhash64("cloud"), F.lit(small_clouds))).otherwise(F.col("cloud")).alias("cell")
        dealt = cells.select(by, F.when(whole, -1).otherwise(F.col("x")).alias("x"), F.when(whole, -1).otherwise(F.col("y")).alias("y"), "cloud", "node", "comp", "tree", "query", _sets(F.col("text"), words).alias("set"))
        return dealt.groupBy("cell", "x", "y").applyInArrow(run, "a bigint, b bigint")

    return all_links(rows, ["cloud"], link, PART, not hot.isEmpty())


def _near(rows: DataFrame, similarity: float, words: int, width: int, key_bits: int) -> DataFrame:
    """rows: node (tells rows apart), id, text, f (prints), order, written. One row per distinct shingle set: s0, s1,
    copies, low (its least id), best (its row of the least order and node), label (equal for linked sets)."""
    from millrace.llm.ngram_join import candidate_links

    share, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * width
    radius = math.floor(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
    keys = [(w, _signed(list(range(b, b + key_bits)))) for w in range(width) for b in range(0, 65 - key_bits, STEP)]
    names = [f"w{i}" for i in range(width)]
    distinct = rows.groupBy(*[F.col(f"f.{c}").alias(c) for c in [*names, "s0", "s1", "size"]]).agg(
        F.min("node").alias("node"), F.min("id").alias("low"), F.min(F.struct("order", "node")).alias("best"), F.count("*").alias("copies"), F.first("f.short").alias("prefix")
    )
    distinct = keep(distinct, "simhash-distinct")
    short = candidate_links(distinct.where(F.size("prefix") > 0).select("node", "size", "prefix"), similarity)
    found = links(distinct.select("node", *names), radius, keys).unionByName(short)
    clouds = components(found).withColumnRenamed("label", "cloud")
    members = keep(clouds.join(distinct.select("node", "size"), "node"), "simhash-clouds")
    label = components(verified(members, rows.select("node", "text"), words, similarity))
    return distinct.join(label, "node", "left").select("s0", "s1", "copies", "low", "best", F.coalesce("label", "node").alias("label"))


def _numbered(docs: DataFrame, words: int, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """node, id, f, order and row (all columns), written, and text of the row. order: by id, null last, then by content."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64(F.to_json("row")).alias("hash"))
    rows = keep(rows.select(F.monotonically_increasing_id().alias("node"), "id", order.alias("order"), "row", _prints(F.col("text"), words, width, similarity).alias("f")), "simhash")
    return rows.withColumn("text", F.col("row").getField(text_col))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, component_id of texts whose shingle sets have at least the similarity given."""
    width, key_bits = settings_for(docs.count(), similarity)
    rows = _numbered(docs.select(id_col, text_col), words, width, similarity, id_col, text_col)
    named = keep(_near(rows, similarity, words, width, key_bits), "simhash-near")
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    key = lambda a, b: F.concat_ws(",", a, b)
    classes = keep(_with_lowest(named, lowest).select(key("s0", "s1").alias("fp"), "copies", "component_id"), "simhash-classes")
    return attach(rows.select("id", key("f.s0", "f.s1").alias("fp")), classes, "fp", "copies").select(F.col("id").alias(id_col), "component_id")


def deduplicated(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates(), that of the smallest id (null last); columns unchanged.

    Rows are decided on as such, so null and repeated ids are as good as others.
    """
    width, key_bits = settings_for(docs.count(), similarity)
    rows = _numbered(docs, words, width, similarity, id_col, text_col)
    best = _near(rows, similarity, words, width, key_bits).groupBy("label").agg(F.min("best").alias("best"))
    lost = keep(rows.select("node").join(best.select("best.node"), "node", "left_anti"), "simhash-lost")
    return rows.select("node", "row").join(small(lost, lost.count()), "node", "left_anti").select("row.*")
