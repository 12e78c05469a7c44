"""N-gram Jaccard join by token-combination prefixes: links texts whose shingle sets have at least a given similarity.

A text's set holds its distinct shingles (runs of `words` words, lower-cased A-Z). Sets of equal content are joined once. A set of n shingles may
lack at most e = n - ceil(s n) of them in any set of similarity s. In one order of all shingles, similar sets therefore share at least l of
their first e + l ones: their extended prefixes. Shingles are 64-bit hashes, so this first order needs no counting, and only the extended
prefixes (about a quarter of the shingles) move. They are counted: the second order is by number of sets, rare first.

Of a set's extended prefix at most e shingles lack in a similar one's, so the rarest of them are taken until more than e would
have to lack before nothing is shared, and these are indexed: shingles of up to RARE sets one by one; more frequent ones as combinations
of k (2 here), formed only within groups into which they are dealt by hash. A group of p shingles holds out against p - k of them lacking; the extension l makes
up for that. The number of groups grows with the size of the sets, so that a long text's combinations grow with its length and not with
the square of it. Similar sets must then agree on that number: sizes are cut into classes such that similar sets are of one class or of
neighbouring ones, and a set is indexed for its own class and the next. A set whose extended prefix holds more than e shingles of no other set
has no partner and is dropped.

Sets with an index entry in common are candidates. A task folds its own entries to stars before they move, with one set for each entry,
so an entry that a third of all sets have costs one row a task. Clouds of candidates are verified by the exact similarity of their
sets (simhash.verified: all pairs of a cloud but those that other links join already, in tiles), so no link is false and none is lost.

Rules: words are runs other than \\x20 and \\x09-\\x0D; a text with fewer words than a shingle is one shingle; a text without words (empty or null)
has an empty set and links with nothing. Rows with a null id take part, but never name a component unless all of its ids are null.
Repeated rows share a component. Empty tables give empty results. Only id and text columns are read. Two shingles are taken as
equal if their 64-bit hashes are, two sets if 128 bits of a digest are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import attach, keep, mix64, partitions, ragged, small
from millrace.llm.simhash import _with_lowest, components, folded, shingle_set, spanning, verified

#: Shingles of at most so many sets are indexed one by one, others in combinations.
RARE = 4
#: Shingles of a combination.
TOGETHER = 2
#: Index entries that a task folds at once.
ENTRIES = 500_000


def lacking(n: np.ndarray, similarity: Fraction) -> np.ndarray:
    """How many elements of a set of size n a similar set may lack."""
    return n - -(-n * similarity.numerator // similarity.denominator)


def extension(n: np.ndarray, together: int = TOGETHER) -> np.ndarray:
    """By how many elements the prefix of a set of size n is longer than its lacking ones: enough for one group of combinations at least."""
    return together + n // 12


def size_classes(most: int, similarity: Fraction) -> np.ndarray:
    """Lower bounds of the size classes: sets of one class are at most similar to those of the next one."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(bounds[-1] * similarity.denominator // similarity.numerator + 1)
    return np.array(bounds, np.int64)


def groups_of(bounds: np.ndarray, slot: int, together: int) -> int:
    """Groups of frequent shingles for a class: what the shortest set indexed in it can make up for."""
    shortest = bounds[max(0, slot - 1)]
    return max(1, int(extension(shortest, together) - 1) // max(1, together - 1))


def least_size(similarity: Fraction) -> int:
    """Smaller sets than this link with equal ones only: n / (n + 1) is under the similarity."""
    n = 1
    while n * similarity.denominator < (n + 1) * similarity.numerator:
        n += 1
    return n


def _prefix(text: Column, words: int, similarity: Fraction, together: int = TOGETHER) -> Column:
    """struct(s0, s1: digest of the set, size, prefix: the extended prefix, empty where no other set can link)."""
    least = least_size(similarity)

    @F.arrow_udf("struct<s0: bigint, s1: bigint, size: bigint, prefix: array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        numbers, prefixes = np.zeros((len(texts), 3), np.int64), []
        for i, one in enumerate(texts):
            own = shingle_set(one.as_py(), words)  # in order of hash
            n = np.int64(len(own))
            numbers[i, :2] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
            numbers[i, 2] = n
            prefixes.append(own[: int(lacking(n, similarity) + extension(n, together))].view(np.int64) if n >= least else own[:0].view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *prefixes])
        cols = [pa.array(numbers[:, k].copy()) for k in range(3)] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        return pa.StructArray.from_arrays(cols, names=["s0", "s1", "size", "prefix"])

    return run(text)


def entries_of(tokens: np.ndarray, counts: np.ndarray, size: int, held: int, bounds: np.ndarray, similarity: Fraction, rare: int = RARE, together: int = TOGETHER) -> np.ndarray:
    """The index entries of one set. tokens, counts: the shingles of its extended prefix that other sets have too, and in how many
    sets' extended prefixes they are; held: the length of the extended prefix."""
    budget = int(lacking(np.int64(size), similarity)) + 1
    if held - len(tokens) >= budget:
        return np.zeros(0, np.uint64)
    order = np.lexsort([tokens, counts])
    tokens, counts = tokens[order], counts[order]
    alone = int(np.searchsorted(counts, rare, "right"))
    budget -= held - len(tokens)  # shingles of no other set
    if alone >= budget:
        return tokens[:budget].copy()
    budget -= alone
    slot = int(np.searchsorted(bounds, size, "right")) - 1
    found, often = [tokens[:alone]], tokens[alone:]
    for at in (slot, slot + 1):
        n = groups_of(bounds, at, together)
        group = (mix64(often ^ np.uint64(at + 1)) % np.uint64(n)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[by], prepend=-1))
        place = np.zeros(len(by), np.int64)  # a shingle's place among its group's
        place[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        upto = np.cumsum(place >= together - 1)
        taken = int(np.searchsorted(upto, budget)) + 1  # enough, as the extension makes up for each group
        for g in np.unique(group[:taken]):
            own = np.sort(often[:taken][group[:taken] == g])
            if len(own) >= together:
                chosen = own[np.array(list(combinations(range(len(own)), together)))]
                h = np.full(len(chosen), (at + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                for k in range(together):
                    h = mix64(h ^ chosen[:, k])
                found.append(h)
    return np.unique(np.concatenate(found))


def _stars(entry: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b): links that join the nodes of each entry; and each entry with its smallest node."""
    order = np.lexsort([node, entry])
    entry, node = entry[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
    heads = np.repeat(node[first], np.diff(np.append(first, len(entry))))
    nodes, at = np.unique(np.concatenate([node, heads]), return_inverse=True)
    label = spanning(at[: len(node)], at[len(node) :], len(nodes))
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]], entry[first], node[first]


def _star_batches(it: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Batches (entry, node) to rows (entry, a, b): links without an entry, and each entry's smallest node as a unless `whole`."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        a, b, entry, node = _stars(*np.concatenate(held, axis=1))
        if whole:
            entry, node = entry[:0], node[:0]
        none = np.concatenate([np.ones(len(a), bool), np.zeros(len(entry), bool)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a * 0, entry]), mask=none), pa.array(np.concatenate([a, node])), pa.array(np.concatenate([b, node]))], names=["entry", "a", "b"])

    held: list[np.ndarray] = []
    for batch in it:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(x.shape[1] for x in held) < ENTRIES:
            continue
        rows = np.concatenate(held, axis=1)
        # Where rows come in order of entry, the last entry may go on in the next batch.
        cut = int(np.searchsorted(rows[0], rows[0, -1])) if whole else rows.shape[1]
        if cut:
            yield flush([rows[:, :cut]])
            held = [rows[:, cut:]] if whole else []
        else:  # one entry only: its first node stands for those so far
            a, b, entry, node = _stars(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, mask=np.ones(len(a), bool)), pa.array(a), pa.array(b)], names=["entry", "a", "b"])
            held = [np.stack([entry, node])]
    if held:
        yield flush(held)


def candidate_links(sets: DataFrame, similarity: float, rare: int = RARE, together: int = TOGETHER) -> DataFrame:
    """sets: node, size, prefix. (a, b): links whose components hold all pairs with an index entry in common."""
    spark, share = sets.sparkSession, Fraction(str(similarity))
    n, most, tokens = sets.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(1)), F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()
    bounds = size_classes(int(most), share)
    each = sets.select("node", F.explode("prefix").alias("token"))
    counts = keep(each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "ngram-counts")
    shared = attach(each, counts, "token", "n").groupBy("node").agg(F.collect_list(F.struct("token", "n")).alias("shared"))
    known = sets.select("node", "size", F.size("prefix").cast("bigint").alias("held"))
    rows = shared.join(known, "node").where((F.col("held") - F.size("shared")) <= F.col("size") - F.ceil(F.col("size") * share.numerator / share.denominator) + 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for batch in it:
                nodes, lists, sizes, held = batch.columns
                flat = lists.flatten()
                token, count = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()
                ends = np.cumsum(np.array(lists.value_lengths(), np.int64))
                out, owner = [], []
                for k, (node, size, h) in enumerate(zip(nodes.to_pylist(), sizes.to_pylist(), held.to_pylist())):
                    low = ends[k - 1] if k else 0
                    own = entries_of(token[low : ends[k]], count[low : ends[k]], size, h, bounds, share, rare, together)
                    out.append(own.view(np.int64))
                    owner.append(np.full(len(own), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (out, owner)], names=["entry", "node"])

        yield from _star_batches(found(), whole=False)

    local = keep(rows.select("node", "shared", "size", "held").mapInArrow(run, "entry bigint, a bigint, b bigint"), "ngram-entries")
    heads = local.where("entry IS NOT NULL").select("entry", F.col("a").alias("node"))
    parts = partitions(spark, tokens, 2_000_000)
    met = heads.repartition(parts, "entry").sortWithinPartitions("entry", "node").mapInArrow(lambda it: _star_batches(it, whole=True), "entry bigint, a bigint, b bigint")
    return folded(local.where("entry IS NULL").select("a", "b").unionByName(met.select("a", "b")))


def jaccard_components(docs: DataFrame, similarity: float = 0.8, words: int = 5, rare: int = RARE, together: int = TOGETHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_shingles, component_id: the smallest id that links of at least the similarity reach.

    rare, together: shingles of up to `rare` sets are indexed one by one, others in combinations of `together`.
    """
    share = Fraction(str(similarity))
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = keep(rows.withColumn("f", _prefix(F.col("text"), words, share, together)), "ngram-rows", "zstd")
    own = rows.select("node", "id", "f.s0", "f.s1", "f.size")
    distinct = keep(own.where("size > 0").groupBy("s0", "s1", "size").agg(F.min("node").alias("node"), F.min("id").alias("low"), F.count("*").alias("copies")), "ngram-distinct")
    copies = keep(own.where("size > 0").select("node").join(distinct.select("node"), "node", "left_anti"), "ngram-copies")
    first = rows.join(small(copies, copies.count()), "node", "left_anti")  # one row of each set
    sets = first.where(F.size("f.prefix") > 0).select("node", "f.size", "f.prefix")
    clouds = components(candidate_links(sets, similarity, rare, together)).withColumnRenamed("label", "cloud")
    members = keep(clouds.join(distinct.select("node", "size"), "node"), "ngram-clouds")
    label = components(verified(members, rows.select("node", "text"), words, similarity))
    named = distinct.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    key = lambda a, b: F.concat_ws(",", a, b)
    classes = keep(_with_lowest(keep(named, "ngram-named"), lowest).select(key("s0", "s1").alias("fp"), "copies", "component_id"), "ngram-classes")
    full = attach(own.where("size > 0").select("id", "size", key("s0", "s1").alias("fp")), classes, "fp", "copies")
    none = own.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return full.select("id", "size", "component_id").unionByName(none).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
