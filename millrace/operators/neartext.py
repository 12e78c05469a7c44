"""Near-duplicate texts (C16): MinHash signatures, banded keys, exact verification, connected components.

A text's set holds its distinct shingles of `words` words, as 64-bit hashes. Texts of equal sets are one from then on. A signature is the minimum of
bands x rows hash functions over the set; each band's minima, hashed together, are a key, and sets with a key in common are candidates. Two sets of
similarity s miss each other with probability (1 - s^rows)^bands: 7e-6 at 0.8 with the 30 bands of 5 rows set here, so recall at the threshold is
stated as 0.9999 (and grows above it); only sets whose exact Jaccard similarity reaches the threshold link.

Candidates are verified in rounds: in a group of one key, each set that isn't joined with the group's head is compared with it. The head leaves the
group then, as it has met all others, and groups whose sets are all joined are done, so a group of copies of one text costs as many comparisons as it has sets.
What is left after ROUNDS rounds are sets with a key in common that mostly don't link: texts around one passage, whose pairs grow with the square of the
corpus. They get new groups, by shingles of which any two sets that reach the threshold share one (the rarest of a set, by their counts in what is left),
one more round, and then all comparisons in a group, by tiles. No pair of candidates that can link is left out.

Tables that grow with the input meet in shuffled joins, by hint: Spark judges a table by its files, where the ids of pairs and cells take a few bits
each, and would broadcast millions of rows through the driver. What is broadcast is bounded: fewer than a thousand narrow rows, and a bit a bucket.

Rules: A-Z is lower-cased; words are runs other than \\x20 and \\x09-\\x0D; a text of fewer words than a shingle is one shingle; a text without words
(or null) has an empty set, which links with nothing. Rows with a null id take part, but name a component only if it has no other id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.core import let
from millrace.operators.joins import join_classes
from millrace.operators.store import written

ROUNDS = 2
BUCKETS = 1 << 20  #: bits of the table that is broadcast to find the sets with candidates
TILE = 64  #: sets of a key that are compared in one cell


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
GOLD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 19  #: bytes of text that are hashed together, so that the arrays stay in the processor's cache


def _word_hashes(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each text's words begin and end): raw are the texts' bytes, lower-cased, cut at edges.

    A word's hash is the sum of random numbers drawn by byte and place in the word.
    """
    at = np.flatnonzero(~BLANK[raw])
    text = np.searchsorted(at, edges)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    new[text[text < len(at)]] = True
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    value = _mixed(_mixed((place.astype(np.uint64) * np.uint64(256) + raw[at] + np.uint64(1)) * GOLD))
    return np.add.reduceat(value, first) if len(first) else value, np.searchsorted(first, text)


def _shingles(hashes: np.ndarray, edges: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(each text's distinct shingles in order, their number): a text's words are cut at edges."""
    stop, at = np.repeat(edges[1:], np.diff(edges)), np.arange(len(hashes))
    grams, factors = hashes.copy(), np.cumprod(np.full(words, GOLD))
    for j in range(1, min(words, len(hashes))):
        grams[:-j] += np.where(at[j:] < stop[:-j], hashes[j:] * factors[j], np.uint64(0))
    begins = at == np.repeat(edges[:-1], np.diff(edges))
    taken = begins | (at + words <= stop)
    edges = np.append(0, np.cumsum(taken))[edges]
    grams = _mixed(grams[taken])
    for a, b in zip(edges[:-1], edges[1:]):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[edges[edges < len(grams)]] = True
    return grams[new], np.diff(np.append(0, np.cumsum(new))[edges])


def _keys(grams: np.ndarray, size: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Each set's keys, one a band; sets without shingles: zeros."""
    salts = _mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * GOLD).astype(np.uint32).reshape(bands, rows, 2) | np.uint32(1)
    full = size > 0
    start = (np.cumsum(size) - size)[full]
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    x, y = np.empty_like(low), np.empty_like(low)
    keys, seeds = np.zeros((len(size), bands), np.uint64), _mixed(np.arange(1, bands + 1, dtype=np.uint64) * GOLD)
    for band in range(bands if len(grams) else 0):
        key = np.full(len(start), seeds[band])
        for a, b in salts[band]:
            np.multiply(low, a, out=x)
            np.multiply(high, b, out=y)
            np.add(x, y, out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x85EBCA6B), out=x)
            key = _mixed((key ^ np.minimum.reduceat(x, start)) * GOLD)
        keys[full, band] = key
    return keys


def signed(text: Column, words: int, bands: int, rows: int) -> Column:
    """struct(hashes: the distinct shingles' hashes in order, digest of the set, keys: one a band)."""

    @F.arrow_udf("struct<hashes: array<bigint>, digest: binary, keys: array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        cut = np.frombuffer(offsets, np.int64)[texts.offset :][: len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)
        sets, sizes, keys, digests, i = [], [], [], [], 0
        while i < len(texts):
            k = max(i + 1, int(np.searchsorted(cut, cut[i] + BLOCK, "right")) - 1)
            grams, size = _shingles(*_word_hashes(LOWER[raw[cut[i] : cut[k]]], cut[i : k + 1] - cut[i]), words)
            stop = np.cumsum(size)
            digests += [hashlib.blake2b(grams[b - n : b].tobytes(), digest_size=16).digest() for n, b in zip(size, stop)]
            keys.append(_keys(grams, size, bands, rows))
            sets.append(grams)
            sizes.append(size)
            i = k
        edges, flat = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat.view(np.int64)))
        bands_of = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(np.concatenate(keys).view(np.int64).ravel() if keys else [], pa.int64()))
        return pa.StructArray.from_arrays([lists, pa.array(digests, pa.binary()), bands_of], names=["hashes", "digest", "keys"])

    return run(F.coalesce(text, F.lit("")))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. (node, label): the smallest node of each one's component, for nodes with an edge.

    A round passes the least label of a node's neighbours to the node and to the node its label names; every round's table is written.
    Nodes and labels of very many rows are joined by broadcast (join_classes).
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    pairs = written(both, "component-edges")
    first = pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"), F.count("*").alias("degree"))
    labels = written(first, "component-labels")
    while True:
        named = labels.select(F.col("node").alias("b"), "label", "degree")
        seen = join_classes(pairs, named, "b", "degree").select(F.col("a").alias("node"), "label")
        sizes = labels.groupBy("label").agg(F.count("*").alias("__n"))
        heads = sizes.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")).hint("merge"), "label")
        jump = join_classes(labels, heads, "label", "__n").select("node", F.col("next").alias("label"))
        told = seen.unionByName(jump).unionByName(labels.withColumn("old", F.col("label")), allowMissingColumns=True)
        new = written(told.groupBy("node").agg(F.min("label").alias("label"), F.max("degree").alias("degree"), F.max("old").alias("old")), "component-labels")
        labels = new.drop("old")
        if new.where("label <> old").isEmpty():
            return labels.drop("degree")


def _marked(sets: DataFrame, members: DataFrame) -> DataFrame:
    """The sets of the members' nodes, and some others: one bit a bucket of nodes is broadcast, 64 of them a row."""
    bucket = F.pmod(F.xxhash64("node"), F.lit(BUCKETS))
    word, bit = F.shiftright(bucket, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {BUCKETS}L) & 63 AS int))")
    words = members.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    return sets.select("*", word).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) of which the sets (node, hashes) reach the similarity.

    Sets are too wide to broadcast: one of very many pairs (so of fewer than a thousand) has a copy for each piece of these.
    """
    share, most = round(similarity * 10_000), max(1_000, pairs.count() // 1_000)
    needed = _marked(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    both = pairs
    for end, other, name in (("a", "b", "x"), ("b", "a", "y")):
        pieces = pairs.groupBy(end).agg(F.ceil(F.count("*") / most).cast("int").alias("pieces"))
        often = F.broadcast(written(pieces.where("pieces > 1"), "near-often"))
        one = needed.select(F.col("node").alias(end), F.col("hashes").alias(name)).join(often, end, "left")
        copies = one.select(end, name, F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
        piece = F.coalesce(F.pmod(F.xxhash64(other), "pieces").cast("int"), F.lit(0)).alias("piece")
        both = both.join(often, end, "left").select(*both.columns, piece).join(copies.hint("shuffle_hash"), [end, "piece"]).drop("piece")
    reach = let(F.size(F.array_intersect("x", "y")), lambda common: common * 10_000 >= share * (F.size("x") + F.size("y") - common))
    return both.where(reach).select("a", "b")


def _rare(sets: DataFrame, similarity: float) -> DataFrame:
    """sets: node, size, hashes. (key, node, size, early): shingles, rarest first, of which any two sets that reach the similarity share one.

    Of two sets the smaller has it among its first (early), the larger among as many as the similarity leaves out. The order is by the number of these
    sets that hold a shingle, so a passage that many of them hold is in nobody's first shingles, unless it is nearly all of a set.
    """
    share = round(similarity * 10_000)
    grams = sets.select("node", "size", F.explode("hashes").alias("key"))
    counts = written(grams.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1"), "near-counts")
    shared = join_classes(grams, counts, "key", "__n").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("__n", "key"))).alias("g"))
    first = shared.withColumn("alone", F.col("size") - F.size("g"))  # shingles of one set come before all others
    late = first.withColumn("g", F.slice("g", 1, F.greatest(F.expr(f"size - ({share}L * size + 9999) DIV 10000 + 1").cast("int") - F.col("alone"), F.lit(0))))
    early = F.expr(f"place + alone < size - ({2 * share}L * size + {9_999 + share}) DIV {10_000 + share} + 1").alias("early")
    return late.select("node", "size", "alone", F.posexplode("g.key").alias("place", "key")).select("key", "node", "size", early)


def links(keyed: DataFrame, sets: DataFrame, similarity: float, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """keyed: node, size, keys, no set twice; sets: node, size, hashes of these at least. (node, label): components of candidates that reach the similarity."""
    each = written(keyed.select(F.explode("keys").alias("key"), "node", "size"), "near-keys")
    shared = written(each.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1"), "near-shared")
    members = written(join_classes(each, shared, "key", "__n").select("key", "node", "size", F.lit(True).alias("early")), "near-members")
    near = _marked(sets, members)  # most sets without a candidate stay where they are
    held = members.select("node").distinct().hint("shuffle_hash")  # the sets themselves aren't sorted
    sets = written(near.join(held, "node"), "near-sets")  # Spark would move a semi-join before the bits, and shuffle all sets
    label, found = None, None

    def named(rows: DataFrame) -> DataFrame:
        """With each set's component; groups of one component are done and left out."""
        out = rows.withColumn("comp", F.col("node")) if label is None else rows.join(label.withColumnRenamed("label", "comp").hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        out = written(out, "near-round")
        groups = out.groupBy("key").agg(F.count("*").alias("__n"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("early").alias("any"), F.min(F.struct("node", "comp", "size", "early")).alias("h"))
        groups = written(groups.where("c0 < c1 AND any").select("key", "__n", "h"), "near-groups")
        return written(join_classes(out, groups, "key", "__n"), "near-rest")

    def compare(pairs: DataFrame) -> None:
        """pairs: x and y, structs of node, size and early. Sets too unlike in size can't reach the similarity."""
        nonlocal label, found
        small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
        fits = pairs.where(small >= similarity * large - 1e-9).where(F.when(F.col("x.size") <= F.col("y.size"), F.col("x.early")).otherwise(F.col("y.early")))
        new = written(_verified(written(fits.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "near-pairs"), sets, similarity), "near-links")
        if not new.isEmpty():
            found = new if found is None else new.unionByName(found)
            label = components(found)

    one = F.struct("node", "size", "early")
    for stage, heads in enumerate((rounds, min(rounds, 1))):
        for _ in range(heads):
            rows = named(members)
            if rows.isEmpty():
                return _labels(label, sets)
            members = rows.where("node <> h.node").select("key", "node", "size", "early")
            met = rows.where("node <> h.node AND comp <> h.comp")
            compare(met.select(F.col("h").alias("x"), one.alias("y")))
        rows = named(members)
        if rows.isEmpty():
            return _labels(label, sets)
        if stage == 0:
            held = rows.select("node").distinct().hint("shuffle_hash")
            members = written(_rare(written(sets.join(held, "node", "left_semi"), "near-open"), similarity), "near-rare")
    placed = rows.withColumn("parts", F.ceil(F.col("__n") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), one.alias("x"), "comp")
    pairs = cells.join(cells.select("key", "i", "j", F.col("x").alias("y"), F.col("comp").alias("other_comp")).hint("merge"), ["key", "i", "j"]).where("x.node < y.node AND comp <> other_comp")
    compare(pairs)
    return _labels(label, sets)


def _labels(label: DataFrame | None, sets: DataFrame) -> DataFrame:
    return label if label is not None else sets.select("node", F.col("node").alias("label")).limit(0)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, bands: int = 30, rows: int = 5) -> DataFrame:
    """One row per row: id_col, n_shingles, component_id (the smallest id that links reach)."""
    rows_of = df.select(F.col(id_col).alias("id"), signed(F.col(text_col), words, bands, rows).alias("s")).withColumn("node", F.monotonically_increasing_id())
    table = written(rows_of.select("node", "id", "s.hashes", F.size("s.hashes").alias("size"), "s.digest", "s.keys"), "near-rows")
    full = table.where("size > 0").select("node", "id", "size", "digest")
    distinct = written(full.groupBy("digest").agg(F.min("node").alias("node"), F.min("id").alias("low"), F.count("*").alias("copies")), "near-distinct")
    keyed = table.select("node", "size", "keys").join(distinct.select("node").hint("shuffle_hash"), "node", "left_semi")
    label = links(keyed, table.select("node", "size", "hashes"), similarity)
    named = written(distinct.join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "near-named")
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("__n"))
    classes = written(join_classes(named, lowest, "label", "__n").select("digest", "copies", "component_id"), "near-classes")
    found = join_classes(full, classes, "digest", "copies").select("id", "size", "component_id")
    none = table.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return found.unionByName(none).select(F.col("id").alias(id_col), F.col("size").cast("bigint").alias("n_shingles"), "component_id")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5) -> DataFrame:
    """df with the row of the smallest id of each component; ids must tell rows apart, rows with a null id stay."""
    gone = near_duplicates(df.where(F.col(id_col).isNotNull()), id_col, text_col, similarity, words).where(F.col(id_col) != F.col("component_id")).select(id_col)
    return df.join(gone, id_col, "left_anti")
