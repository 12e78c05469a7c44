"""Alignment of two tokenizers over a corpus: which tokens of one end where tokens of the other do, and how often.

Tokenizer A is a byte-level BPE (a vocabulary file in JSON), B a sentencepiece model. Equal texts meet by a shuffle on the full text,
combined in each task first, and every distinct text is tokenised and aligned once, by a task that then knows how often the text occurs. Byte offsets where
tokens of both end cut a text into groups; the two tokens that end there are a link. A text's links are written as
distinct pairs of ids, in order, packed to a few bytes each.

A pair's count is the number of links of all texts, repeats included. A task adds up the pairs of its own texts before they move. Then each text's
links meet the counts: pairs with more than 1/SPREAD of all links number fewer than SPREAD, whatever the data, and are broadcast; links of other pairs
meet them in a shuffled join that no pair dominates. The highest count of each B id is broadcast too: there are as many as B has ids.
Rows find their text's measures by its SHA-256, texts of many rows by broadcast (common.attach).

Rules: null text counts as empty; a text that is empty, or whose tokens' bytes (of A or of B) don't join to a blank and the text again, has no
tokens: zeros, and '' for the digest of its groups. Control strings inside a text are plain text. Every row counts, with a null or repeated id
too. Texts are tokenised whole. Empty tables give empty results. Only id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import attach, batches, keep

#: Pairs that are broadcast number fewer than this (16 bytes each).
SPREAD = 1_000_000
#: Links that a task adds up at once, and distinct pairs that it holds.
HELD = 4_000_000
B_BITS = 24
NO_PAIRS = np.zeros(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Tokenizer A from its JSON file. Merges must be ranked as ids are, which is checked."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        alphabet, special = byte_alphabet(), {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        order = [model["model"]["vocab"][a + b] for a, b in merged]
        if order != sorted(order):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.inner = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.inner.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Tokenizer B from its model file. The library writes a blank before the text itself."""

    def __init__(self, path: str):
        self.inner = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.inner.encode(texts, num_threads=1)


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs and their numbers: gaps and numbers, byte planes apart, compressed."""
    gaps = np.diff(pairs, prepend=0)
    planes = [a.astype("<u8").view(np.uint8).reshape(-1, 8).T for a in (gaps, times)]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(16, -1)
    gaps, times = (np.ascontiguousarray(planes[k : k + 8].T).view("<u8").ravel().astype(np.int64) for k in (0, 8))
    return np.cumsum(gaps), times


def align(a: list[int], b: list[int], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A ids, B ids, places in A, places in B): the tokens before each common end, the end included."""
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    _, at_a, at_b = np.intersect1d(np.cumsum(size_a[a]), np.cumsum(size_b[b]), assume_unique=True, return_indices=True)
    return a, b, at_a + 1, at_b + 1


def spelled(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
    """The groups as `a1,a2|b1;a3|b2,b3`: A's ids, a bar, B's ids; groups apart by semicolons."""
    left, right = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for p, q in zip(cut_a.tolist(), cut_b.tolist()):
        out.append(f"{','.join(left[i:p])}|{','.join(right[j:q])}")
        i, j = p, q
    return ";".join(out)


def aligned_texts(docs: DataFrame, path_a: str, pattern: str, path_b: str, text_col: str = "text") -> DataFrame:
    """One row per distinct text: digest, copies, n_a, n_b, n_groups, groups_sha256, links (packed)."""
    distinct = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteBpe(path_a, pattern), Pieces(path_b)
        size_a, size_b = (np.fromiter(map(len, t.bytes), np.int64, len(t.bytes)) for t in (one, two))
        for batch in it:
            texts, numbers, shas, links = batch.column(0).to_pylist(), np.zeros((3, batch.num_rows), np.int64), [], []
            for start, stop in batches(texts, 1_000_000):
                part = texts[start:stop]
                for k, (text, a, b) in enumerate(zip(part, one.encode(part), two.encode(part)), start):
                    want = b" " + text.encode("utf-8", "surrogatepass")
                    if not text or any(b"".join(map(t.bytes.__getitem__, ids)) != want for t, ids in ((one, a), (two, b))):
                        shas.append("")
                        links.append(None)
                        continue
                    a, b, cut_a, cut_b = align(a, b, size_a, size_b)
                    numbers[:, k] = len(a), len(b), len(cut_a)
                    shas.append(hashlib.sha256(spelled(a, b, cut_a, cut_b).encode()).hexdigest())
                    links.append(pack(*np.unique(a[cut_a - 1] << B_BITS | b[cut_b - 1], return_counts=True)))
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            cols = [pa.array(digests, pa.binary()), batch.column(1), *map(pa.array, numbers), pa.array(shas, pa.string()), pa.array(links, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["digest", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return distinct.mapInArrow(run, "digest binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary")


def _added(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, at, times)
    return distinct, out


def pair_counts(texts: DataFrame) -> DataFrame:
    """aligned_texts() -> (pair, n): links of each pair of ids over all rows; pair is A's id, shifted, and B's."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, size = (NO_PAIRS, NO_PAIRS), [], 0

        def flush(sums) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in sums], names=["pair", "n"])

        for batch in it:
            for raw, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, times = unpack(raw)
                held.append((pairs, times * copies))
                size += len(pairs)
                if size >= HELD:
                    done, held, size = _added(*map(np.concatenate, zip(done, *held))), [], 0
                    if len(done[0]) >= HELD:
                        yield flush(done)
                        done = (NO_PAIRS, NO_PAIRS)
        yield flush(_added(*map(np.concatenate, zip(done, *held))))

    return texts.where("links IS NOT NULL").select("links", "copies").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _best(counts: DataFrame) -> np.ndarray:
    """By B id, the highest count of its pairs: as many numbers as B has ids."""
    rows = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).cast("int").alias("b")).agg(F.max("n").alias("n")).toPandas()
    out = np.zeros(int(rows["b"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["b"].to_numpy()] = rows["n"].to_numpy()
    return out


def measured(texts: DataFrame, counts: DataFrame, spread: int = SPREAD) -> DataFrame:
    """aligned_texts() with n_best and count_sum, and without links."""
    spark, best = texts.sparkSession, _best(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * spread > total  # fewer than `spread` pairs
    hot = counts.where(often).toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), best))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in it:
            numbers, rest, more = np.zeros((2, batch.num_rows), np.int64), [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                if raw is None:
                    rest.append(None)
                    more.append(None)
                    continue
                own, times = unpack(raw)
                at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
                known = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                count = n[at[known]] if known.any() else NO_PAIRS
                top = count == best[own[known] & ((1 << B_BITS) - 1)]
                numbers[:, k] = times[known][top].sum(), (times[known] * count).sum()
                rest.append(own[~known])
                more.append(times[~known])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers), pa.array(rest, longs), pa.array(more, longs)], names=["digest", "n_best", "count_sum", "pairs", "times"])

    some = keep(texts.select("digest", "links").mapInArrow(run, "digest binary, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"), "crosstoken-links")
    each = some.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("digest", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    tops = spark.createDataFrame([(i, int(x)) for i, x in enumerate(best.tolist())], "b int, top bigint")
    rare = counts.where(~often).join(F.broadcast(tops), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)) == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("is_top"))
    found = each.join(rare, "pair").groupBy("digest").agg(F.sum(F.when(F.col("is_top"), F.col("times")).otherwise(0)).alias("best2"), F.sum(F.col("times") * F.col("n")).alias("sum2"))
    both = some.select("digest", "n_best", "count_sum").unionByName(found.select("digest", F.col("best2").alias("n_best"), F.col("sum2").alias("count_sum")))
    whole = both.groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.drop("links").join(whole, "digest")


def cross_tokenizer(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    texts = keep(aligned_texts(docs, path_a, pattern, path_b, text_col), "crosstoken-texts")
    counts = keep(pair_counts(texts), "crosstoken-counts")
    classes = keep(measured(texts, counts), "crosstoken-classes")
    rows = docs.select(F.col(id_col).alias(id_col), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("__digest"))
    # No two tokens of one text end at one place, so each group has one link.
    named = classes.select(F.col("digest").alias("__digest"), "copies", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
    return attach(rows, named, "__digest", "copies").drop("__digest", "copies")


def lexicon(counts: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """pair_counts() as (a, b, a_bytes, b_bytes, n): what each linked pair of ids spells."""
    one, two = ByteBpe(path_a, pattern).bytes, Pieces(path_b).bytes
    spark = counts.sparkSession
    left = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(one)], "a int, a_bytes binary")
    right = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(two)], "b int, b_bytes binary")
    ids = counts.select(F.shiftright("pair", B_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).cast("int").alias("b"), "n")
    return ids.join(F.broadcast(left), "a").join(F.broadcast(right), "b").select("a", "b", "a_bytes", "b_bytes", "n")
