"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a batch are sorted into buckets
by length and laid out as padded matrices of token ids. In each round every row merges its leftmost
pair of minimum rank and is compacted by one column; ranks of pairs come from an open-addressing hash table
over (left id, right id), and only the ranks beside a merge are looked up again. Rows without a mergeable pair
leave the matrix. A piece that is itself a token is taken at once, as the reference tokenizers do. A piece of more than
LONG bytes is a matrix of one row, which merges all pairs of minimum rank at once, from the left up to the first merge
that gives rise to a rank as low: the same merges in the same order, in fewer rounds.

Rules: null text counts as empty and gives no ids; special tokens are ordinary text; lone surrogates can't
occur in Spark strings. decode() joins the tokens' bytes; null ids give empty bytes, an unknown id is an error.
Repeated rows give repeated rows. Only the id and text columns are read. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import batches, ragged

NONE = np.int32(2**31 - 1)  #: the rank of a pair that doesn't merge
CHARS = 1_000_000  #: characters encoded at once
PIECES = 150_000  #: pieces remembered between batches
LONG = 2_000  #: bytes of a piece beyond which its row stands alone


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id, of a file with a line `base64 rank` for each token."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """(left id, right id) to merged id, by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while todo.size:
            free = self.keys[at] == np.uint64(2**64 - 1)
            cells, first = np.unique(at[free], return_index=True)
            put = todo[free][first]
            self.keys[cells], self.ids[cells] = keys[put], merged[put]
            rest = self.keys[at] != keys[todo]
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE where the pair doesn't merge. Negative ids are padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._home(keys[todo])
        while todo.size:
            cell = self.keys[at]
            hit = cell == keys[todo]
            out[todo[hit]] = self.ids[at[hit]]
            rest = ~hit & (cell != np.uint64(2**64 - 1))
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        return out


class Bpe:
    """Encodes pieces by ranks; holds what a task needs."""

    def __init__(self, tokens: list[bytes]):
        self.whole = {t: i for i, t in enumerate(tokens) if t}
        pairs = [(self.whole[t[:k]], self.whole[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.whole and t[k:] in self.whole]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.byte = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)

    def state(self) -> tuple:
        """Plain values from which of() builds this again."""
        return self.whole, self.byte, vars(self.pairs)

    @classmethod
    def of(cls, state: tuple) -> Bpe:
        out = cls.__new__(cls)
        out.pairs = PairTable.__new__(PairTable)
        out.whole, out.byte = state[:2]
        vars(out.pairs).update(state[2])
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        todo = []
        for i, piece in enumerate(pieces):
            if (one := self.whole.get(piece)) is not None:
                out[i] = np.array([one], np.int32)
            elif len(piece) > LONG:
                out[i] = self._merge_long(piece)
            elif piece:
                todo.append(i)
        rows = np.array(todo, np.int64)
        width = np.where(sizes[rows] <= 32, sizes[rows], 1 << np.ceil(np.log2(np.maximum(sizes[rows], 1))).astype(np.int64))
        for w in np.unique(width):
            own = rows[width == w]
            step = max(1, 1_000_000 // int(w))  # keeps a matrix near a million cells
            for k in range(0, len(own), step):
                part = own[k : k + step]
                for i, ids in zip(part.tolist(), self._merge([pieces[j] for j in part], sizes[part])):
                    out[i] = ids
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1  # of places side by side, whose pairs overlap
            at = at[(at - at[np.flatnonzero(np.diff(run, prepend=-1))][run]) % 2 == 0]
            # A merge's neighbours at its time: the left one may be merged before it, the right one isn't yet.
            left, right = ids[at - 1], ids[np.minimum(at + 2, len(ids) - 1)]
            left[1:][np.diff(at) == 2] = best
            left[at == 0], right[at + 2 >= len(ids)] = -1, -1
            merged = np.full(len(at), best, np.int32)
            low = np.minimum(self.pairs.get(left, merged), self.pairs.get(merged, right)) <= best
            if low.any():
                at = at[: low.argmax() + 1]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            new = at - np.arange(len(at))
            for k in (new - 1, new):
                k = k[(k >= 0) & (k < len(ranks))]
                ranks[k] = self.pairs.get(ids[k], ids[k + 1])
        return ids

    def _merge(self, pieces: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        n, width = len(pieces), int(sizes.max())
        ids = np.full((n, width + 1), -1, np.int32)  # the last column stays padding
        ids[np.repeat(np.arange(n), sizes), ragged(np.zeros(n, np.int64), sizes)] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        final, alive = [np.zeros(0, np.int32)] * n, np.arange(n)
        while True:
            rows = np.arange(len(alive))
            at = ranks.argmin(axis=1)  # the leftmost of the smallest
            best = ranks[rows, at]
            ended = best == NONE
            if ended.any():
                kept = ids[ended]
                length = (kept >= 0).sum(axis=1)
                flat, stop = kept[kept >= 0], np.cumsum(length)
                for i, a, b in zip(alive[ended].tolist(), (stop - length).tolist(), stop.tolist()):
                    final[i] = flat[a:b]
                alive, ids, ranks, at, best = alive[~ended], ids[~ended], ranks[~ended], at[~ended], best[~ended]
                if not alive.size:
                    return final
                rows = np.arange(len(alive))
            ids[rows, at] = best
            # Compaction: what follows the pair moves one column to the left.
            stay = np.ones(ids.shape, bool)
            stay[rows, at + 1] = False
            ids = ids[stay].reshape(len(alive), -1)
            if ids.shape[1] == 1:  # one token and no padding column: nothing is left to merge
                ids, ranks = np.concatenate([ids, np.full((len(ids), 1), -1, np.int32)], axis=1), np.full((len(ids), 1), NONE, np.int32)
                continue
            stay = np.ones(ranks.shape, bool)
            stay[rows, at] = False
            ranks = ranks[stay].reshape(len(alive), -1)
            right = rows[at < ranks.shape[1]]
            ranks[right, at[right]] = self.pairs.get(ids[right, at[right]], ids[right, at[right] + 1])
            left = rows[at > 0]
            ranks[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])


class _Index(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


#: Up to U+017F these ranges are all of \\p{L} and \\p{N}. Texts of these characters, which the
#: standard library's faster engine cuts alike, are the usual case; all others go to `regex`.
PLAIN = re.compile("[\t-\r -~\u00a1-\u017f]*")
LETTERS, NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"


def splitter(pattern: str):
    """A function from a text to the pattern's matches, as regex.findall."""
    full = regex.compile(pattern).findall
    classes = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    if r"\p" in classes:
        return full
    fast = re.compile(classes).findall
    return lambda text: fast(text) if PLAIN.fullmatch(text) else full(text)


class Encoder:
    """Texts to ids, with the pieces met lately remembered."""

    def __init__(self, bpe: Bpe, pattern: str):
        self.bpe, self.find = bpe, splitter(pattern)
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.pool, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and each text's number of ids."""
        if len(self.index) > PIECES:
            self.clear()
        index, start = self.index, len(self.index)
        counts, flat = [], []
        for text in texts:
            pieces = self.find(text)
            counts.append(len(pieces))
            flat.append(np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces)))
        if len(index) > start:
            fresh = self.bpe.encode_pieces([p.encode("utf-8", "surrogatepass") for p in list(index)[start:]])
            self.pool = np.concatenate([self.pool, *fresh])
            self.size = np.concatenate([self.size, np.fromiter(map(len, fresh), np.int64, len(fresh))])
        at = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        sizes = self.size[at]
        ids = self.pool[ragged((np.cumsum(self.size) - self.size)[at], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts, dtype=np.int64)
        return ids, upto[ends] - upto[ends - np.array(counts, np.int64)]


def _encoding(state, pattern: str, id_col: str):
    """A function of batches (id, text) to batches (id, ids)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Bpe.of(state.value), pattern)
        for batch in it:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in batches(texts, CHARS):
                ids, sizes = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=[id_col, "ids"])

    return run


def _decoding(state, names: list[str], ids_col: str):
    """A function of batches to batches with the bytes of ids_col."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, start, size = state.value
        for batch in it:
            lists = batch.column(names.index(ids_col))
            step = max(1, 2_000_000 * batch.num_rows // (1 + lists.nbytes))
            for k in range(0, batch.num_rows, step):
                part = lists.slice(k, step)
                flat = part.flatten().to_numpy()  # a null list has no elements
                ends = np.cumsum([x or 0 for x in pa.compute.list_value_length(part).to_pylist()])
                sizes = size[flat]
                upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
                data = pool[ragged(start[flat], sizes)]
                out = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*batch.slice(k, step).columns, out], names=[*names, "decoded"])

    return run


DECODED = T.StructField("decoded", T.BinaryType())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, T.StructType]:
    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows, T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array<int>) of every row; path: a rank file that the driver can read."""
    rows, schema = _rows(docs, id_col, text_col)
    return rows.mapInArrow(_encoding(_vocabulary(docs.sparkSession, path), pattern, id_col), schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a further column, decoded (binary): the bytes that the ids stand for."""
    run = _decoding(_token_bytes(encoded.sparkSession, path), encoded.columns, ids_col)
    return encoded.mapInArrow(run, T.StructType([*encoded.schema, DECODED]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids, decoded: decode() of encode() in one Python worker."""
    rows, schema = _rows(docs, id_col, text_col)
    there = _encoding(_vocabulary(docs.sparkSession, path), pattern, id_col)
    back = _decoding(_token_bytes(docs.sparkSession, path), [id_col, "ids"], "ids")
    return rows.mapInArrow(lambda it: back(there(it)), T.StructType([*schema, DECODED]))


def _vocabulary(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Bpe(load_ranks(path)).state())  # the vocabulary's size, not the data's


def _token_bytes(spark: SparkSession, path: str):
    tokens = load_ranks(path)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size))
