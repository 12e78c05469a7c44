"""Substring deduplication by super-k-mer partitioning.

A window is 13 consecutive words. Its minimiser is the smallest hash of the four-word runs in it, so most
neighbouring windows share one: such a run of windows, a super-k-mer, is one string of words. Documents are
packed into written chunks of a few megabytes. From a chunk, each distinct super-k-mer travels once, with the
smallest id that has it there, to the bucket of its minimiser, in one compressed string for each bucket. A bucket
sorts the windows of all its strings by a 64-bit hash, compares equal hashes byte for byte, and
tells each chunk which of its windows start in a smaller id elsewhere. The chunk is then read again, its
super-k-mers are found in the same order, and the covered words are removed.

A minimiser that makes up more than 1 / HOT of all super-k-mers (fewer than HOT such exist) would overload its
bucket; its windows are dealt one by one by their own hash instead. Chunks count their frequent minimisers
while they are packed. Copies within a chunk travel once, so a passage that many documents hold costs a bucket
one string a chunk.

Rules: words are runs other than \\x20 and \\x09-\\x0D, compared unchanged; null text has none. A word goes if a
window that covers it also starts in a row with a smaller id. Rows of one id don't remove each other's words;
rows with a null id come after all others. Texts are whole, whatever their length. Only the id and text
columns are read. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep, mix64, partitions, ragged
from millrace.llm.textvec import range_hashes

WINDOW, RUN = 13, 4  #: words
CHUNK = 3_000_000  #: bytes of text a chunk is cut at
BUCKET = 8_000_000  #: bytes of strings a bucket should hold
TASK = 24_000_000  #: bytes of strings, before compression, that a task should read
HOT = 5_000
NO_ID = 2**63 - 1


class Chunk:
    """Documents' words and super-k-mers. Texts are bytes, in order of id."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids = ids
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        blank = (raw == 32) | (raw >= 9) & (raw <= 13)
        before = np.concatenate([[True], blank[:-1]])
        kept = ~blank | ~before  # a blank stays only right after a word
        self.codes = np.where(blank, np.uint8(32), raw)[kept]
        at = np.flatnonzero(self.codes == 32)
        self.stop = at
        self.start = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.doc = np.searchsorted(ends, np.flatnonzero(before & ~blank), "right")
        self.words = np.bincount(self.doc, minlength=len(texts))
        self._minimise()

    def _minimise(self) -> None:
        n = len(self.start)
        windows = max(0, n - WINDOW + 1)
        self.valid = self.doc[:windows] == self.doc[n - windows :] if windows else np.zeros(0, bool)
        if not windows:
            self.low, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        runs = range_hashes(self.codes, self.start[: n - RUN + 1], self.stop[RUN - 1 :])
        self.low, self.place = runs[:windows].copy(), np.arange(windows)
        for k in range(1, WINDOW - RUN + 1):
            smaller = runs[k : k + windows] < self.low
            self.low[smaller] = runs[k : k + windows][smaller]
            self.place[smaller] = np.flatnonzero(smaller) + k

    def frequent(self, least: int = 6) -> tuple[int, np.ndarray, np.ndarray]:
        """Super-k-mers, and the minimisers with at least so many, with counts."""
        first, _ = self._runs(np.zeros(0, np.uint64))
        key, count = np.unique(self.low[first], return_counts=True)
        return len(first), key[count >= least], count[count >= least]

    def _runs(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each super-k-mer's first window and number of windows."""
        at = np.flatnonzero(self.valid)
        if not at.size:
            return at, at
        alone = np.isin(self.low[at], hot)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(self.place[at]) != 0) | alone[1:] | alone[:-1]
        first = np.flatnonzero(new)
        return at[first], np.diff(np.append(first, len(at)))

    def cut(self, hot: np.ndarray, buckets: int) -> None:
        """Sets first, count (of each super-k-mer), entry (its number among the distinct ones), rep (an
        entry's first super-k-mer) and bucket (of each entry)."""
        self.first, self.count = self._runs(hot)
        a, b = self.start[self.first], self.stop[self.first + self.count + WINDOW - 2] if len(self.first) else self.first
        own = range_hashes(self.codes, a, b) if len(a) else np.zeros(0, np.uint64)
        _, rep, entry = np.unique(own, return_index=True, return_inverse=True)
        size = b - a
        twin = rep[entry]
        other = np.flatnonzero(twin != np.arange(len(a)))
        bad = other[size[other] != size[twin[other]]]
        other = other[size[other] == size[twin[other]]]
        same = _equal(self.codes, a[other], a[twin[other]], size[other])
        for e in np.concatenate([bad, other[~same]]):  # equal hash, other bytes: an entry of its own
            entry[e] = len(rep)
            rep = np.append(rep, e)
        place = np.argsort(rep, kind="stable")  # entries are numbered as they come, so ids ascend
        rank = np.empty(len(rep), np.int64)
        rank[place] = np.arange(len(rep))
        self.entry, self.rep = rank[entry], rep[place]
        rep = self.rep
        lead = self.first[rep]
        key = self.low[lead].copy()
        alone = np.isin(key, hot)
        key[alone] = own[rep[alone]]
        self.bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)

    def pack(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, strings): each entry's number, size, smallest id and bytes."""
        order = np.argsort(self.bucket, kind="stable")
        lead = self.rep[order]
        a = self.start[self.first[lead]]
        size = self.stop[self.first[lead] + self.count[lead] + WINDOW - 2] + 1 - a  # with the blank after it
        low = self.ids[self.doc[self.first[lead]]]
        flat = self.codes[ragged(a, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        edges = np.append(np.flatnonzero(np.diff(self.bucket[order], prepend=-1)), len(order))
        press = zstandard.ZstdCompressor(level=3)
        for x, y in zip(edges[:-1], edges[1:]):
            yield int(self.bucket[order[x]]), press.compress(_pack_entries(order[x:y], size[x:y], low[x:y]) + flat[ends[x] : ends[y]].tobytes())

    def remove(self, entry: np.ndarray, offset: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which words go, given the windows of entries that start in a smaller id elsewhere."""
        base = np.cumsum(self.count[self.rep]) - self.count[self.rep]
        smallest = np.repeat(self.ids[self.doc[self.first[self.rep]]], self.count[self.rep])
        np.minimum.at(smallest, base[entry] + offset, low)
        window = ragged(self.first, self.count)
        first = smallest[ragged(base[self.entry], self.count)]
        gone = window[first < self.ids[self.doc[window]]]
        step = np.zeros(len(self.start) + WINDOW + 1, np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + WINDOW, -1)
        return np.cumsum(step)[: len(self.start)] > 0

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Each text's kept words, joined by one space."""
        own = np.flatnonzero(~gone)
        size = self.stop[own] - self.start[own] + 1
        data = self.codes[ragged(self.start[own], size)].tobytes()
        ends = np.cumsum(np.bincount(self.doc[own], weights=size, minlength=len(self.ids)).astype(np.int64)).tolist()
        return [data[a : max(a, b - 1)] for a, b in zip([0, *ends[:-1]], ends)]


def _equal(codes: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether codes[a:a+size] equals codes[b:b+size], for each triple (sizes over 0)."""
    if not len(a):
        return np.zeros(0, bool)
    differ = codes[ragged(a, size)] != codes[ragged(b, size)]
    return np.add.reduceat(differ, np.cumsum(size) - size, dtype=np.int64) == 0


def _pack_entries(entry: np.ndarray, size: np.ndarray, low: np.ndarray) -> bytes:
    """Numbers of ascending entries as differences, byte by byte, which compresses well."""
    columns = (np.diff(entry, prepend=0).astype(np.int32), size.astype(np.int32), np.diff(low, prepend=0).astype(np.int64))
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return np.array([len(entry)], np.int64).tobytes() + b"".join(planes)


def _unpack_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, size, low, bytes of the strings)."""
    n, out, at = int(np.frombuffer(data, np.int64, 1)[0]), [], 8
    for kind in (np.int32, np.int32, np.int64):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return np.cumsum(out[0]), out[1], np.cumsum(out[2]), np.frombuffer(data, np.uint8, -1, at)


def _pack_docs(ids: np.ndarray, texts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(texts)], np.int64).tobytes() + ids.tobytes() + sizes.tobytes() + b"".join(texts))


def _unpack_docs(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, sizes = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
    ends = (8 + 16 * n + np.cumsum(sizes)).tolist()
    return ids, [data[b - s : b] for s, b in zip(sizes.tolist(), ends)]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed documents: chunk, bytes, kmers (super-k-mers), frequent (minimiser, count), docs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort()
            ids, texts = np.array([i for i, _ in held], np.int64), [t for _, t in held]
            kmers, key, count = Chunk(ids, texts).frequent()
            pairs = [{"key": int(k), "n": int(n)} for k, n in zip(key.view(np.int64), count)]
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([size], pa.int64()), pa.array([kmers], pa.int64()), pa.array([pairs], pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))), pa.array([_pack_docs(ids, texts)], pa.binary())],
                names=["chunk", "bytes", "kmers", "frequent", "docs"],
            )

        for batch in it:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                held.append((NO_ID if i is None else i, data))
                size += len(data)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "chunk string, bytes bigint, kmers bigint, frequent array<struct<key:bigint,n:bigint>>, docs binary")


def _count(rows: pa.Table) -> pa.Table:
    """A bucket's windows that start in a smaller id elsewhere: chunk and packed (entry, offset, id)."""
    names, parts = rows["chunk"].to_pylist(), []
    for blob in rows["data"]:
        parts.append(_unpack_entries(zstandard.ZstdDecompressor().decompress(blob.as_py())))
    entry, size, low, codes = (np.concatenate([p[k] for p in parts]) for k in range(4))
    chunk = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    stop = np.flatnonzero(codes == 32)
    start = np.concatenate([[0], stop[:-1] + 1])
    string = np.searchsorted(np.cumsum(size), start, "right")
    windows = len(start) - WINDOW + 1
    lead = np.flatnonzero(string[:windows] == string[WINDOW - 1 :])
    a, length = start[lead], stop[lead + WINDOW - 1] - start[lead]
    hashed = range_hashes(codes, a, a + length)
    order = np.argsort(hashed, kind="stable")
    new = np.append(True, np.diff(hashed[order]) != 0)
    many = ~(new & np.append(new[1:], True))  # windows that are not alone
    order, group = order[many], np.cumsum(new)[many]
    owner = string[lead[order]]
    head = order[np.searchsorted(group, group, "left")] if len(order) else order
    same = (length[order] == length[head]).copy()
    same[same] = _equal(codes, a[order][same], a[head][same], length[order][same])
    known: dict[tuple[int, bytes], int] = {}
    for k in np.flatnonzero(~same):  # equal hash, other bytes: a group of its own
        text = codes[a[order[k]] : a[order[k]] + length[order[k]]].tobytes()
        group[k] = known.setdefault((int(group[k]), text), -1 - len(known))
    _, group = np.unique(group, return_inverse=True)
    smallest = np.full(group.max() + 1 if len(group) else 0, NO_ID, np.int64)
    np.minimum.at(smallest, group, low[owner])
    hit = smallest[group] < low[owner]
    owner, first, at = owner[hit], smallest[group][hit], lead[order[hit]]
    offset = at - np.searchsorted(string, owner, "left")
    out_chunk, out = [], []
    by = np.argsort(chunk[owner], kind="stable")
    edges = np.append(np.flatnonzero(np.diff(chunk[owner][by], prepend=-1)), len(by))
    for x, y in zip(edges[:-1], edges[1:]):
        own = by[x:y]
        out_chunk.append(names[chunk[owner[own[0]]]])
        out.append(zstandard.ZstdCompressor(level=1).compress(entry[owner[own]].astype(np.int32).tobytes() + offset[own].astype(np.int32).tobytes() + first[own].tobytes()))
    return pa.table({"chunk": pa.array(out_chunk, pa.string()), "hits": pa.array(out, pa.binary())})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_words, n_removed, kept (bytes in UTF-8: the kept words joined by one space)."""
    spark = docs.sparkSession
    packed = keep(chunks(docs, id_col, text_col), "chunks")
    total, kmers = packed.agg(F.sum("bytes"), F.sum("kmers")).first()
    buckets = max(partitions(spark), -(-3 * (total or 0) // BUCKET))
    often = packed.select(F.explode("frequent").alias("f")).groupBy("f.key").agg(F.sum("f.n").alias("n"))
    # At most HOT minimisers can hold 1 / HOT of the super-k-mers each.
    hot = np.array([r["key"] for r in often.where(F.col("n") > max(100, (kmers or 0) // HOT)).select("key").collect()], np.int64).view(np.uint64)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk = Chunk(*_unpack_docs(blob.as_py()))
                chunk.cut(hot, buckets)
                rows = list(chunk.pack())
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([name] * len(rows), pa.string()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "chunk", "data"])

    dealt = packed.select("chunk", "docs").mapInArrow(deal, "bucket bigint, chunk string, data binary")
    # The tasks grow in number with the text, so that none grows with it.
    dealt = dealt.repartition(max(partitions(spark), -(-3 * (total or 0) // TASK)), "bucket")
    hits = dealt.groupBy("bucket").applyInArrow(_count, "chunk string, hits binary")
    hits = keep(hits, "substring-hits").groupBy("chunk").agg(F.collect_list("hits").alias("hits"))

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for blob, found in zip(batch.column(0), batch.column(1)):
                chunk = Chunk(*_unpack_docs(blob.as_py()))
                chunk.cut(hot, buckets)
                parts = [zstandard.ZstdDecompressor().decompress(x) for x in found.as_py() or []]
                n = [len(x) // 16 for x in parts]
                entry = np.concatenate([np.frombuffer(x, np.int32, k) for x, k in zip(parts, n)] or [np.zeros(0, np.int32)])
                offset = np.concatenate([np.frombuffer(x, np.int32, k, 4 * k) for x, k in zip(parts, n)] or [np.zeros(0, np.int32)])
                low = np.concatenate([np.frombuffer(x, np.int64, k, 8 * k) for x, k in zip(parts, n)] or [np.zeros(0, np.int64)])
                gone = chunk.remove(entry, offset, low)
                removed = np.bincount(chunk.doc[gone], minlength=len(chunk.ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.ids, pa.int64(), mask=chunk.ids == NO_ID), pa.array(chunk.words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(chunk.kept(gone), pa.binary())],
                    names=[id_col, "n_words", "n_removed", "kept"],
                )

    return packed.join(hits, "chunk", "left").select("docs", "hits").mapInArrow(finish, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept binary")
