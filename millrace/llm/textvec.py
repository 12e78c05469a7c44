"""Words of many texts and their hashed subword features, as numpy arrays."""

from __future__ import annotations

import numpy as np

from millrace.llm.common import mix64, ragged

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def _steps(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to 4095 of a base, and powers of its 4096th power up to n."""
    def run(x: int, k: int) -> np.ndarray:
        out = np.full(k, x, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(base, 4096), run(pow(base, 4096, 2**64), (n >> 12) + 1)


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each codes[start:end], from one prefix sum."""
    n = len(codes)
    small, large = _steps(BASE, n)
    upto = np.multiply.outer(large, small).ravel()[: n + 1]
    upto[1:] = upto[:-1].copy()
    upto[0] = 0
    upto[1:] *= codes.astype(np.uint64) + np.uint64(1)
    np.cumsum(upto, out=upto)
    small, large = _steps(INVERSE, n)
    return mix64((upto[ends] - upto[starts]) * small[starts & 4095] * large[starts >> 12])


class Words:
    """The words of texts (runs other than \\x20 and \\x09-\\x0D), in order.

    codes: code points of all texts, white space as 32, with a blank before and after each text;
    start, stop: each word's place in codes; doc: its text; unique, which: distinct words (as indices
    of one occurrence) and each word's number among these.
    """

    def __init__(self, texts: list[str]):
        self.texts = len(texts)
        joined = " " + " ".join(texts) + " "
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        blank = (self.codes == 32) | (self.codes >= 9) & (self.codes <= 13)
        self.codes[blank] = 32
        self.start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.stop = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.doc = np.searchsorted(ends, self.start, "right") if len(texts) else np.zeros(0, np.int64)
        self.doc = np.minimum(self.doc, max(0, len(texts) - 1))
        self.hash = range_hashes(self.codes, self.start, self.stop)
        _, self.unique, self.which = np.unique(self.hash, return_index=True, return_inverse=True)

    def lettered(self) -> np.ndarray:
        """For each distinct word, whether it holds a letter."""
        codes, owner, _ = self._spelled()
        low, back = np.unique(codes, return_inverse=True)
        alpha = np.array([chr(c).isalpha() if c < 0x110000 else False for c in low.tolist()], bool)
        out = np.zeros(len(self.unique), bool)
        out[owner[alpha[back]]] = True
        return out

    def _spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the distinct words with a blank on both sides, each one's word, and its place from the end."""
        start, size = self.start[self.unique] - 1, self.stop[self.unique] - self.start[self.unique] + 2
        owner = np.repeat(np.arange(len(size)), size)
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(int(size.sum()))
        return self.codes[ragged(start, size)], owner, left

    def grams(self, sizes: tuple[int, ...], buckets: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of every character n-gram of the distinct words, their outer blanks counting as
        characters, and of every distinct word itself."""
        codes, owner, left = self._spelled()
        words, found = [np.arange(len(self.unique))], [self.hash[self.unique] ^ np.uint64(salt)]
        for n in sizes:
            fits = np.flatnonzero(left >= n)
            h = np.full(len(fits), n + salt, np.uint64)
            for k in range(n):
                h = h * np.uint64(BASE) + codes[fits + k]
            words.append(owner[fits])
            found.append(mix64(h))
        return np.concatenate(words), (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)

    def affixes(self, sizes: tuple[int, ...], buckets: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of the distinct words' prefixes and suffixes."""
        codes, _, _ = self._spelled()
        size = self.stop[self.unique] - self.start[self.unique]
        first = np.cumsum(size + 2) - size - 1
        words, found = [], []
        for n in sizes:
            own = np.flatnonzero(size >= n)
            for kind, at in ((1, first[own]), (2, first[own] + size[own] - n)):
                h = np.full(len(own), salt + 8 * n + kind, np.uint64)
                for k in range(n):
                    h = h * np.uint64(BASE) + codes[at + k]
                words.append(own)
                found.append(mix64(h))
        return np.concatenate(words), (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)
