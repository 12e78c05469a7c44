"""Language identification by a linear-chain conditional random field over words.

Each word of a text is a position whose label is a language. Its score for a label sums weights of hashed features:
the word itself (a learned lexicon), its prefixes and suffixes of 1 to 4 characters and its character n-grams
of 2 to 4; a learned matrix scores the transitions, so a text may switch its language. Training
maximises the conditional likelihood of runs of words labelled with their document's language, by Adam on mini-batches
with gradients from the forward-backward pass. Prediction runs forward-backward over every whole text:
long chains are cut into pieces of SPAN words whose transfer matrices are multiplied in parallel and then combined,
which is exact. A text's language is the label with the largest share of the words' marginals, its score that share.

Fitting takes a bounded sample: at most `max_rows` labelled documents a language (the smallest by MD5 of the id), one row an id (of repeats the
greatest text), and of these, in the same order, as many as hold the language's part of `budget` characters. A text of over `max_chars`
characters teaches by stretches from all over it (common.passages). So the one task that fits holds about `budget` characters. All languages are
learned: with more than 64 of them, features are hashed to fewer buckets, so that the model keeps its size.

Rules: of languages with equal shares the first by name is predicted; words without a letter take no part; null text and text without a letter give `und` and score 0; upper
case counts as lower case; with no labelled text everything is `und`. Only rows with an id, a text and a language teach.
Repeated rows are scored alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import batches, bounded, hash60, passages, ragged, within_budget
from millrace.llm.textvec import Words

BUCKETS = 1 << 17  #: of features, for up to 64 languages
SPAN = 32  #: words of a piece
CHARS = 400_000
GRAMS, AFFIXES = (2, 3, 4), (1, 2, 3, 4)


def buckets_for(labels: int) -> int:
    """Buckets of features, a power of two: as many as 64 languages' weights for 2^17 take in all."""
    return max(1 << 8, min(BUCKETS, 1 << ((64 * BUCKETS) // max(1, labels)).bit_length() - 1))


class Chains:
    """The lettered words of texts: word (number among the distinct ones), doc, and their features."""

    def __init__(self, texts: list[str], buckets: int = BUCKETS):
        words = Words([t.lower() for t in texts])
        ok = words.lettered()[words.which] if len(words.which) else np.zeros(0, bool)
        used, self.word = np.unique(words.which[ok], return_inverse=True)
        self.doc, self.distinct = words.doc[ok], len(used)
        number = np.full(len(words.unique), -1, np.int64)
        number[used] = np.arange(len(used))
        found = [words.grams(GRAMS, buckets, 1), words.affixes(AFFIXES, buckets, 2)]
        owner, feature = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        owner = number[owner]
        owner, feature = owner[owner >= 0], feature[owner >= 0]
        order = np.argsort(owner, kind="stable")
        self.owner, self.feature = owner[order], feature[order]
        self.first = np.searchsorted(self.owner, np.arange(self.distinct))
        self.share = 1 / np.diff(np.append(self.first, len(self.owner))).astype(np.float64)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Each distinct word's score for each label: the average of its features' weights."""
        if not self.distinct:
            return np.zeros((0, weights.shape[1]))
        return np.add.reduceat(weights[self.feature], self.first, axis=0) * self.share[:, None]


def forward_backward(scores: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scores: exponentials, n x span x labels; length: of each piece (1 or more). start, end: the messages into each
    piece's first and out of its last word, n x labels. Returns scaled forward and backward messages."""
    n, span, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.empty_like(scores)
    a = start * scores[:, 0]
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, span):
        a = alpha[:, t - 1] @ trans * scores[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    b = end
    for t in range(span - 1, -1, -1):
        last = (length - 1 == t)[:, None]
        b = np.where(last, end, b)
        beta[:, t] = b
        b = (b * scores[:, t]) @ trans.T
        b /= b.sum(axis=1, keepdims=True)
    return alpha, beta


def pieces(doc: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the pieces that chains (runs of one doc) are cut into."""
    if not len(doc):
        return doc, doc
    first = np.append(0, np.flatnonzero(np.diff(doc)) + 1)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    at = np.flatnonzero(place % span == 0)
    return at, np.diff(np.append(at, len(doc)))


def padded(first: np.ndarray, length: np.ndarray, span: int) -> np.ndarray:
    """n x span word numbers; places past a piece's end repeat its last word."""
    return first[:, None] + np.minimum(np.arange(span)[None, :], length[:, None] - 1)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray  #: label by label, logarithms
    start: np.ndarray

    def marginals(self, chains: Chains) -> np.ndarray:
        """Each word's probability of each label, given the whole chain."""
        k, n = len(self.labels), len(chains.word)
        if not n:
            return np.zeros((0, k))
        trans, begin = np.exp(self.trans), np.exp(self.start)
        e = chains.emissions(self.weights)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        first, length = pieces(chains.doc, SPAN)
        scores = e[chains.word[padded(first, length, SPAN)]]
        # A piece's transfer matrix takes the message of the word before it to that of its last word.
        move = np.broadcast_to(np.eye(k), (len(first), k, k)).copy()
        for t in range(SPAN):
            new = (move @ trans) * scores[:, t][:, None, :]
            new /= new.sum(axis=(1, 2), keepdims=True)
            move = np.where((length > t)[:, None, None], new, move)
        back = np.broadcast_to(np.eye(k), (len(first), k, k)).copy()
        for t in range(SPAN - 1, -1, -1):
            new = trans @ (scores[:, t][:, :, None] * back)
            new /= new.sum(axis=(1, 2), keepdims=True)
            back = np.where((length > t)[:, None, None], new, back)
        head = np.append(True, np.diff(chains.doc[first]) != 0)
        into, out = np.empty((len(first), k)), np.ones((len(first), k))
        into[head] = begin
        # Chains side by side: piece number r of every chain at once.
        chain = np.cumsum(head) - 1
        rank = np.arange(len(first)) - np.flatnonzero(head)[chain]
        order = np.argsort(rank, kind="stable")
        cuts = np.append(np.searchsorted(rank[order], np.arange(rank.max() + 1)), len(order))
        held = np.zeros((chain[-1] + 1, k))  # each chain's message out of its last piece so far
        for r in range(1, len(cuts) - 1):
            at = order[cuts[r] : cuts[r + 1]]
            if r == 1:  # the first word has no word before it
                sent = self._first_piece(scores[at - 1], length[at - 1], trans, begin)
            else:
                sent = np.einsum("nk,nkl->nl", held[chain[at]], move[at - 1])
            sent /= sent.sum(axis=1, keepdims=True)
            held[chain[at]] = sent
            into[at] = sent @ trans
        tail = np.append(head[1:], True)
        for r in range(len(cuts) - 3, -1, -1):
            at = order[cuts[r] : cuts[r + 1]]
            at = at[~tail[at]]
            sent = np.einsum("nkl,nl->nk", back[at + 1], out[at + 1])
            out[at] = sent / sent.sum(axis=1, keepdims=True)
        alpha, beta = forward_backward(scores, length, trans, into, out)
        both = alpha * beta
        both /= both.sum(axis=2, keepdims=True)
        return both[np.arange(SPAN)[None, :] < length[:, None]]

    @staticmethod
    def _first_piece(scores: np.ndarray, length: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> np.ndarray:
        a = begin * scores[:, 0]
        for t in range(1, scores.shape[1]):
            new = a @ trans * scores[:, t]
            a = np.where((length > t)[:, None], new / new.sum(axis=1, keepdims=True), a)
        return a

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Each text's language and score."""
        chains = Chains(texts, len(self.weights))
        total = np.zeros((len(texts), len(self.labels)))
        if self.labels and len(chains.word):
            p = self.marginals(chains)
            for j in range(p.shape[1]):
                total[:, j] = np.bincount(chains.doc, weights=p[:, j], minlength=len(texts))
        words = total.sum(axis=1)
        best = total.argmax(axis=1) if self.labels else np.zeros(len(texts), np.int64)
        score = np.where(words > 0, total.max(axis=1, initial=0) / np.maximum(words, 1e-300), 0.0)
        return [self.labels[b] if w > 0 else "und" for b, w in zip(best.tolist(), words.tolist())], score


def gradients(params: dict[str, np.ndarray], chains: Chains, first: np.ndarray, length: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of the negative log-likelihood a word of pieces that start at `first` and have one label each (gold): (that by the weights of the features
    seen, these features, those by transitions t and starts s)."""
    k = len(params["s"])
    words = chains.word[padded(first, length, SPAN)]
    own, which = np.unique(words, return_inverse=True)
    which = which.reshape(words.shape)
    n_feats = np.diff(np.append(chains.first, len(chains.owner)))[own]
    feats = chains.feature[ragged(chains.first[own], n_feats)]
    starts = np.cumsum(n_feats) - n_feats
    e = np.add.reduceat(params["w"][feats], starts, axis=0) * chains.share[own][:, None]
    score = np.exp(e - e.max(axis=1, keepdims=True))[which]
    trans, begin = np.exp(params["t"]), np.exp(params["s"])
    inside = np.arange(SPAN)[None, :] < length[:, None]
    alpha, beta = forward_backward(score, length, trans, np.broadcast_to(begin, (len(first), k)), np.ones((len(first), k)))
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    dp = p - np.eye(k)[gold][:, None, :]
    dp[~inside] = 0
    scale = 1 / inside.sum()
    de = np.stack([np.bincount(which.ravel(), weights=dp[:, :, j].ravel(), minlength=len(own)) for j in range(k)], axis=1) * scale
    pair = alpha[:, :-1, :, None] * trans * (score * beta)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    both = inside[:, 1:]
    dt = pair[both].sum(axis=0)
    np.subtract.at(dt, (gold, gold), both.sum(axis=1))
    grads = {"t": dt * scale, "s": dp[:, 0].sum(axis=0) * scale}
    spread = np.repeat(de * chains.share[own][:, None], n_feats, axis=0)
    seen, back = np.unique(feats, return_inverse=True)
    gw = np.stack([np.bincount(back, weights=spread[:, j], minlength=len(seen)) for j in range(k)], axis=1)
    return gw, seen, grads


def fit(texts: list[str], langs: list[str], epochs: int = 3, batch: int = 1024, rate: float = 0.05, seed: int = 3) -> Crf:
    labels = sorted(set(langs))
    k = len(labels)
    if not k:
        return Crf([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    buckets = buckets_for(k)
    chains = Chains(texts, buckets)
    gold_of = np.array([labels.index(x) for x in langs])
    first, length = pieces(chains.doc, SPAN)
    params = {"w": np.zeros((buckets, k)), "t": np.zeros((k, k)), "s": np.zeros(k)}
    moment = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in params.items()}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(first))
        for at in np.array_split(order, max(1, len(order) // batch)):
            if not len(at):
                continue
            step += 1
            gw, seen, grads = gradients(params, chains, first[at], length[at], gold_of[chains.doc[first[at]]])
            for name, g, rows_ in (("w", gw, seen), ("t", grads["t"], slice(None)), ("s", grads["s"], slice(None))):
                m, v = moment[name]
                m[rows_] = 0.9 * m[rows_] + 0.1 * g
                v[rows_] = 0.99 * v[rows_] + 0.01 * g * g
                lift = 4.0 if name == "w" else 0.2  # a word's score is an average of weights, so these move further
                params[name][rows_] -= rate * lift * (m[rows_] / (1 - 0.9**step)) / (np.sqrt(v[rows_] / (1 - 0.99**step)) + 1e-6)
    return Crf(labels, params["w"], np.clip(params["t"], -6, 6), params["s"])


def train(docs: DataFrame, max_rows: int = 300, max_chars: int = 200_000, budget: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Fits on the rows given; the caller leaves out what must stay unseen."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = max(1, known.agg(F.count_distinct("lang")).first()[0])
    hashed = known.select("lang", "id", hash60(F.col("id").cast("string")).alias("h"))
    few = bounded(hashed, "lang", "h", max_rows).select("lang", "id", "h")
    sample = known.join(F.broadcast(few), ["lang", "id"]).groupBy("id", "lang", "h").agg(F.max(passages(F.col("text"), F.col("id"), max_chars)).alias("text"))
    sample = within_budget(sample, "lang", "text", ["h", "id"], budget // langs)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in it for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        crf = fit([r[2] for r in rows], [r[1] for r in rows])
        arrays = [pa.array([crf.labels], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (crf.weights.astype(np.float32), crf.trans, crf.start))]
        yield pa.RecordBatch.from_arrays(arrays, names=["labels", "w", "t", "s"])

    row = sample.select("id", "lang", "text").repartition(1).mapInArrow(run, "labels array<string>, w binary, t binary, s binary").first()
    if row is None:  # nothing to learn from
        return fit([], [])
    labels = list(row["labels"])
    k = len(labels)
    return Crf(labels, np.frombuffer(row["w"], np.float32).reshape(-1, k), np.frombuffer(row["t"]).reshape(k, k), np.frombuffer(row["s"]))


def predict(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(crf))  # BUCKETS x languages numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(**shared.value)
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches(texts, CHARS):
                langs, scores = own.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(langs, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
