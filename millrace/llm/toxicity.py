"""Toxicity scores from subword-bag embeddings.

A word's units are itself and its character n-grams (3 to 5, with the blanks around the word), hashed to
buckets with an embedding each, so an unseen misspelling shares most of its vectors with the word meant. A
passage of 16 words (a word that repeats its predecessor is passed over) is the average of its units'
embeddings, over 160 units at least, fed to a linear softmax over two classes;
embeddings and softmax are trained jointly in numpy (full-batch Adam). A document counts as its most toxic
passage, so that length doesn't dilute a score: in training only a toxic document's likeliest passages count
as toxic, chosen anew after each round, and every passage of the others counts as clean. A last logistic
fit maps a document's largest passage logit to a probability, with the labelled rows' own class shares.

Fitting takes a bounded sample: at most `max_rows` labelled documents of the table a class (the smallest by MD5 of the id), one row an id (of
repeats the greatest text), and of these, in the same order, as many as hold `budget` characters. A text of over `max_chars` characters teaches by
stretches from all over it (common.passages). So the one task that fits holds 2 x `budget` characters.
Scoring needs no shuffle: each task scores its rows with the broadcast table, one number a bucket.

Rules: null or wordless text has an average of zero and the score that follows; upper case counts as lower
case; labels other than 0 and 1 are left out; with no labelled rows of a class all scores are the share of
label 1 (0 without labels). Repeated rows score alike. Extra columns are ignored by score() and kept by judged().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import batches, bounded, hash60, passages, ragged, within_budget
from millrace.llm.textvec import Words

PASSAGE = 16  #: words
LEAST = 160  #: units that a passage's average is taken over at least, so that a few words alone weigh less
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 4
SCALE = 32.0  #: of the softmax's logits
EPS = 1e-3  #: of Adam: steps of buckets with smaller gradients, which few passages have, shrink
CHARS = 400_000


@dataclass
class Model:
    units: np.ndarray  #: each bucket's embedding times the difference of the softmax's rows
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))

    def score(self, texts: list[str]) -> np.ndarray:
        bag = Bag(texts)
        sums = np.bincount(bag.unit_word, weights=self.units[bag.unit], minlength=bag.distinct)
        logits = bag.passages(sums[:, None])[:, 0] * SCALE + self.bias
        raw = np.full(len(texts), -np.inf)
        np.maximum.at(raw, bag.passage_doc, logits)
        return self.probability(np.where(np.isneginf(raw), self.bias, raw))


class Bag:
    """Units of distinct words, and passages of words."""

    def __init__(self, texts: list[str]):
        words = Words([t.lower() for t in texts])
        self.distinct = len(words.unique)
        self.unit_word, self.unit = words.grams(GRAMS, BUCKETS)
        self.count = np.bincount(self.unit_word, minlength=self.distinct)
        new = np.ones(len(words.doc), bool)
        new[1:] = (words.doc[1:] != words.doc[:-1]) | (words.which[1:] != words.which[:-1])
        self.word, doc = words.which[new], words.doc[new]
        first = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1]) if len(doc) else np.zeros(0, np.int64)
        place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        self.first = np.flatnonzero(place % PASSAGE == 0)  # first words of passages
        self.passage_doc = doc[self.first]
        self.size = np.diff(np.append(self.first, len(doc)))
        self.total = np.maximum(LEAST, np.add.reduceat(self.count[self.word], self.first)) if len(self.first) else np.zeros(0, np.int64)

    def passages(self, of_words: np.ndarray) -> np.ndarray:
        """Averages over the units of each passage, given each distinct word's sum."""
        if not len(self.first):
            return np.zeros((0, of_words.shape[1]))
        return np.add.reduceat(of_words[self.word], self.first, axis=0) / self.total[:, None]


def forward(params: dict[str, np.ndarray], bag: Bag, unit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each passage's average, its two logits)."""
    mean = bag.passages(np.add.reduceat(params["e"][unit], starts, axis=0))
    return mean, SCALE * mean @ params["w"].T + params["b"]


def gradients(params: dict[str, np.ndarray], bag: Bag, unit: np.ndarray, unit_word: np.ndarray, starts: np.ndarray, toxic: np.ndarray, balance: np.ndarray) -> dict[str, np.ndarray]:
    """Of the cross-entropy of all passages, weighed by balance, by embeddings e and the softmax's w and b."""
    mean, z = forward(params, bag, unit, starts)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    dz = (p - np.stack([~toxic, toxic], axis=1)) * balance[:, None]
    of_token = np.repeat(SCALE * dz @ params["w"] / bag.total[:, None], bag.size, axis=0)
    grads = {"w": SCALE * dz.T @ mean, "b": dz.sum(axis=0), "e": np.empty_like(params["e"])}
    for d in range(params["e"].shape[1]):
        of_word = np.bincount(bag.word, weights=of_token[:, d], minlength=bag.distinct)
        grads["e"][:, d] = np.bincount(unit, weights=of_word[unit_word], minlength=len(params["e"]))
    return grads


def fit(texts: list[str], labels: np.ndarray, share: float, rounds: int = 4, steps: int = 16, seed: int = 7) -> Model:
    """share: the part of label 1 among all labelled rows."""
    if not (labels == 1).any() or not (labels == 0).any():
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    bag = Bag(texts)
    rng = np.random.default_rng(seed)
    order = np.argsort(bag.unit_word, kind="stable")
    unit, unit_word = bag.unit[order], bag.unit_word[order]
    used, unit = np.unique(unit, return_inverse=True)
    starts = np.cumsum(bag.count) - bag.count
    params = {"e": rng.normal(0, 0.02, (len(used), DIM)), "w": rng.normal(0, 0.5, (2, DIM)), "b": np.zeros(2)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    toxic = labels[bag.passage_doc] == 1
    weight = np.ones(len(bag.first))
    step = 0

    for round_ in range(rounds):
        for _ in range(steps):
            step += 1
            balance = np.where(toxic, 0.5 / max(weight[toxic].sum(), 1), 0.5 / max(weight[~toxic].sum(), 1)) * weight
            grads = gradients(params, bag, unit, unit_word, starts, toxic, balance)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[k] -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPS)
        _, z = forward(params, bag, unit, starts)
        logit = z[:, 1] - z[:, 0]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, bag.passage_doc, logit)
        if round_ < rounds - 1:
            weight = np.where(~toxic | (logit == best[bag.passage_doc]) | (logit > 2), 1.0, 0.0)
    units = np.zeros(BUCKETS, np.float32)
    units[used] = params["e"] @ (params["w"][1] - params["w"][0])
    bias = float(params["b"][1] - params["b"][0])
    raw = np.where(np.isneginf(best), bias, best)
    slope, shift = _platt(raw, labels)
    sample = (labels == 1).mean()
    shift += float(np.log(share / (1 - share)) - np.log(sample / (1 - sample)))
    return Model(units, bias, slope, shift)


def _platt(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """A logistic fit of labels on raw by Newton steps, with a small ridge."""
    mean, sd = raw.mean(), raw.std() + 1e-9
    x, theta = np.stack([(raw - mean) / sd, np.ones(len(raw))], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        theta -= np.linalg.solve(hess, x.T @ (p - labels) + 0.5 * theta)
    return float(theta[0] / sd), float(theta[1] - theta[0] * mean / sd)


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1000, max_chars: int = 200_000, budget: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on the labelled documents; the caller leaves out what must stay unseen."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    counts = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    there = rows.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")  # labels without a document take no places
    chosen = bounded(there.withColumn("__h", hash60(F.col("__id").cast("string"))), "__y", "__h", max_rows).select("__id", "__y", "__h")
    known = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__t")).join(F.broadcast(chosen), "__id")
    sample = known.groupBy("__id", "__y", "__h").agg(F.max(passages(F.col("__t"), F.col("__id"), max_chars)).alias("__t"))
    sample = within_budget(sample, "__y", "__t", ["__h", "__id"], budget)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in it for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        model = fit([t or "" for _, t, _ in rows], np.array([y for *_, y in rows], np.int64), share)
        yield pa.RecordBatch.from_arrays([pa.array([model.units.tobytes()], pa.binary()), *(pa.array([x]) for x in (model.bias, model.slope, model.shift))], names=["units", "bias", "slope", "shift"])

    row = sample.select("__id", "__t", "__y").repartition(1).mapInArrow(run, "units binary, bias double, slope double, shift double").first()
    if row is None:  # no labelled document
        return fit([], np.zeros(0, np.int64), share)
    return Model(np.frombuffer(row["units"], np.float32), row["bias"], row["slope"], row["shift"])


def score(docs: DataFrame, model: Model, out_col: str = "score", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and out_col (0 to 1) of every row."""
    return _scored(docs.select(id_col, text_col), model, out_col, text_col, None, [id_col])


def judged(docs: DataFrame, model: Model, most: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that score `most` or more; columns unchanged."""
    return _scored(docs, model, None, text_col, most, docs.columns)


def _scored(docs: DataFrame, model: Model, out_col: str | None, text_col: str, most: float | None, kept: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # BUCKETS numbers
    at, cols = docs.columns.index(text_col), [docs.columns.index(c) for c in kept]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in it:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            parts = [own.score(texts[a:b]) for a, b in batches(texts, CHARS)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            arrays, names = [batch.column(i) for i in cols], list(kept)
            if out_col:
                arrays, names = [*arrays, pa.array(scores)], [*names, out_col]
            out = pa.RecordBatch.from_arrays(arrays, names=names)
            yield out if most is None else out.filter(pa.array(scores < most))

    fields = [docs.schema[i] for i in cols] + ([T.StructField(out_col, T.DoubleType())] if out_col else [])
    return docs.mapInArrow(run, T.StructType(fields))
