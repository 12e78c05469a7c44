"""Frames, tokens and phonemes of one record brought together (F16, F22, F23, F42 to F47, F53)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.operators import signal
from millrace.functions import text as T
from millrace.functions.core import let
from millrace.operators.order import quantiles

# Phonemes by kind; any other symbol is a consonant.
VOWELS, MARKS = "əɪʊɛæɑɔʌɜɐᵻiueoaɚɝ", "ˈˌː"


def aligned_variants(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds variant (the first other reading, else the text itself) and reused (no other reading exists)."""
    options = T.variants(F.col(text))
    return df.withColumn("__o", options).withColumn("reused", F.size("__o") == 0).withColumn("variant", F.coalesce(F.try_element_at("__o", F.lit(1)), F.col(text))).drop("__o")


def phoneme_frames(frames: Column, phonemes: Column) -> Column:
    """A word's frames dealt over its phonemes: vowels weigh 2, consonants 1, stress and length marks nothing; a frame each at
    least; what rounding leaves goes to the longest (the first of several)."""
    symbols = F.filter(F.split(phonemes, ""), lambda c: ~c.rlike(r"^\s*$"))

    def weight(s: Column) -> Column:
        return F.when(F.position(s, F.lit(VOWELS)) > 0, 2.0).when(F.position(s, F.lit(MARKS)) > 0, 0.0).otherwise(1.0)

    def dealt(ws: Column) -> Column:
        total = N.total(ws)
        budget = F.greatest(F.size(ws), frames)
        raw = F.transform(ws, lambda w: F.greatest(F.bround(budget * F.when(total > 0, w / total).otherwise(1.0 / F.size(ws))).cast("int"), F.lit(1)))

        def fixed(a: Column) -> Column:
            gap = frames - F.aggregate(a, F.lit(0), lambda x, y: x + y)
            longest = F.array_position(a, F.array_max(a))
            return F.transform(a, lambda v, i: F.when(i + 1 == longest, F.greatest(v + gap, F.lit(1))).otherwise(v).cast("int"))

        return let(raw, fixed)

    alone = F.array(F.greatest(F.lit(1), frames).cast("int"))
    return F.when(F.size(symbols) == 0, alone).otherwise(let(F.transform(symbols, weight), dealt))


def _dealt_frames(words: list[str], frames: np.ndarray) -> pa.ListArray:
    """phoneme_frames() of distinct words, all at once."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    symbol = ~np.isin(points, [9, 10, 11, 12, 13, 32, 0x85, 0x2028, 0x2029])
    points, word = points[symbol], word[symbol]
    weight = np.where(np.isin(points, [ord(c) for c in VOWELS]), 2.0, np.where(np.isin(points, [ord(c) for c in MARKS]), 0.0, 1.0))
    size = np.bincount(word, minlength=len(words))
    total = np.bincount(word, weight, minlength=len(words))[word]
    share = np.where(total > 0, weight / np.where(total > 0, total, 1.0), 1.0 / size[word])
    own = np.maximum(np.rint(np.maximum(size, frames)[word] * share).astype(np.int64), 1)
    gap = frames - np.bincount(word, own, minlength=len(words)).astype(np.int64)
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, word, own)
    longest = np.flatnonzero(own == most[word])
    longest = longest[np.unique(word[longest], return_index=True)[1]]  # the first of each word
    own[longest] = np.maximum(own[longest] + gap[word[longest]], 1)
    blank = np.flatnonzero(size == 0)  # words without a symbol
    own = np.insert(own, np.searchsorted(word, blank), np.maximum(frames[blank], 1))
    ends = np.concatenate([[0], np.cumsum(np.maximum(size, 1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.int32()))


def phoneme_frames_each(frames: Column, words: Column) -> Column:
    """phoneme_frames() of every word of an array, with as many numbers of frames; each distinct pair of a batch is dealt once, in numpy. Null
    words are null."""

    @F.arrow_udf("array<array<int>>")
    def run(frames: pa.Array, words: pa.Array) -> pa.Array:
        flat = words.flatten()
        coded = flat.dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        number = frames.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        low = number.min(initial=0)
        span = number.max(initial=0) - low + 1
        pairs, at = np.unique(code * span + (number - low), return_inverse=True)
        code_of, number_of = pairs // span, pairs % span + low
        known = coded.dictionary.to_pylist()
        dealt = _dealt_frames(["" if c < 0 else known[c] for c in code_of.tolist()], number_of)
        taken = dealt.take(pa.array(at, mask=code < 0))
        ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken, mask=words.is_null())

    return run(frames, words)


def _mean_of(frames: Column, start: Column, stop: Column) -> Column:
    return N.mean(F.slice(frames, start + 1, F.greatest(stop - start, F.lit(0))))


def token_vectors(frames: Column, durations: Column, rate: int) -> Column:
    """By token, the means of its `rate` sub-spans of a series; a sub-span outside takes the token's mean."""
    def token(span: Column) -> Column:
        whole = F.coalesce(_mean_of(frames, span["start"], span["stop"]), F.lit(0.0))
        return let(whole, lambda w: F.transform(N.subtoken_spans(span, rate), lambda p: F.coalesce(_mean_of(frames, p["start"], F.least(p["stop"], F.size(frames))), w)))

    return F.transform(N.token_spans(durations, F.size(frames)), token)


def span_average(frames: Column, durations: Column) -> Column:
    """By token, the mean of its frames (a frame at least each); frames past the last token count to the last
    one alone; tokens past the last frame are 0."""
    n = F.size(durations)
    ends = F.aggregate(durations, F.array(F.lit(0)), lambda a, d: F.array_append(a, F.element_at(a, -1) + F.greatest(d, F.lit(1))))

    def means(e: Column) -> Column:
        tail = F.size(frames) > F.element_at(e, -1)

        def one(i: Column) -> Column:
            own = _mean_of(frames, F.element_at(e, i), F.least(F.element_at(e, i + 1), F.size(frames)))
            return F.when((i == n) & tail, _mean_of(frames, F.element_at(e, -1), F.size(frames))).otherwise(F.coalesce(own, F.lit(0.0)))

        return F.transform(F.sequence(F.lit(1), n), one)

    return let(ends, means)


def at_rate(frames: Column, durations: Column, rate: int) -> Column:
    """The series with each frame replaced by the mean of its token's sub-span (`rate` a token); frames past the last
    token stay."""
    cuts = F.filter(N.token_spans(durations, F.size(frames)), lambda s: s["stop"] > s["start"])
    pieces = F.flatten(F.transform(cuts, lambda s: N.subtoken_spans(s, rate)))

    def filled(ps: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            own = F.filter(ps, lambda p: (p["start"] <= i) & (i < p["stop"]))
            return F.when(F.size(own) == 0, x.cast("double")).otherwise(let(F.element_at(own, -1), lambda p: _mean_of(frames, p["start"], p["stop"])))

        return F.transform(frames, one)

    return let(pieces, filled)


def crop_to_tokens(durations: Column, frames: Column, start: Column, size: Column) -> Column:
    """struct(start, frames, first, last) of a window of frames and the tokens that it touches; null under 2 tokens, under 8
    frames in the window or 16 in all."""
    total = F.size(frames)
    n = F.least(size, total)
    begin = F.greatest(F.least(start, total - n), F.lit(0))
    ends = F.aggregate(durations, F.array().cast("array<int>"), lambda a, d: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + d))

    def found(e: Column) -> Column:
        first = F.least(F.size(F.filter(e, lambda x: x < begin)), F.size(e) - 1)
        last = F.least(F.greatest(F.size(F.filter(e, lambda x: x < begin + n - 1)) + 1, first + 1), F.size(e))
        ok = (F.size(e) >= 2) & (n >= 8) & (total >= 16) & (last - first >= 2)
        return F.when(ok, F.struct(begin.alias("start"), n.alias("frames"), first.alias("first"), last.alias("last")))

    return let(ends, found)


def speechlikeness(df: DataFrame) -> DataFrame:
    """df: f0 (array; see signal.with_f0) and flatness. Voiced share, upper median pitch, flatness, and whether all lie where speech does."""
    voiced = F.filter("f0", lambda x: x > 0)
    by = df.where(F.size("f0") > 0).select((F.size(voiced) / F.size("f0")).alias("v"), F.coalesce(N.upper_median(voiced), F.lit(0.0)).alias("p"), "flatness")
    n = by.count()
    (median,) = quantiles(by, F.col("p"), [n // 2 / max(1, n - 1)])
    out = by.agg(F.avg("v").alias("voiced"), F.any_value(F.lit(median).cast("double")).alias("median_f0"), F.avg("flatness").alias("flatness"))
    return out.withColumn("speech_like", F.col("voiced").between(0.25, 0.9) & F.col("median_f0").between(70, 350) & F.coalesce(F.col("flatness") < 0.65, F.lit(True)))


def speech_of_signals(df: DataFrame, wav: str = "wav", sr: int = 24000, hop: int = 256, frame: int = 1024, low: float = 60.0, high: float = 500.0, threshold: float | None = None, least: int = 4096, least_flat: int = 2048) -> DataFrame:
    """speechlikeness() from the signals: pitch and flatness are measured here. Signals of under `least` samples are left out, flatness takes
    `least_flat`; without a signal that is long enough, all is null."""
    long = df.where(F.size(wav) >= least).select(wav)
    measured = signal.with_flatness(signal.with_f0(long, wav, sr, hop, frame, low, high, threshold), wav, frame, frame // 4, least_flat)
    return speechlikeness(measured.select("f0", "flatness"))


def cache_provenance(df: DataFrame) -> DataFrame:
    """One row: a hash of the sorted item hashes' sum per shard, items, teachers and voices of a cache (id, teacher, voice)."""
    shards = df.groupBy((F.crc32(F.col("id").cast("string").cast("binary")) % 64).alias("s")).agg(F.sum(F.crc32(F.concat_ws("|", "id", "teacher", "voice").cast("binary"))).alias("h"), F.count("*").alias("n"))
    print_ = shards.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("s", "h", "n")))), 256).alias("fingerprint"), F.sum("n").alias("items"))  # 64 rows
    return print_.crossJoin(df.agg(F.array_sort(F.collect_set("teacher")).alias("teachers"), F.array_sort(F.collect_set("voice")).alias("voices")))  # one row each


def weight_fingerprint(df: DataFrame, group: str, name: str = "name", part: str = "part", values: str = "values") -> DataFrame:
    """(group, fingerprint): a hash of a model's weights, whatever order its rows are in. df: group, name, part, values (an array of numbers).

    A tree: each part of a tensor is hashed where it lies, as 32-bit floats, then a tensor's parts in order, then the tensors by
    name. Only digests move; a tensor of any size is as many rows as its parts.
    """
    text = F.array_join(F.transform(values, lambda v: v.cast("float").cast("string")), ",")
    leaves = df.select(group, name, part, F.sha2(text, 256).alias("h"))
    joined = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["h"]), ""), 256)
    tensors = leaves.groupBy(group, name).agg(joined(F.struct(part, "h")).alias("h"))
    named = tensors.select(group, name, F.sha2(F.concat_ws(":", name, "h"), 256).alias("h"))
    return named.groupBy(group).agg(joined(F.struct(name, "h")).alias("fingerprint"))
