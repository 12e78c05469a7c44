"""Functions of arrays and numbers: Column in, Column out, in built-in expressions, but for fallback_durations (an Arrow function). Null in, null out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.core import let


def _d(x: float) -> Column:
    return F.lit(float(x))


def total(xs: Column) -> Column:
    return F.aggregate(xs, _d(0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def dbfs(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, _d(1e-8)))


def levels(wav: Column) -> Column:
    """struct(peak_db, rms_db, clipping_ratio, crest_db); an empty signal clips and has no level."""
    peak = F.coalesce(F.array_max(F.transform(wav, F.abs)).cast("double"), _d(0))
    rms = F.sqrt(F.coalesce(mean(F.transform(wav, lambda x: x.cast("double") * x)), _d(0)))
    clip = F.size(F.filter(wav, lambda x: F.abs(x) >= 0.99)) / F.size(wav)
    return F.struct(dbfs(peak).alias("peak_db"), dbfs(rms).alias("rms_db"), F.when(F.size(wav) == 0, 1.0).otherwise(clip).alias("clipping_ratio"), (dbfs(peak) - dbfs(rms)).alias("crest_db"))


def frame_energies(wav: Column, frame: int) -> Column:
    """Mean square of each whole frame."""
    n = F.floor(F.size(wav) / frame).cast("int")
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.greatest(mean(F.transform(F.slice(wav, i * frame + 1, frame), lambda x: x.cast("double") * x)), _d(1e-12)))
    )


def silence_ratio(wav: Column, floor_db: float = 40.0, frame: int = 1024) -> Column:
    """Share of frames whose energy is more than floor_db under the loudest; 1 without a peak."""
    peak = F.coalesce(F.array_max(F.transform(wav, F.abs)).cast("double"), _d(0))

    def share(e: Column) -> Column:
        low = let(F.array_max(e) * 10 ** (-floor_db / 10), lambda bar: F.size(F.filter(e, lambda x: x < bar)) / F.size(e))
        return F.when((F.size(e) == 0) | (peak <= 1e-6), 1.0).otherwise(low)

    return let(frame_energies(wav, frame), share)


def quantile(sorted_xs: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(sorted_xs) - 1) * q
    low = F.floor(at).cast("int")
    a, b = F.element_at(sorted_xs, low + 1), F.element_at(sorted_xs, F.least(low + 2, F.size(sorted_xs)))
    return F.when(F.size(sorted_xs) > 0, a + (b - a) * (at - low))


def nearest_rank(xs: Column, pct: float) -> Column:
    """sorted[min(n - 1, floor(pct / 100 n))]."""
    s = F.array_sort(xs)
    return F.when(F.size(s) > 0, F.element_at(s, F.least(F.size(s) - 1, F.floor(F.size(s) * (pct / 100)).cast("int")) + 1))


def upper_median(xs: Column) -> Column:
    s = F.array_sort(xs)
    return F.when(F.size(s) > 0, F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1))


def estimate_snr_db(wav: Column, sr: int, frame_ms: float = 20.0, min_range_db: float = 6.0) -> Column:
    """Loud (90 %) over quiet (10 %) frame energy in dB; null under four frames or without range."""

    def ratio(e: Column) -> Column:
        return F.when(F.size(e) >= 4, 10 * F.log10(quantile(e, 0.9) / quantile(e, 0.1)))

    db = let(F.array_sort(frame_energies(wav, max(64, int(sr * frame_ms / 1000)))), ratio)
    return F.when(db >= min_range_db, db)


def normalize_peak(wav: Column, factor: float = 0.6) -> Column:
    return let(F.array_max(F.transform(wav, F.abs)), lambda peak: F.when(peak < 1e-8, wav).otherwise(F.transform(wav, lambda x: x / peak * factor)))


def resample(wav: Column, sr: Column | int, target: int) -> Column:
    """Linear resampling; the ends of both signals meet."""
    sr = F.lit(sr) if isinstance(sr, int) else sr
    n = F.greatest(F.floor(F.size(wav) * target / sr).cast("int"), F.lit(1))
    step = F.when(n > 1, (F.size(wav) - 1) / (n - 1)).otherwise(0.0)

    def at(i: Column) -> Column:
        pos = i * step
        low = F.least(F.floor(pos).cast("int"), F.size(wav) - 1)
        a, b = F.element_at(wav, low + 1), F.element_at(wav, F.least(low + 2, F.size(wav)))
        return a + (b - a) * (pos - low)

    return F.when((sr == target) | (F.size(wav) == 0), wav.cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def frame_energy_db(wav: Column, frame: int, hop: int) -> Column:
    """RMS in dB of frames centred on every hop-th sample; outside the signal is silence."""
    half = frame // 2
    centres = F.sequence(F.lit(0), F.floor(F.size(wav) / hop).cast("int"))

    def level(i: Column) -> Column:
        start, stop = F.greatest(i * hop - half, F.lit(0)), F.least(i * hop + (frame - half), F.size(wav))
        return dbfs(F.sqrt(total(F.transform(F.slice(wav, start + 1, F.greatest(stop - start, F.lit(0))), lambda x: x.cast("double") * x)) / frame))

    return F.transform(centres, level)


def fold(xs: Column, k: int) -> Column:
    """k neighbours per row; the remainder is dropped."""
    n = F.floor(F.size(xs) / k).cast("int")
    return F.slice(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(xs, i * k + 1, k)), 1, n)


def unfold(rows: Column, size: Column | int) -> Column:
    """The rows end to end, cut or filled with zeros to a size."""
    size = F.lit(size) if isinstance(size, int) else size
    flat = F.flatten(rows)
    return F.concat(F.slice(flat, 1, size), F.array_repeat(_d(0), F.greatest(size - F.size(flat), F.lit(0))).cast("array<double>"))


# Pitch range in Hz, pitch bins, energy range in dB, and the log-duration's mean and deviation.
F0_MIN, F0_MAX, F0_BINS = 60.0, 500.0, 256
ENERGY_MIN, ENERGY_MAX = -60.0, 0.0
LOG_DURATION_MEAN, LOG_DURATION_SD = 1.728, 0.390


def f0_to_normalized(f0: Column) -> Column:
    """Log pitch on 0 to 1; unvoiced (0) stays 0."""
    x = F.log2(F.greatest(f0, _d(F0_MIN)) / F0_MIN) / math.log2(F0_MAX / F0_MIN)
    return F.when(f0 <= 0, 0.0).otherwise(F.least(F.greatest(x, _d(0)), _d(1)))


def normalized_to_f0(x: Column) -> Column:
    """0 is unvoiced."""
    return F.when(x <= 0, 0.0).otherwise(F0_MIN * F.pow(_d(2), F.least(x, _d(1)) * math.log2(F0_MAX / F0_MIN)))


def f0_to_bins(f0: Column) -> Column:
    """0 is unvoiced; voiced pitch has bins 1 to 256 on the log scale."""
    return F.when(f0 <= 0, 0).otherwise(1 + F.bround(f0_to_normalized(f0) * (F0_BINS - 1))).cast("int")


def bins_to_f0(b: Column) -> Column:
    return F.when(b <= 0, 0.0).otherwise(F0_MIN * F.pow(_d(2), (b - 1) / (F0_BINS - 1) * math.log2(F0_MAX / F0_MIN)))


def energy_to_normalized(db: Column) -> Column:
    return F.least(F.greatest((db - ENERGY_MIN) / (ENERGY_MAX - ENERGY_MIN), _d(0)), _d(1))


def normalized_to_energy(x: Column) -> Column:
    return x * (ENERGY_MAX - ENERGY_MIN) + ENERGY_MIN


def duration_to_normalized(frames: Column) -> Column:
    return (F.log(F.greatest(frames, F.lit(1))) - LOG_DURATION_MEAN) / LOG_DURATION_SD


def normalized_to_duration(x: Column) -> Column:
    return F.greatest(F.bround(F.exp(x * LOG_DURATION_SD + LOG_DURATION_MEAN)), _d(1)).cast("int")


def normalize(x: Column, mu: Column, var: Column, eps: float = 1e-5) -> Column:
    return (x - mu) / F.sqrt(var + eps)


def denormalize(x: Column, mu: Column, var: Column, eps: float = 1e-5) -> Column:
    return x * F.sqrt(var + eps) + mu


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), _d(1e-12))


def cosine_hinge(a: Column, b: Column, margin: float = 0.2) -> Column:
    return F.greatest(cosine(a, b) - margin, _d(0))


def mean_series(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x.cast("double") + y) / 2)


def spectral_convergence(ref: Column, est: Column) -> Column:
    n = F.least(F.size(ref), F.size(est))
    gap = total(F.zip_with(F.slice(ref, 1, n), F.slice(est, 1, n), lambda x, y: F.pow(x - y, 2).cast("double")))
    return F.sqrt(gap) / F.greatest(F.sqrt(dot(ref, ref)), _d(1e-12))


def log_mag_l1(a: Column, b: Column, floor: float = 1e-5) -> Column:
    n = F.least(F.size(a), F.size(b))
    return mean(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(F.log(F.greatest(x.cast("double"), _d(floor))) - F.log(F.greatest(y.cast("double"), _d(floor))))))


def segmental_snr(ref: Column, est: Column, frame: int = 2048) -> Column:
    """Mean over whole frames of signal over error in dB; NaN without a frame."""
    n = F.floor(F.least(F.size(ref), F.size(est)) / frame).cast("int")

    def one(i: Column) -> Column:
        a, b = F.slice(ref, i * frame + 1, frame), F.slice(est, i * frame + 1, frame)
        noise = total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, 2)))
        return 10 * F.log10(F.greatest(dot(a, a), _d(1e-10)) / F.greatest(noise, _d(1e-10)))

    return F.when(n < 1, _d(float("nan"))).otherwise(mean(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)))


def mcd(a: Column, b: Column, n_ceps: int = 13) -> Column:
    """Mel-cepstral distortion of two arrays of log-mel frames, without the first coefficient."""
    frames = F.least(F.size(a), F.size(b))

    def ceps(frame: Column, k: Column) -> Column:
        n = F.size(frame)
        return total(F.transform(frame, lambda x, j: x.cast("double") * F.cos(math.pi / n * (j + 0.5) * k))) * F.sqrt(2.0 / n)

    def one(i: Column) -> Column:
        x, y = F.element_at(a, i), F.element_at(b, i)
        return (10 / math.log(10)) * F.sqrt(2 * total(F.transform(F.sequence(F.lit(1), F.lit(n_ceps - 1)), lambda k: F.pow(ceps(x, k) - ceps(y, k), 2))))

    return F.when(frames > 0, mean(F.transform(F.sequence(F.lit(1), F.greatest(frames, F.lit(1))), one)))


def rtf(elapsed: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, elapsed / seconds)


def sample_weight(share: Column, quality: Column, floor: float = 0.05) -> Column:
    """Share times quality (1 where unknown), at least the floor."""
    return F.greatest(F.coalesce(share, _d(1)) * F.coalesce(quality.cast("double"), _d(1)), _d(floor))


def token_spans(durations: Column, n_frames: Column) -> Column:
    """array<struct(start, stop)> of frames: running sums, a frame at least, cut at n_frames."""
    ends = F.aggregate(durations, F.array().cast("array<int>"), lambda a, d: F.concat(a, F.array((F.coalesce(F.element_at(a, F.when(F.size(a) > 0, -1)), F.lit(0)) + d).cast("int"))))
    starts = F.zip_with(ends, durations, lambda e, d: e - d)
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.least(s, n_frames - 1).cast("int").alias("start"), F.least(F.greatest(e, s + 1), n_frames).cast("int").alias("stop")))


def subtoken_spans(span: Column, rate: int) -> Column:
    """A span in `rate` nearly equal pieces of a frame at least."""
    width = (span["stop"] - span["start"]) / rate

    def piece(i: Column) -> Column:
        a = span["start"] + F.bround(i * width)
        b = span["start"] + F.bround((i + 1) * width)
        a = F.least(a, span["stop"] - 1)
        return F.struct(a.cast("int").alias("start"), F.greatest(b, a + 1).cast("int").alias("stop"))

    return F.transform(F.sequence(F.lit(0), F.lit(rate - 1)), piece)


def span_means(values: Column, spans: Column, ignore_zeros: bool = False) -> Column:
    """Mean of the values in each span; 0 for an empty one."""

    def one(s: Column) -> Column:
        own = F.slice(values, s["start"] + 1, F.greatest(s["stop"] - s["start"], F.lit(0)))
        own = F.filter(own, lambda x: x != 0) if ignore_zeros else own
        return F.coalesce(mean(own), _d(0))

    return F.transform(spans, one)


def fill_nearest(xs: Column) -> Column:
    """Zeros become the nearest other value; the earlier one on a tie; all zeros stay."""

    def filled(at: Column) -> Column:
        def near(x: Column, i: Column) -> Column:
            best = F.array_min(F.transform(at, lambda j: F.struct(F.abs(j - i).alias("gap"), j.alias("j"))))
            return F.when((x != 0) | (F.size(at) == 0), x).otherwise(F.element_at(xs, best["j"] + 1))

        return F.transform(xs, near)

    return let(F.filter(F.transform(xs, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull()), filled)


def expand_to_frames(tokens: Column, durations: Column) -> Column:
    """Each token's value as often as its duration."""
    return F.flatten(F.zip_with(tokens, durations, lambda t, d: F.array_repeat(t, d)))


def fallback_durations(energy: Column, n_tokens: Column) -> Column:
    """Frames per token without an alignment: edges half-way between equal shares of energy and equal frames, at least a
    frame each while frames suffice, all frames used."""

    def durations(energy: np.ndarray, tokens: int) -> np.ndarray:
        n, share = len(energy), np.arange(1, tokens) / tokens
        upto = np.cumsum(energy)
        by_energy = np.searchsorted(np.sort(upto), share * upto.max(initial=1e-8))
        edges, last = [], 0
        for i, e in enumerate([*np.rint((by_energy + share * n) / 2).astype(int).tolist(), n]):
            last = min(max(e, last + 1), max(n - (tokens - i - 1), last))
            edges.append(last)
        return np.diff(edges, prepend=0)

    @F.arrow_udf("array<int>")
    def run(energy: pa.Array, tokens: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(energy.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
        flat, found = energy.flatten().to_numpy(zero_copy_only=False), []
        for i, n in enumerate(tokens.to_pylist()):
            found.append(durations(flat[ends[i] : ends[i + 1]], n) if n is not None and energy[i].is_valid else None)
        return pa.array(found, pa.list_(pa.int32()))

    return run(energy, n_tokens.cast("int"))
