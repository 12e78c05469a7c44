"""Signal features that need an FFT or a search by lag: numpy in Arrow batches.

Samples are read from Arrow's buffers, and frames of many rows are transformed at once, FRAMES of them at most, so
that long signals don't enlarge a task. A null signal has null features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FRAMES = 4096  #: transformed at once


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _padded(x: np.ndarray, size: int, mode: str) -> np.ndarray:
    """Half a frame on both sides; for a reflection a signal shorter than a frame is filled up first."""
    if mode == "reflect":
        x = np.pad(x, (0, max(0, size - len(x))))
    return np.pad(x, size // 2, mode=mode)


def _framed(waves: list[np.ndarray], size: int, hop: int, mode: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(wave of each frame, frames): all waves' frames in order, FRAMES at most at once."""
    held, owner, n = [], [], 0
    for i, x in enumerate(waves):
        x = _padded(x, size, mode)
        if len(x) < size:
            continue
        view = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
        for k in range(0, len(view), FRAMES):
            part = view[k : k + FRAMES]
            if n + len(part) > FRAMES:
                yield np.repeat([o for o, _ in owner], [c for _, c in owner]), np.concatenate(held)
                held, owner, n = [], [], 0
            held.append(part)
            owner.append((i, len(part)))
            n += len(part)
    if held:
        yield np.repeat([o for o, _ in owner], [c for _, c in owner]), np.concatenate(held)


def spectral_frames(frames: np.ndarray, sr: int) -> np.ndarray:
    """(95 % rolloff, 99 % bandwidth) in Hz of each frame."""
    power = np.abs(np.fft.rfft(frames * _hann(frames.shape[1]), axis=1)) ** 2
    share = np.cumsum(power, axis=1) / np.maximum(power.sum(axis=1, keepdims=True), 1e-12)
    hz = np.linspace(0, sr / 2, power.shape[1])
    return np.stack([hz[(share >= q).argmax(axis=1)] for q in (0.95, 0.99)], axis=1)


def mel_filters(sr: int, n_fft: int, bands: int = 80, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles on the HTK mel scale, each divided by its width in Hz (times two)."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high or sr / 2), bands + 2) / 2595) - 1)
    hz = np.linspace(0, sr / 2, n_fft // 2 + 1)
    up = (hz[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - hz[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_frames(frames: np.ndarray, filters: np.ndarray, floor: float = 1e-5) -> np.ndarray:
    return np.log(np.maximum(np.abs(np.fft.rfft(frames * _hann(frames.shape[1]), axis=1)) @ filters.T, floor))


def _correlated(x: np.ndarray) -> np.ndarray:
    """Each row's product sums with itself at lags from 0."""
    n = 1 << (2 * x.shape[1] - 1).bit_length()
    spectrum = np.fft.rfft(x, n, axis=1)
    return np.fft.irfft(np.abs(spectrum) ** 2, n, axis=1)[:, : x.shape[1]]


def yin_frames(frames: np.ndarray, sr: int, low: float, high: float, threshold: float) -> np.ndarray:
    """Pitch of each frame by YIN, 0 where unvoiced: the first local minimum of the normalised difference (edges of the
    range count) under the threshold, refined by a parabola through the difference. A silent frame is unvoiced."""
    x = frames - frames.mean(axis=1, keepdims=True)
    width = x.shape[1]
    first, last = max(2, int(sr / high)), min(width - 2, int(sr / low))
    if last <= first:
        return np.zeros(len(x))
    lags, rows = np.arange(width), np.arange(len(x))
    energy = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1)
    diff = np.maximum(energy[:, width - lags] + energy[:, -1:] - energy[:, lags] - 2 * _correlated(x), 0)
    diff[:, 0] = 0
    norm = np.ones_like(diff)
    norm[:, 1:] = diff[:, 1:] / np.maximum(np.cumsum(diff, axis=1)[:, 1:] / lags[1:], 1e-9)
    part = np.pad(norm[:, first : last + 1], ((0, 0), (1, 1)), mode="edge")
    dip = (part[:, 1:-1] <= part[:, :-2]) & (part[:, 1:-1] <= part[:, 2:]) & (part[:, 1:-1] < threshold)
    at = np.clip(first + dip.argmax(axis=1), first + 1, last - 1)
    a, b, c = diff[rows, at - 1], diff[rows, at], diff[rows, at + 1]
    shift = np.clip(0.5 * (a - c) / np.maximum(np.abs(a - 2 * b + c), 1e-12), -1, 1)
    pitch = sr / np.maximum(at + shift, 1)
    return np.where(dip.any(axis=1) & (energy[:, -1] > 1e-8) & (pitch >= low) & (pitch <= high), pitch, 0.0)


def autocorrelation_frames(frames: np.ndarray, sr: int, low: float, high: float, threshold: float) -> np.ndarray:
    """Pitch of each frame by its largest normalised autocorrelation, 0 where that is not over the threshold. It leans to
    subharmonics of voices with strong formants."""
    x = (frames - frames.mean(axis=1, keepdims=True)) * _hann(frames.shape[1])
    rho = _correlated(x)
    rho = rho / np.maximum(rho[:, :1], 1e-8)
    first, stop = max(2, int(sr / high)), min(x.shape[1] - 2, int(sr / low))
    if stop <= first:
        return np.zeros(len(x))
    rows, at = np.arange(len(x)), first + rho[:, first:stop].argmax(axis=1)
    a, b, c = rho[rows, at - 1], rho[rows, at], rho[rows, at + 1]
    shift = np.clip(0.5 * (a - c) / np.maximum(np.abs(a - 2 * b + c), 1e-8), -0.5, 0.5)
    pitch = sr / np.maximum(at + shift, 1)
    return np.where((b > threshold) & (pitch >= low) & (pitch <= high), pitch, 0.0)


# Each method's threshold.
METHODS = {"yin": (yin_frames, 0.5), "autocorr": (autocorrelation_frames, 0.3)}


def _mapped(df: DataFrame, wav: str, fields: list[T.StructField], feature: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """df with further columns: feature() of a batch's signals that are not null, an array for each field."""
    at = df.columns.index(wav)
    names = [*df.columns, *(f.name for f in fields)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(at)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            there = np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False))
            stop = np.cumsum(size)
            found = feature([values[stop[i] - size[i] : stop[i]] for i in there])
            place = np.full(len(lists), -1, np.int64)
            place[there] = np.arange(len(there))
            take = pa.array(place, mask=place < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(x.take(take) for x in found)], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema, *fields]))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def with_spectral(df: DataFrame, wav: str = "wav", sr: int = 24000, n_fft: int = 1024) -> DataFrame:
    """Adds rolloff95_hz and bandwidth99_hz."""

    def feature(waves: list[np.ndarray]) -> list[pa.Array]:
        total, n = np.zeros((len(waves), 2)), np.zeros(len(waves))
        for owner, frames in _framed(waves, n_fft, n_fft // 4, "reflect"):
            np.add.at(total, owner, spectral_frames(frames, sr))
            np.add.at(n, owner, 1)
        return [pa.array(total[:, k] / n) for k in (0, 1)]

    return _mapped(df, wav, [T.StructField(c, T.DoubleType()) for c in ("rolloff95_hz", "bandwidth99_hz")], feature)


def with_log_mel(df: DataFrame, wav: str = "wav", sr: int = 24000, n_fft: int = 1024, hop: int = 256, bands: int = 80) -> DataFrame:
    """Adds log_mel: an array of bands for each frame."""
    filters = mel_filters(sr, n_fft, bands)

    def feature(waves: list[np.ndarray]) -> list[pa.Array]:
        found = [(owner, mel_frames(frames, filters)) for owner, frames in _framed(waves, n_fft, hop, "reflect")]
        flat = np.concatenate([m for _, m in found]) if found else np.zeros((0, bands))
        counts = np.bincount(np.concatenate([o for o, _ in found]), minlength=len(waves)) if found else np.zeros(len(waves), np.int64)
        return [_lists(_lists(pa.array(flat.ravel()), np.full(len(flat), bands)), counts)]

    return _mapped(df, wav, [T.StructField("log_mel", T.ArrayType(T.ArrayType(T.DoubleType())))], feature)


def with_f0(df: DataFrame, wav: str = "wav", sr: int = 24000, hop: int = 256, frame: int = 1024, low: float = 60.0, high: float = 500.0, threshold: float | None = None, method: str = "yin", out: str = "f0") -> DataFrame:
    """Adds out: pitch in Hz around every hop-th sample, 0 where unvoiced; method: yin or autocorr."""
    pitch, usual = METHODS[method]

    def feature(waves: list[np.ndarray]) -> list[pa.Array]:
        found = [(owner, pitch(frames, sr, low, high, usual if threshold is None else threshold)) for owner, frames in _framed(waves, frame, hop, "constant")]
        flat = np.concatenate([p for _, p in found]) if found else np.zeros(0)
        counts = np.bincount(np.concatenate([o for o, _ in found]), minlength=len(waves)) if found else np.zeros(len(waves), np.int64)
        return [_lists(pa.array(flat), counts)]

    return _mapped(df, wav, [T.StructField(out, T.ArrayType(T.DoubleType()))], feature)


def with_stft_loss(df: DataFrame, ref: str, est: str, sizes: tuple[tuple[int, int], ...] = ((512, 128), (1024, 256), (2048, 512)), eps: float = 1e-7) -> DataFrame:
    """Adds stft_convergence, stft_log_mag and stft_loss (their sum): two signals' magnitude spectra compared at several resolutions.

    sizes: (frame, hop). At each, the norm of the difference over the norm of est's spectrum, and the mean absolute difference of logarithms; averaged over the
    resolutions. Signals are compared over the shorter one's length; frames of both are transformed together, FRAMES at most, and only sums of a pair are
    held. Null where a signal is null or both are empty.
    """
    at = [df.columns.index(c) for c in (ref, est)]
    fields = [T.StructField(c, T.DoubleType()) for c in ("stft_convergence", "stft_log_mag", "stft_loss")]
    names = [*df.columns, *(f.name for f in fields)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            pairs = []
            for a, b in zip(batch.column(at[0]), batch.column(at[1])):
                n = min(len(a), len(b)) if a.is_valid and b.is_valid else 0
                pairs.append(tuple(np.asarray(x.values.slice(0, n).to_numpy(zero_copy_only=False), np.float64) for x in (a, b)) if n else None)
            there = [i for i, p in enumerate(pairs) if p]
            sums = np.zeros((len(sizes), 4, len(pairs)))  # squares of the difference, of est, differences of logarithms, bins
            for k, (size, hop) in enumerate(sizes):
                waves = [[pairs[i][side] for i in there] for side in (0, 1)]
                for (owner, x), (_, y) in zip(_framed(waves[0], size, hop, "reflect"), _framed(waves[1], size, hop, "reflect")):
                    mx, my = (np.abs(np.fft.rfft(f * _hann(size), axis=1)) for f in (x, y))
                    found = ((my - mx) ** 2).sum(axis=1), (my**2).sum(axis=1), np.abs(np.log(mx + eps) - np.log(my + eps)).sum(axis=1), np.full(len(x), mx.shape[1])
                    for j, values in enumerate(found):
                        np.add.at(sums[k, j], np.array(there)[owner], values)
            with np.errstate(invalid="ignore", divide="ignore"):
                convergence = (np.sqrt(sums[:, 0]) / (np.sqrt(sums[:, 1]) + eps)).mean(axis=0)
                log_mag = (sums[:, 2] / sums[:, 3]).mean(axis=0)
            none = np.array([p is None for p in pairs], bool)
            cols = [pa.array(x, mask=none) for x in (convergence, log_mag, convergence + log_mag)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema, *fields]))


def with_flatness(df: DataFrame, wav: str = "wav", n_fft: int = 1024, hop: int = 256, least: int = 2048) -> DataFrame:
    """Adds flatness: over frames, the geometric mean of the magnitudes over their mean, averaged; null for signals of under `least` samples."""

    def feature(waves: list[np.ndarray]) -> list[pa.Array]:
        total, n = np.zeros(len(waves)), np.zeros(len(waves))
        for owner, frames in _framed(waves, n_fft, hop, "reflect"):
            spectrum = np.maximum(np.abs(np.fft.rfft(frames * _hann(n_fft), axis=1)), 1e-8)
            np.add.at(total, owner, np.exp(np.log(spectrum).mean(axis=1)) / spectrum.mean(axis=1))
            np.add.at(n, owner, 1)
        short = np.array([len(w) < least for w in waves], bool)
        return [pa.array(total / np.maximum(n, 1), mask=short)]

    return _mapped(df, wav, [T.StructField("flatness", T.DoubleType())], feature)
