"""Aggregations and reports (A). Each is one or a few grouped passes with map-side combining."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.core import let
from millrace.operators.order import ROWS, hash_key, indexed, quantiles, ranks_by

NAN = float("nan")


def curation_report(df: DataFrame) -> DataFrame:
    """One row: n_total, n_kept, n_rejected, hours_kept, of a table with keep and duration_s."""
    kept = F.count_if("keep")
    hours = F.coalesce(F.sum(F.when(F.col("keep"), F.col("duration_s"))), F.lit(0.0)) / 3600
    return df.agg(F.count("*").alias("n_total"), kept.alias("n_kept"), (F.count("*") - kept).alias("n_rejected"), hours.alias("hours_kept"))


def reason_counts(df: DataFrame) -> DataFrame:
    """(reason, n): reasons by their text before the bracket."""
    return df.select(F.explode("reasons").alias("r")).select(F.substring_index("r", "(", 1).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def teacher_minutes(df: DataFrame) -> DataFrame:
    return df.groupBy("teacher").agg(F.count("*").alias("n"), (F.sum("duration_s") / 60).alias("minutes"))


def effective_mix(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(teacher, weight): the weights given (name, weight), else each teacher's number of rows; shares add up to 1."""
    counts = df.groupBy("teacher").agg(F.count("*").cast("double").alias("weight"))
    if weights is not None:
        counts = weights.select(F.col("name").alias("teacher"), "weight")
    total = counts.agg(F.sum("weight").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select("teacher", "weight", (F.col("weight") / F.col("__t")).alias("share"))  # one row


def group_stats(df: DataFrame, keys: list[str], value: str = "value", floor: float = 1e-6, support: str | None = None, least: int = 0) -> DataFrame:
    """Mean and sample deviation (at least the floor) by keys; support: a column whose distinct values must be `least`."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.greatest(F.stddev_samp(value), F.lit(floor)).alias("std"), F.count(value).alias("n"), *([F.count_distinct(support).alias("items")] if support else []))
    return out.where(F.col("items") >= least) if support and least else out


def voice_source_stats(df: DataFrame, value: str = "value", floor: float = 1e-6) -> DataFrame:
    """(voice, source, dim) statistics of voices that have more than one source, and all (voice, dim) ones with a null
    source, from one pass by grouping sets."""
    sets = df.groupingSets([["voice", "dim"], ["voice", "source", "dim"]], "voice", "source", "dim").agg(
        F.grouping("source").alias("all_sources"), F.avg(value).alias("mean"), F.greatest(F.stddev_samp(value), F.lit(floor)).alias("std"), F.count(value).alias("n")
    )
    many = df.groupBy("voice").agg(F.count_distinct("source").alias("k")).where("k > 1").select("voice", F.lit(True).alias("many"))
    return sets.join(many, "voice", "left").where((F.col("all_sources") == 1) | F.col("many")).drop("many")


def population_norm(df: DataFrame, dim: str = "dim", value: str = "value") -> DataFrame:
    return df.groupBy(dim).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.count(value).alias("n"))


def ema_norm(batches: DataFrame, key: str = "dim", order: str = "batch", momentum: float = 0.01) -> DataFrame:
    """batches: (key, order, mean, var) of each batch, order a number. The running mean and variance after all: the first
    is copied. A batch's share after all is a power that its place gives, so these are plain sums."""
    placed = indexed(batches, order, "__i", (key,))
    total = placed.groupBy(key).agg(F.count("*").alias("__n"))
    w = F.pow(F.lit(1 - momentum), F.col("__n") - 1 - F.col("__i")) * F.when(F.col("__i") == 0, 1.0).otherwise(momentum)
    return placed.join(total, key).groupBy(key).agg(F.sum(F.col("mean") * w).alias("mean"), F.sum(F.col("var") * w).alias("var"))


def scale_check(df: DataFrame, voice: str = "voice", value: str = "normed", tolerance: float = 0.15) -> DataFrame:
    """(voice, std, error, ok): pooled deviation after normalising; it should be 1."""
    out = df.groupBy(voice).agg(F.stddev_samp(value).alias("std"))
    return out.withColumn("error", F.abs(F.col("std") - 1)).withColumn("ok", F.col("error") <= tolerance)


def distinct_widths(df: DataFrame, arrays: str) -> DataFrame:
    """(width, n): there should be one row."""
    return df.groupBy(F.size(arrays).alias("width")).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def duration_summary(df: DataFrame, seconds: str = "duration_s", low: float = 3.0, high: float = 30.0) -> DataFrame:
    s = F.col(seconds)
    (median,) = quantiles(df, s, [0.5])
    return df.agg((F.sum(s) / 3600).alias("hours"), _constant(median).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"), F.count_if((s < low) | (s > high)).alias("out_of_range"))


def _constant(x: float | None) -> Column:
    return F.any_value(F.lit(x).cast("double"))


def trim_by_quantile(df: DataFrame, ratio: str, low: float = 0.01, high: float = 0.95) -> DataFrame:
    """Rows whose ratio lies within the exact quantiles, inclusive."""
    a, b = quantiles(df, F.col(ratio), [low, high])
    return df.where(F.col(ratio).between(F.lit(a).cast("double"), F.lit(b).cast("double")))


def nearest_rank(pct: float) -> Callable[[Column], Column]:
    """The place of the nearest-rank percentile among n values, from 0: min(n - 1, floor(pct / 100 n))."""
    return lambda n: F.least(n - 1, F.floor(n * (pct / 100)).cast("bigint"))


def upper_median() -> Callable[[Column], Column]:
    """The place of the upper median among n values: n div 2."""
    return lambda n: F.floor(n / 2).cast("bigint")


def order_statistics(df: DataFrame, group: tuple[str, ...], value: Column, places: dict[str, Callable[[Column], Column]], rows: int = ROWS) -> DataFrame:
    """(group, n, a column a place): exact order statistics by group, of values that aren't null. No group's values are gathered."""
    return ranks_by(df, group, value, places, rows)


def per_dim_rho(pairs: DataFrame, keys: list[str], dim: str = "dim", least: float = 1e-6) -> DataFrame:
    """Pearson of x and y by dimension, averaged over the dimensions that vary on both sides: (keys, rho, dims)."""
    by = pairs.groupBy(*keys, dim).agg(F.corr("x", "y").alias("r"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    by = by.where((F.col("sx") >= least) & (F.col("sy") >= least))
    return by.groupBy(*keys).agg(F.avg("r").alias("rho"), F.count("*").alias("dims")) if keys else by.agg(F.avg("r").alias("rho"), F.count("*").alias("dims"))


def _mix(x: np.ndarray) -> np.ndarray:
    """Shifts and factors of a 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(13787848793156543929)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(10723151780598845931)
    return x ^ (x >> np.uint64(31))


def bootstrap_ci(df: DataFrame, value: str, key: str, draws: int = 2000, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean, low, high): 95 % interval of the mean from resampled means; key tells rows apart.

    Poisson resampling: each row enters each draw as often as a Poisson(1) number that its key, the draw and the seed
    give. So draws are sums: a task adds up all draws of the rows it meets, and one array of `draws` sums a group leaves it.
    """
    p, upto = math.exp(-1), []
    for k in range(8):  # the Poisson distribution's steps
        upto.append((upto[-1] if upto else 0.0) + p)
        p /= k + 1
    salts = _mix(np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = df.where(F.col(value).isNotNull()).select(group.alias("__g"), hash_key(0, key).alias("k"), F.col(value).cast("double").alias("v"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in it:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            keys, values = batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy()
            for start in range(0, len(keys), 512):
                u = (_mix(keys[start : start + 512, None] ^ salts[None, :]) >> np.uint64(11)) * 2.0**-53
                times = np.searchsorted(upto, u.ravel(), "right").reshape(u.shape).astype(np.float64)
                part, v = names[start : start + 512], values[start : start + 512]
                for g in np.unique(part):
                    own = part == g
                    sums = np.stack([v[own] @ times[own], times[own].sum(axis=0)])
                    held[g] = held[g] + sums if g in held else sums
                if len(held) > 256:  # the memory of a task stays bounded whatever the number of groups
                    yield _sums(held)
                    held = {}
        yield _sums(held)

    parts = rows.mapInArrow(run, "__g string, a array<double>, b array<double>")
    sums = parts.select("__g", F.posexplode(F.arrays_zip("a", "b")).alias("draw", "s")).groupBy("__g", "draw").agg((F.sum("s.a") / F.sum("s.b")).alias("m")).where("m IS NOT NULL")
    ranked = sums.groupBy("__g").agg(F.array_sort(F.collect_list("m")).alias("s"))  # `draws` numbers a group
    at = lambda q: F.element_at("s", F.least(F.floor(F.size("s") * q).cast("int") + 1, F.size("s")))
    bounds = ranked.select("__g", at(0.025).alias("low"), at(0.975).alias("high"))
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean")).withColumn("__g", group)
    return mean.join(bounds, "__g", "left").select(*by, "mean", "low", "high")


def _sums(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    rows = list(held.values())
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in (0, 1))], names=["__g", "a", "b"])


def spread_summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, deviation, bounds, count, and whether the interval mean ± deviation holds zero; the values stay in df.
    Without keys an empty table gives a row of NaN that straddles zero."""
    v = F.col(value)
    agg = [F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")]
    out = df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)
    empty = F.col("n") == 0
    for c in ("mean", "std", "min", "max"):
        out = out.withColumn(c, F.when(empty, NAN).otherwise(F.col(c)))
    return out.withColumn("straddles_zero", empty | ((F.col("mean") - F.col("std") <= 0) & (F.col("mean") + F.col("std") >= 0)))


def plateau(df: DataFrame, step: str = "step", value: str = "value") -> DataFrame:
    """Over the steps' means: mean, sd; and the largest spread (max - min) within a step."""
    by = df.groupBy(step).agg(F.avg(value).alias("m"), (F.max(value) - F.min(value)).alias("s"))
    return by.agg(F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd_between"), F.max("s").alias("spread_within"), F.count("*").alias("steps"))


def run_verdict(df: DataFrame, run: str, a: str, b: str, keys: list[str], value: str = "value") -> DataFrame:
    """Runs a and b side by side: SEPARATED if their means differ by more than the larger spread."""
    by = df.where(F.col(run).isin(a, b)).groupBy(*keys).pivot(run, [a, b]).agg(F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("spread"))
    delta = F.col(f"{b}_mean") - F.col(f"{a}_mean")
    spread = F.greatest(f"{a}_spread", f"{b}_spread")
    return by.select(*keys, delta.alias("delta"), spread.alias("spread"), F.when(F.abs(delta) > spread, "SEPARATED").when(delta.isNotNull(), "inside the spread").otherwise("no data").alias("verdict"))


def arm_verdict(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, b: (key, mean, spread) of two arms. Unresolved if the means differ by less than half of the larger spread."""
    x, y = a.select(key, F.col("mean").alias("ma"), F.col("spread").alias("sa")), b.select(key, F.col("mean").alias("mb"), F.col("spread").alias("sb"))
    delta, spread = F.col("mb") - F.col("ma"), F.greatest("sa", "sb")
    verdict = F.when(F.col("ma").isNull() | F.col("mb").isNull(), "partial").when(F.abs(delta) < spread / 2, "unresolved").when(delta > 0, "better").otherwise("worse")
    return x.join(y, key, "full").select(key, delta.alias("delta"), spread.alias("spread"), verdict.alias("verdict"))


def variance_budget(df: DataFrame, utt: str = "utt", voice: str = "voice", frame: str = "frame", dim: str = "dim", value: str = "value") -> DataFrame:
    """One row: shares of the energy (sum of squares) that the global mean (of utterance means), the voice mean, the
    utterance mean and a first-order prediction explain, by dimension; residual: what the last leaves."""
    v = F.col(value)
    of_utt = df.groupBy(utt, voice, dim).agg(F.avg(v).alias("mu"))
    of_voice = of_utt.groupBy(voice, dim).agg(F.avg("mu").alias("mv"))
    of_all = of_utt.groupBy(dim).agg(F.avg("mu").alias("mg"))
    order = Window.partitionBy(utt, dim).orderBy(frame)
    rows = df.withColumn("__p", F.lag(v).over(order))
    slope = rows.groupBy(utt, dim).agg((F.sum(v * F.col("__p")) / F.sum(F.col("__p") * F.col("__p"))).alias("a"))
    rows = rows.join(of_utt, [utt, voice, dim]).join(of_voice, [voice, dim]).join(of_all, dim).join(slope, [utt, dim], "left")
    total = F.sum(v * v)
    part = lambda pred: 1 - F.sum(F.pow(v - pred, 2)) / total
    ar = F.coalesce(F.col("a") * F.col("__p"), v)  # a first frame passes through
    return rows.agg(part(F.col("mg")).alias("r2_global"), part(F.col("mv")).alias("r2_voice"), part(F.col("mu")).alias("r2_utterance"), part(ar).alias("r2_ar1"), (1 - part(ar)).alias("residual"), F.count("*").alias("n"))


def folded(df: DataFrame, k: int, frame: str = "frame", dim: str = "dim") -> DataFrame:
    """Frames folded by k: the place in the fold joins the dimension. Whole folds only are up to the caller."""
    return df.withColumn(dim, F.col(dim) * k + F.col(frame) % k).withColumn(frame, F.floor(F.col(frame) / k))


def autocorrelation(df: DataFrame, lags: list[int], utt: str = "utt", dim: str = "dim", frame: str = "frame", value: str = "value") -> DataFrame:
    """(lag, rho): correlation with the value so many frames before, averaged over series of more than lag + 8 frames."""
    order = Window.partitionBy(utt, dim).orderBy(frame)
    n = F.count("*").over(Window.partitionBy(utt, dim))
    rows = df.withColumn("n", n).select(utt, dim, "n", F.col(value).alias("x"), *[F.lag(value, k).over(order).alias(f"l{k}") for k in lags])
    pairs = rows.select(utt, dim, "n", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("y")) for k in lags])).alias("p")).select(utt, dim, "n", "x", "p.lag", "p.y")
    by = pairs.where((F.col("n") > F.col("lag") + 8) & F.col("y").isNotNull()).groupBy(utt, dim, "lag").agg(F.corr("x", "y").alias("r"))
    return by.where(F.col("r").isNotNull()).groupBy("lag").agg(F.avg("r").alias("rho"), F.count("*").alias("series"))


def regression(df: DataFrame, dim: str = "dim") -> DataFrame:
    """By dimension: alpha = sum(xp) / sum(pp) cut to [0, 2], and the energy of x before and after alpha p is taken off."""
    by = df.groupBy(dim).agg(F.sum(F.col("x") * F.col("p")).alias("xp"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("x") * F.col("x")).alias("before"))
    alpha = F.least(F.greatest(F.coalesce(F.col("xp") / F.nullif(F.col("pp"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(2.0))
    return by.withColumn("alpha", alpha).select(dim, "alpha", "before", (F.col("before") - 2 * F.col("alpha") * F.col("xp") + F.col("alpha") * F.col("alpha") * F.col("pp")).alias("after"))


def alignment_evidence(df: DataFrame) -> DataFrame:
    """df: text, token_frames, duration_s, mos; frames of 256 samples at 24 kHz. One row of coverage and errors."""
    frames = F.col("duration_s") * 24000 / 256
    held = F.col("token_frames").isNotNull() & (F.size("token_frames") > 0)
    err = F.when(held, F.abs(F.aggregate("token_frames", F.lit(0.0), lambda a, x: a + x) - frames) / frames)
    each = F.when(held, F.size("token_frames") == F.length("text"))
    rows = df.select(held.alias("held"), err.alias("err"), each.alias("each"), F.col("mos").cast("double").alias("mos"))
    e50, e90 = map(_constant, quantiles(rows, F.col("err"), [0.5, 0.9]))
    m50, m10, m90 = map(_constant, quantiles(rows, F.col("mos"), [0.5, 0.1, 0.9]))
    return rows.agg(
        F.count("*").alias("n"), F.count_if("held").alias("aligned"), e50.alias("median_error"), e90.alias("p90_error"),
        F.bool_and("each").alias("one_frame_per_char"), F.avg("mos").alias("mos_mean"), m50.alias("mos_median"), m10.alias("mos_p10"), m90.alias("mos_p90"),
    )


def alignment_report(df: DataFrame, sr: int = 24000, hop: int = 256) -> DataFrame:
    """A25 in full. df: text, teacher, token_frames, duration_s, mos. One row: records, aligned, coverage, chars_median, median and p90 of the relative
    error of the duration, mean, median, p10 and p90 of the score, teachers (a map of counts) and checks (a map).

    Medians lie half-way between two middle values, p10 and p90 are nearest ranks. Records of no duration have no error.
    """
    held = F.coalesce(F.size("token_frames") > 0, F.lit(False))
    counted = held & (F.col("duration_s") > 0)
    err = F.abs(F.aggregate("token_frames", F.lit(0.0), lambda a, x: a + x) * hop / sr - F.col("duration_s")) / F.col("duration_s")
    rows = df.select("teacher", held.alias("held"), F.when(counted, err).alias("err"), F.when(counted, F.size("token_frames").cast("double")).alias("chars"), F.when(held, F.size("token_frames") == F.length("text")).alias("each"), F.col("mos").cast("double").alias("mos"))
    medians = {c: _constant(quantiles(rows, F.col(c), [0.5])[0]) for c in ("chars", "err", "mos")}
    (p90,) = _places(rows, F.col("err"), {"p90": nearest_rank(90)})
    low, high = _places(rows, F.col("mos"), {"p10": nearest_rank(10), "p90": nearest_rank(90)})
    teachers = rows.groupBy(F.coalesce("teacher", F.lit("None")).alias("t")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("teachers"))  # a row a teacher
    out = rows.agg(
        F.count("*").alias("records"), F.count_if("held").alias("aligned"), (F.count_if("held") / F.greatest(F.count("*"), F.lit(1))).alias("coverage"), medians["chars"].alias("chars_median"), medians["err"].alias("median_error"), _constant(p90).alias("p90_error"),
        F.avg("mos").alias("mos_mean"), medians["mos"].alias("mos_median"), _constant(low).alias("mos_p10"), _constant(high).alias("mos_p90"), F.coalesce(F.bool_and("each"), F.lit(True)).alias("__each"), F.count("mos").alias("__mos"),
    )
    checks = {"carries an alignment": F.col("aligned") > 0, "one frame per character": F.col("__each"), "reproduces the duration": F.coalesce(F.col("median_error") < 0.10, F.lit(False)), "all scored": F.col("__mos") == F.col("records")}
    named = F.create_map(*[x for name, ok in checks.items() for x in (F.lit(name), ok)])
    return out.withColumn("checks", named).drop("__each", "__mos").crossJoin(teachers)  # one row each


def _places(rows: DataFrame, value: Column, places: dict[str, Callable[[Column], Column]]) -> list[float | None]:
    found = ranks_by(rows.select(F.lit(0).alias("__all"), value.alias("__value")), ("__all",), F.col("__value"), places).first()
    return [found[name] if found else None for name in places]


def alignment_comparison(df: DataFrame) -> DataFrame:
    """A26 by utterance, of at least four tokens on both sides. df: utt, aligned, fallback (durations in frames), audio_frames. (utt, tokens, r, aligned_error,
    fallback_error, apart): the correlation over the shorter one's tokens (null if one side is constant) and relative errors of the totals."""
    n = F.least(F.size("aligned"), F.size("fallback"))
    cut = df.where(n >= 4).withColumn("__n", n).select("utt", "__n", "audio_frames", F.slice("aligned", F.lit(1), n).alias("a"), F.slice("fallback", F.lit(1), n).alias("b"))
    each = cut.select("utt", "__n", "audio_frames", F.explode(F.arrays_zip("a", "b")).alias("p")).select("utt", "__n", "audio_frames", F.col("p.a").cast("double").alias("x"), F.col("p.b").cast("double").alias("y"))
    by = each.groupBy("utt").agg(F.first("__n").alias("tokens"), F.first("audio_frames").alias("f"), F.corr("x", "y").alias("r"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    error = lambda v: F.abs(F.col(v) - F.col("f")) / F.greatest(F.col("f"), F.lit(1.0))
    return by.select("utt", "tokens", F.when(~F.isnan("r"), F.col("r")).alias("r"), error("x").alias("aligned_error"), error("y").alias("fallback_error"), (F.abs(F.col("x") - F.col("y")) / F.greatest(F.col("x"), F.lit(1.0))).alias("apart"))


def alignment_summary(comparison: DataFrame) -> DataFrame:
    """A26 over alignment_comparison(): utterances, medians of r and the errors, and checks (a map)."""
    names = ["r", "aligned_error", "fallback_error"]
    medians = [_constant(quantiles(comparison, F.col(c), [0.5])[0]).alias(f"median_{c}") for c in names]
    out = comparison.agg(F.count("*").alias("utterances"), *medians, F.bool_and((F.col("aligned_error") < 0.05) & (F.col("fallback_error") < 0.05)).alias("__cover"), F.bool_and(F.col("apart") < 0.05).alias("__agree"))
    checks = F.create_map(F.lit("changes the structure"), F.coalesce(F.col("median_r") < 0.5, F.lit(False)), F.lit("cover the audio"), F.col("__cover"), F.lit("agree on the length"), F.col("__agree"))
    return out.withColumn("checks", checks).drop("__cover", "__agree")


def fit_report(tokens: DataFrame, latents: DataFrame) -> DataFrame:
    """A27 in full: (measure, train, val, gap), each the mean over a split's utterances; gap is train less val.

    tokens: split, utt, true_dur, pred_dur, true_f0, pred_f0, true_energy, pred_energy, a row a token. latents: split, utt, dim, true, pred, a row a token and
    dimension. The cosine is over all of an utterance's values, the correlation over its dimensions that vary on both sides.
    """
    mae = lambda a, b: F.avg(F.abs(F.col(a) - F.col(b)))
    ratio = F.sum("pred_dur") / F.greatest(F.sum("true_dur"), F.lit(1.0))
    own = tokens.groupBy("split", "utt").agg(mae("true_dur", "pred_dur").alias("duration_mae"), ratio.alias("duration_ratio"), mae("true_f0", "pred_f0").alias("f0_mae"), mae("true_energy", "pred_energy").alias("energy_mae"))
    by = latents.groupBy("split", "utt", "dim").agg(F.sum(F.col("true") * F.col("pred")).alias("xy"), F.sum(F.col("true") * F.col("true")).alias("xx"), F.sum(F.col("pred") * F.col("pred")).alias("yy"), F.corr("true", "pred").alias("r"), F.stddev_samp("true").alias("sx"), F.stddev_samp("pred").alias("sy"))
    varied = (F.col("sx") >= 1e-6) & (F.col("sy") >= 1e-6)
    cosine = F.sum("xy") / F.greatest(F.sqrt(F.sum("xx")) * F.sqrt(F.sum("yy")), F.lit(1e-8))
    vectors = by.groupBy("split", "utt").agg(cosine.alias("cosine"), (F.coalesce(F.sum(F.when(varied, F.col("r"))), F.lit(0.0)) / F.greatest(F.count_if(varied), F.lit(1))).alias("dim_correlation"))
    measures = ["duration_mae", "duration_ratio", "f0_mae", "energy_mae", "cosine", "dim_correlation"]
    means = own.join(vectors, ["split", "utt"]).groupBy("split").agg(*[F.avg(c).alias(c) for c in measures])
    long = means.select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in measures])).alias("m")).select("split", "m.measure", "m.v")
    return long.groupBy("measure").pivot("split", ["train", "val"]).agg(F.first("v")).withColumn("gap", F.col("train") - F.col("val"))


def voice_counts(df: DataFrame, split: str = "split", voice: str = "voice") -> DataFrame:
    """(split, voice, n): items of each voice on each side, -1 where there is none."""
    return df.groupBy(split, F.coalesce(voice, F.lit(-1)).alias("voice")).agg(F.count("*").alias("n"))


def alignment_value(df: DataFrame) -> DataFrame:
    """df: utt, aligned and fallback (arrays of durations). By utterance: their Pearson (NaN under 3) and length error."""
    pairs = df.select("utt", F.size("aligned").alias("n"), F.explode(F.arrays_zip("aligned", "fallback")).alias("p")).select("utt", "n", F.col("p.aligned").cast("double").alias("x"), F.col("p.fallback").cast("double").alias("y"))
    by = pairs.groupBy("utt").agg(F.first("n").alias("n"), F.corr("x", "y").alias("r"), (F.abs(F.sum("x") - F.sum("y")) / F.sum("x")).alias("length_error"))
    return by.select("utt", F.when(F.col("n") < 3, NAN).otherwise(F.col("r")).alias("r"), "length_error")


def fit_diagnosis(df: DataFrame) -> DataFrame:
    """df: split, true_dur, pred_dur, true_f0, pred_f0, true_energy, pred_energy by token. By split: errors and the ratio."""
    mae = lambda a, b: F.avg(F.abs(F.col(a) - F.col(b)))
    return df.groupBy("split").agg(mae("true_dur", "pred_dur").alias("duration_mae"), (F.sum("pred_dur") / F.sum("true_dur")).alias("length_ratio"), mae("true_f0", "pred_f0").alias("f0_mae"), mae("true_energy", "pred_energy").alias("energy_mae"), F.count("*").alias("tokens"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, floor: float = 1e-3) -> DataFrame:
    """Mean by keys with weights of at least the floor; their scale doesn't matter, so rescaling to mean 1 drops out."""
    w = F.greatest(F.col(weight), F.lit(floor))
    return df.groupBy(*keys).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("mean"), F.avg(w).alias("mean_weight"))


def masked_errors(df: DataFrame, sample: str) -> DataFrame:
    """df: pred, true and valid by sample. By sample: mean absolute and squared error over valid places."""
    gap = F.when(F.col("valid"), F.col("pred") - F.col("true"))
    return df.groupBy(sample).agg(F.avg(F.abs(gap)).alias("l1"), F.avg(gap * gap).alias("mse"), F.count(gap).alias("valid"))


def centred_mse(df: DataFrame, sample: str, dim: str = "dim") -> DataFrame:
    """By sample: squared error after each side's mean over the sample's tokens is taken off, by dimension.
    From sums alone: the variance of the difference."""
    by = df.groupBy(sample, dim).agg(F.var_pop(F.col("pred") - F.col("true")).alias("v"), F.count("*").alias("n"))
    return by.groupBy(sample).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mse"))


def level_summary(df: DataFrame) -> DataFrame:
    """Medians of rms_db, peak_db, crest_db and duration_s, and the checks that fail."""
    out = df.agg(*[_constant(quantiles(df, F.col(c), [0.5])[0]).alias(c) for c in ("rms_db", "peak_db", "crest_db", "duration_s")], F.count("*").alias("n"))
    checks = F.array_compact(F.array(F.when(F.col("rms_db") < -40, F.lit("quiet")), F.when(F.col("peak_db") > -0.1, F.lit("clipped")), F.when(F.col("duration_s") < 0.5, F.lit("short"))))
    return out.withColumn("failed", checks)


def agreement_report(same: DataFrame, control: DataFrame, value: str = "rho") -> DataFrame:
    """(class, mean, n, min, max) of pairs of the same text and of control pairs."""
    both = same.select(F.lit("same").alias("class"), value).unionByName(control.select(F.lit("control").alias("class"), value))
    return both.groupBy("class").agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))


def reliability_report(pairs: DataFrame, bar: float = 0.60) -> DataFrame:
    """pairs: pair, rho, shift, n_a, n_b. Mean, interval, the ceiling (root of the mean), median shift, length gap, verdict."""
    ci = bootstrap_ci(pairs, "rho", "pair")
    rest = pairs.agg(_constant(quantiles(pairs, F.col("shift"), [0.5])[0]).alias("median_shift"), F.avg(F.abs(F.col("n_a") - F.col("n_b")) / F.greatest("n_a", "n_b")).alias("length_mismatch"), F.count("*").alias("pairs"))
    return ci.crossJoin(rest).withColumn("ceiling", F.sqrt(F.greatest("mean", F.lit(0.0)))).withColumn("verdict", F.when(F.col("low") >= bar, "reliable").when(F.col("high") < bar, "unreliable").otherwise("undecided"))


def metric_report(df: DataFrame) -> DataFrame:
    """df: metric, value, available, reason by utterance. Means over measured values (NaN left out), or the reasons."""
    ok = F.col("available") & ~F.isnan("value")
    return df.groupBy("metric").agg(F.avg(F.when(ok, F.col("value"))).alias("mean"), F.count_if(ok).alias("n"), F.array_sort(F.collect_set(F.when(~F.col("available"), F.col("reason")))).alias("reasons"))


def control_gated(df: DataFrame, control: DataFrame, key: str, bound: float = 0.5) -> DataFrame:
    """A metric's value where its control's own value is under the bound; else null and a reason."""
    out = df.join(control.select(key, F.col("value").alias("control")), key, "left")
    ok = F.coalesce(F.col("control") < bound, F.lit(False))
    reason = F.when(F.col("control").isNull(), F.lit("no control")).when(~ok, F.format_string("control failed (%.3f)", "control"))
    return out.select(key, F.when(ok, F.col("value")).alias("value"), "control", reason.alias("reason"))


def corpus_wer(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Errors over words of the whole table; words compared place by place."""
    errors, words = T.positional_errors(F.col(ref), F.col(hyp))
    return df.agg((F.sum(errors) / F.sum(words)).alias("wer"), F.sum(errors).alias("errors"), F.sum(words).alias("words"))


def _json_at(json: Column, path: Column) -> Column:
    """The value at a dotted path (a column) of a JSON text; a number picks from a list."""
    step = lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("."), p))
    return F.call_function("get_json_object", json, F.concat(F.lit("$"), F.array_join(F.transform(F.split(path, r"\."), step), "")))


def select_json_row(rows: Column, selector: Column) -> Column:
    """One of an array of JSON objects: `max_<field>` takes the largest (the first of equals; a missing value counts as 0),
    `<field>=<text>` the first that matches, no selector the first; null if there is none."""
    measure, key = F.substring(selector, 5, 1_000), F.substring_index(selector, "=", 1)
    want = F.substring(selector, F.length(key) + 2, F.lit(1_000))
    size_of = lambda r: F.coalesce(_json_at(r, measure).try_cast("double"), F.lit(0.0))
    said = lambda r: _json_at(r, key)
    same = lambda r: F.coalesce((said(r) == want) | (said(r).isin("true", "false") & (said(r) == F.lower(want))), F.lit(False))
    largest = F.array_max(F.transform(rows, lambda r, i: F.struct(size_of(r).alias("v"), (-i).alias("i"))))
    by_max = F.try_element_at(rows, (1 - largest["i"]).cast("int"))
    first = F.try_element_at(F.filter(rows, same), F.lit(1))
    plain = F.try_element_at(rows, F.lit(1))
    return F.when(F.contains(selector, F.lit("=")), first).when(F.startswith(selector, F.lit("max_")), by_max).otherwise(plain)


def evaluate_claims(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Checks reported numbers. (claim, measured, outcome, report_used, missing, detail).

    claims: claim, op, bound, field (dotted), and, each of these if it is needed: report, or reports (candidates: the first that exists is
    used, those before it are missing); list_field and select (the field is looked up in one row of a list, see select_json_row);
    fields (their sum is measured; all must be there); other_field. reports: report, json.

    Ops: >=, <=, ==, all_true (every value of the field's map counts as true, and there is one), lt_field (less than other_field). A claim without
    a report, row, field or number is unmeasured, never failed; detail says why, or how many checks passed and which failed.
    """
    texts = {"other_field": "string", "list_field": "string", "select": "string", "fields": "array<string>"}
    have = claims.columns
    claims = claims.withColumns({c: F.lit(None).cast(t) for c, t in texts.items() if c not in have})
    named = F.col("reports") if "reports" in have else F.array("report")
    asked = claims.withColumn("__asked", named)
    each = asked.select("claim", F.posexplode("__asked").alias("at", "report")).join(reports.select("report", "json"), "report").where("json IS NOT NULL")
    used = each.groupBy("claim").agg(F.min_by(F.struct("report", "json", "at"), "at").alias("u"))
    joined = asked.join(used, "claim", "left").select(*[c for c in asked.columns if c != "report"], F.col("u.report").alias("report_used"), F.col("u.json").alias("__json"), F.col("u.at").alias("__at"))
    rows = F.from_json(_json_at(F.col("__json"), F.col("list_field")), "array<string>")
    joined = joined.withColumn("__row", F.when(F.col("list_field").isNull(), F.col("__json")).otherwise(select_json_row(rows, F.coalesce("select", F.lit("")))))
    parts = F.transform("fields", lambda f: _json_at(F.col("__json"), f).try_cast("double"))
    whole = F.forall(parts, lambda v: v.isNotNull())
    sum_of = F.when(whole, F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)).cast("string")
    joined = joined.withColumn("measured", F.when(F.col("fields").isNotNull(), sum_of).otherwise(_json_at(F.col("__row"), F.col("field"))))
    joined = joined.withColumn("__other", _json_at(F.col("__json"), F.col("other_field")).try_cast("double"))
    joined = joined.withColumn("__checks", F.when(F.col("op") == "all_true", F.from_json("measured", "map<string,string>")))
    x, op, bound = F.col("measured").try_cast("double"), F.col("op"), F.col("bound")
    true = lambda v: F.coalesce(~v.isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))
    failing = F.map_keys(F.map_filter("__checks", lambda _, v: ~true(v)))
    every = F.when(F.col("measured").isNotNull(), F.coalesce((F.size("__checks") > 0) & (F.size(failing) == 0), F.lit(False)))
    holds = F.when(op == ">=", x >= bound).when(op == "<=", x <= bound).when(op == "==", x == bound).when(op == "lt_field", x < F.col("__other")).when(op == "all_true", every)
    passed = F.format_string("%d of %d", F.size("__checks") - F.size(failing), F.size("__checks"))
    why = (
        F.when(F.col("report_used").isNull(), F.concat(F.lit("no report: "), F.array_join("__asked", ", ")))
        .when(F.col("fields").isNotNull() & F.col("measured").isNull(), F.concat(F.lit("missing fields: "), F.array_join("fields", ", ")))
        .when(F.col("__row").isNull(), F.concat(F.lit("no row matched: "), F.coalesce("select", F.lit(""))))
        .when(F.col("measured").isNull(), F.concat(F.lit("no field "), F.col("field")))
        .when((op == "lt_field") & F.col("__other").isNull(), F.concat(F.lit("no field "), F.col("other_field")))
        .when((op == "all_true") & (F.size(failing) > 0), F.concat(passed, F.lit("; failing: "), F.array_join(F.array_sort(failing), ", ")))
        .when(op == "all_true", passed)
    )
    outcome = F.when(holds.isNull(), "unmeasured").when(holds, "pass").otherwise("fail")
    missing = F.when(F.col("__at").isNull(), F.col("__asked")).otherwise(F.slice("__asked", 1, F.col("__at")))
    return joined.select("claim", "measured", outcome.alias("outcome"), "report_used", missing.alias("missing"), why.alias("detail"))


# Metrics for which more is better.
HIGHER = ["rho", "corr", "cosine", "correlation"]


def compare_arms(df: DataFrame, arms: list[str], control_bound: float = 0.5) -> DataFrame:
    """df: holdout, metric, arm, value, control. A row per hold-out and metric: each arm's value, whether all controls are
    under the bound, and the best arm."""
    by = df.groupBy("holdout", "metric").pivot("arm", arms).agg(F.avg("value"))
    ok = df.groupBy("holdout", "metric").agg(F.bool_and(F.coalesce(F.col("control") < control_bound, F.lit(False))).alias("controls_ok"))
    up = F.exists(F.array(*map(F.lit, HIGHER)), lambda h: F.contains("metric", h))
    named = F.array_compact(F.array(*[F.when(F.col(a).isNotNull(), F.struct(F.when(up, -F.col(a)).otherwise(F.col(a)).alias("v"), F.lit(a).alias("arm"))) for a in arms]))
    return by.join(ok, ["holdout", "metric"]).withColumn("best", F.array_min(named)["arm"])


def corpus_hours(df: DataFrame, seconds: str = "duration_s") -> DataFrame:
    return df.agg((F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600).alias("hours"))


def pitch_summary(df: DataFrame, f0: str = "f0", others: tuple[str, ...] = ()) -> DataFrame:
    """df: an array of pitch (0: unvoiced) a row. Over the rows: voiced share and median voiced pitch, the voiced shares of
    other trackers' columns (another threshold, autocorrelation), and checks."""
    voiced = F.filter(f0, lambda x: x > 0)

    def middle(s: Column) -> Column:
        return F.when(F.size(s) > 0, (F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)) / 2)

    share = lambda c: F.size(F.filter(c, lambda x: x > 0)) / F.size(c)
    by = df.select(share(f0).alias("share"), let(F.array_sort(voiced), middle).alias("median"), *[share(c).alias(f"voiced_{c}") for c in others])
    (median,) = quantiles(by, F.col("median"), [0.5])
    out = by.agg(F.avg("share").alias("voiced"), *[F.avg(f"voiced_{c}").alias(f"voiced_{c}") for c in others], F.avg("median").alias("mean_f0"), F.min("median").alias("min_f0"), F.max("median").alias("max_f0"), _constant(median).alias("median_f0"), F.count("*").alias("n"))
    return out.withColumn("plausible", F.col("voiced").between(0.2, 0.95) & F.col("median_f0").between(60, 400))


def permutation_share(df: DataFrame, component: str = "component", floor: float = 1e-9) -> DataFrame:
    """df: component, shuffled, right (losses). 100 (mean shuffled - mean right) / mean right."""
    right = F.avg("right")
    return df.groupBy(component).agg((100 * (F.avg("shuffled") - right) / F.greatest(right, F.lit(floor))).alias("percent"), F.count("*").alias("n"))


def census(df: DataFrame, holdout: DataFrame, corpus: str = "corpus", text: str = "text", voice: str = "voice") -> DataFrame:
    """By corpus: records, unique texts, voices, and records whose text is held out (trimmed, lower-cased)."""
    held = holdout.select(F.lower(F.trim(F.col(text))).alias("__k")).distinct().withColumn("__h", F.lit(True))
    rows = df.withColumn("__k", F.lower(F.trim(F.col(text)))).join(held, "__k", "left")
    return rows.groupBy(corpus).agg(F.count("*").alias("records"), F.count_distinct("__k").alias("unique_texts"), F.count_distinct(voice).alias("voices"), F.count("__h").alias("held_out"))


def pair_agreement(df: DataFrame, group: str, id_col: str, series: str, tile: int = 2048) -> DataFrame:
    """(class, mean, n, min, max) of the correlations of all pairs of renditions within a group, all series of one length.

    No pairs are formed: a group's items are cut into tiles of `tile`, each two tiles meet once, and what leaves a task is the sum,
    number and bounds of a product of two matrices.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    sizes = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    rows = df.select(group, F.col(id_col).cast("string").alias("id"), F.col(series).cast("array<double>").alias("v")).where(F.col("v").isNotNull()).join(sizes, group)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = rows.select(group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v")

    def run(cell: pa.Table) -> pa.Table:
        own, x, y = (cell[c].to_numpy() for c in ("own", "x", "y"))
        z = np.stack([np.asarray(v, float) for v in cell["v"].to_pylist()])
        z = z - z.mean(axis=1, keepdims=True)
        norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
        z = np.where(norm > 0, z / np.where(norm > 0, norm, 1), np.nan)  # a constant series correlates with none
        a, b = z[own == x], z[own == y]
        rho = (a @ b.T)[np.triu_indices(len(a), 1)] if x[0] == y[0] else (a @ b.T).ravel()
        rho = rho[~np.isnan(rho)]
        if not len(rho):
            return pa.table({"s": pa.array([], pa.float64()), "n": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        return pa.table({"s": [float(rho.sum())], "n": [len(rho)], "low": [float(rho.min())], "high": [float(rho.max())]})

    out = cells.groupBy(group, "x", "y").applyInArrow(run, "s double, n bigint, low double, high double")
    return out.agg(F.lit("same").alias("class"), (F.sum("s") / F.sum("n")).alias("mean"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("min"), F.max("high").alias("max"))
