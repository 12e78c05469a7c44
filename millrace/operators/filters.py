"""Projections, filters and gates (P)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.order import few, running


@dataclass(frozen=True)
class CurateConfig:
    """The gates' thresholds."""

    min_duration_s: float = 3.0
    max_duration_s: float = 30.0
    min_rms_dbfs: float = -45.0
    max_clipping_ratio: float = 0.01
    max_silence_ratio: float = 0.50
    min_snr_db: float = 15.0
    min_bandwidth_hz: float = 5000.0
    min_mos: float = 2.0
    max_wer: float = 0.15


def gate_reasons(cfg: CurateConfig = CurateConfig()) -> Column:
    """All reasons against a record, with values, from its columns duration_s, rms_db, clipping_ratio, silence_ratio,
    snr_db, bandwidth99_hz and mos. A measure that is null is not held against it."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("duration_s") < cfg.min_duration_s, F.format_string(f"too_short(%.2fs<{cfg.min_duration_s})", c("duration_s"))),
            F.when(c("duration_s") > cfg.max_duration_s, F.format_string(f"too_long(%.2fs>{cfg.max_duration_s})", c("duration_s"))),
            F.when(c("rms_db") < cfg.min_rms_dbfs, F.format_string(f"low_level(%.1fdBFS<{cfg.min_rms_dbfs})", c("rms_db"))),
            F.when(c("clipping_ratio") > cfg.max_clipping_ratio, F.format_string("clipping(%.3f)", c("clipping_ratio"))),
            F.when(c("silence_ratio") > cfg.max_silence_ratio, F.format_string("mostly_silent(%.2f)", c("silence_ratio"))),
            F.when(c("snr_db") < cfg.min_snr_db, F.format_string("low_snr(%.1fdB)", c("snr_db"))),
            F.when(c("bandwidth99_hz") < cfg.min_bandwidth_hz, F.format_string("narrowband(%.0fHz)", c("bandwidth99_hz"))),
            F.when(c("mos") < cfg.min_mos, F.format_string("low_mos(%.2f)", c("mos"))),
        )
    )


def apply_gates(df: DataFrame, cfg: CurateConfig = CurateConfig()) -> DataFrame:
    """Adds reasons, keep and notes. Measures that the table lacks count as null."""
    for name in ("duration_s", "rms_db", "clipping_ratio", "silence_ratio", "snr_db", "bandwidth99_hz", "mos"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    notes = F.array_compact(F.array(F.when(F.col("snr_db").isNull(), F.lit("snr_unevaluable")), F.when(F.col("mos").isNull(), F.lit("mos_unavailable"))))
    return df.withColumn("reasons", gate_reasons(cfg)).withColumn("keep", F.size("reasons") == 0).withColumn("notes", notes)


def asr_gate(df: DataFrame, transcripts: str = "transcripts", max_wer: float = 0.15) -> DataFrame:
    """Kept records whose transcripts disagree too much get a reason; without two transcripts a note."""
    wer = F.when(F.col("keep") & (F.size(transcripts) >= 2), T.average_pairwise_wer(F.col(transcripts)))
    df = df.withColumn("asr_wer", wer)
    bad = F.coalesce(F.col("asr_wer") > max_wer, F.lit(False))
    df = df.withColumn("reasons", F.when(bad, F.array_append("reasons", F.format_string("asr_disagreement(%.2f)", "asr_wer"))).otherwise(F.col("reasons")))
    df = df.withColumn("notes", F.when(F.col("keep") & F.col("asr_wer").isNull(), F.array_append("notes", F.lit("asr_skipped"))).otherwise(F.col("notes")))
    return df.withColumn("keep", F.col("keep") & ~bad)


# A sentence's characters, its longest word and the longest line.
PLAIN, LONGEST_WORD, LONGEST_LINE = r"^[A-Za-z][A-Za-z ,;:'\-()]*[.!?]$", 16, 400


def sentences(df: DataFrame, text: str = "text", min_words: int = 8, max_words: int = 22) -> DataFrame:
    """Explodes text into usable sentences: adds pos (the sentence's place) and sentence."""
    raw = df.select("*", F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("pos", "__raw"))
    raw = raw.where((F.length("__raw") >= 2 * min_words) & F.col("__raw").rlike(r"[.!?][\s_]*$"))  # cheap, and true of all that stay

    def cleaned(line: Column) -> Column:
        spoken = T.squeeze(F.regexp_replace(F.replace(line, F.lit("_"), F.lit(" ")), "--", ", "))
        return F.when((line != "") & (F.length(line) <= LONGEST_LINE), spoken)

    def good(s: Column) -> Column:
        return s.rlike(PLAIN) & T.is_usable_prompt(s, min_words, max_words) & F.forall(T.words(s), lambda w: F.length(w) <= LONGEST_WORD)

    # An array of none or one, so that each step is computed once however often it is named.
    one = F.filter(F.transform(F.array(T.squeeze(F.col("__raw"))), cleaned), lambda s: F.coalesce(good(s), F.lit(False)))
    return raw.withColumn("sentence", F.explode(one)).drop("__raw")


# Speaker lines, stage directions and boilerplate of plays.
SPEAKER = r"^([A-Z][A-Z0-9 .'\-]{1,30})\.\s*$"
STAGE = r"^[\[(].*[\])]\s*$"
BOILERPLATE = r"(?i)gutenberg|copyright|licence|license|transcriber|www\.|http|^\s*(act|scene)\b|dramatis personae"


def turns_from_play(df: DataFrame, play: str = "play", text: str = "text") -> DataFrame:
    """(play, turn, speaker, said): spoken turns in order; what comes before the first speaker is dropped."""
    lines = df.select(F.col(play).alias("play"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("n", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    spoke = F.col("line").rlike(SPEAKER)
    upto = Window.partitionBy("play").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("turn", F.sum(spoke.cast("int")).over(upto)).where("turn > 0")
    name = F.when(spoke, F.regexp_extract("line", SPEAKER, 1))
    words = F.when(~spoke & ~F.col("line").rlike(STAGE) & ~F.col("line").rlike(BOILERPLATE), F.struct("n", "line"))
    turns = lines.groupBy("play", "turn").agg(F.max(name).alias("speaker"), F.array_sort(F.collect_list(words)).alias("own"))
    said = T.squeeze(F.array_join(F.transform("own", lambda x: x["line"]), " "))
    return turns.select("play", "turn", "speaker", said.alias("said")).where("said <> ''")


def turn_window(df: DataFrame, used: DataFrame | None = None, said: str = "said", low: int = 25, high: int = 220) -> DataFrame:
    """Turns of usable length that are not used already (used: a column of the same name)."""
    df = df.where(F.length(said).between(low, high))
    return df if used is None else df.join(used.select(said).distinct(), said, "left_anti")


# The registry of teachers (name, licence of the weights, may train, restricted).
TEACHERS = [
    ("orpheus", "apache-2.0 tag, Llama 3.2 base", True, False),
    ("kokoro", "Apache-2.0", True, False),
    ("minimax", "proprietary", False, True),
    ("stub_low", "n/a", True, False),
    ("stub_high", "n/a", True, False),
    ("speechify", "proprietary service", True, False),
    ("drama3", "proprietary hosted inference", True, True),
]


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table: name, licence, allows_training, restricted."""
    return spark.createDataFrame(TEACHERS, "name string, licence string, allows_training boolean, restricted boolean")


def licence_gate(df: DataFrame, registry: DataFrame, name: str = "teacher", acknowledged: bool = False, strict: bool = False) -> DataFrame:
    """Rows whose teacher is in the registry (name, restricted) and free, or acknowledged. strict: others are an error.
    A registry is a configured list of names; it is broadcast if it is counted to be small."""
    known = few(registry.select(F.col("name").alias("__name"), "restricted"))
    joined = df.join(known, F.col(name) == F.col("__name"), "left")
    bad = F.col("__name").isNull() | (F.coalesce("restricted", F.lit(True)) & F.lit(not acknowledged))
    if strict:
        refused = F.raise_error(F.concat(F.lit("refused teacher: "), F.coalesce(name, F.lit("null"))))
        return joined.where(F.when(bad, refused.cast("boolean")).otherwise(True)).select(df.columns)
    return joined.where(~bad).select(df.columns)


def min_support(df: DataFrame, group: str, least: int = 4) -> DataFrame:
    """Rows of groups with at least so many rows (counted with map-side combining, then semi-joined)."""
    return df.join(df.groupBy(group).count().where(F.col("count") >= least).select(group), group, "left_semi")


def only_teacher(df: DataFrame, teacher: str, options: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of the teacher that have a variant, a row of counts: taken, other_teacher, without_variant)."""
    own, some = F.col("teacher") == teacher, F.size(options) > 0
    counts = df.agg(F.count_if(own & some).alias("taken"), F.count_if(~own).alias("other_teacher"), F.count_if(own & ~some).alias("without_variant"))
    return df.where(own & some), counts


def clean_words(df: DataFrame, start: str = "start", end: str = "end", word: str = "word") -> DataFrame:
    """Timed words with both times, text, and an end after their start."""
    df = df.withColumn(start, F.col(start).try_cast("double")).withColumn(end, F.col(end).try_cast("double")).withColumn(word, F.trim(word))
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(word) != "") & (F.col(end) > F.col(start)))


def varied_dims(df: DataFrame, dim: str, value: str, least: float = 1e-6) -> DataFrame:
    """Rows of dimensions whose deviation is not degenerate."""
    return df.join(df.groupBy(dim).agg(F.stddev_samp(value).alias("__sd")).where(F.col("__sd") >= least).select(dim), dim, "left_semi")


def cap_share(df: DataFrame, shard: str, teacher: str, share: float, order: str) -> DataFrame:
    """At most so large a share of a shard's rows from one teacher, the first by order (a number) staying."""
    every = df.groupBy(shard).agg(F.count("*").alias("__n"))
    every = F.broadcast(every) if every.count() <= 100_000 else every
    return running(df, order, "__r", None, (shard, teacher)).join(every, shard).where(F.col("__r") <= F.floor(F.col("__n") * share)).select(df.columns)


def flag_disagreement(df: DataFrame, max_spread: float, text: str = "text", wer: str = "wer") -> DataFrame:
    """Adds spread (of the error rate over a text's renditions) and disagrees; all rows stay."""
    spread = df.groupBy(text).agg((F.max(wer) - F.min(wer)).alias("spread"))
    return df.join(spread, text, "left").withColumn("disagrees", F.coalesce(F.col("spread") > max_spread, F.lit(False)))
