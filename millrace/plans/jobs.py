"""Composite jobs (C): operators put together as a user would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import filters as P
from millrace.operators import joins as J
from millrace.operators import align, sets
from millrace.operators import windows as W
from millrace.operators.order import few, hash_key, indexed
from millrace.operators.signal import with_spectral
from millrace.sources.manifests import corpus_meta, write_shards


def build_prompts(books: DataFrame, target: int = 500, min_words: int = 8, max_words: int = 22) -> DataFrame:
    """C1. books: doc_id, source, text. (rank, source, doc_id, pos, sentence): first of each key, round-robin by source."""
    found = P.sentences(books.select("doc_id", "source", "text"), min_words=min_words, max_words=max_words).drop("text")
    first = W.dedup_first(found, T.match_key(F.col("sentence")), "source", "doc_id", "pos")
    chosen = W.interleave(first, "source", "doc_id", "pos", limit=target)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy("turn", "group_rank"))).drop("turn", "group_rank")


def prompt_provenance(books: DataFrame, prompts: DataFrame, min_words: int = 8, max_words: int = 22) -> DataFrame:
    """C1's counts by source: (source, chars, sentences_found, sentences_kept, selected): sentences before and after the first of each key
    is kept, and those among prompts."""
    chars = books.groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    found = P.sentences(books.select("doc_id", "source", "text"), min_words=min_words, max_words=max_words).drop("text")
    keyed = found.groupBy(T.match_key(F.col("sentence")).alias("k")).agg(F.min(F.struct("source", "doc_id", "pos")).alias("first"))
    kept = keyed.groupBy("first.source").agg(F.count("*").alias("sentences_kept"))
    all_ = found.groupBy("source").agg(F.count("*").alias("sentences_found"))
    chosen = prompts.groupBy("source").agg(F.count("*").alias("selected"))
    out = chars
    for table in (all_, kept, chosen):
        out = out.join(table, "source", "left")
    return out.na.fill(0, ["sentences_found", "sentences_kept", "selected"])


def holdout_prompts(books: DataFrame, used: DataFrame, per_source: int) -> DataFrame:
    """C2. The first sentences of each source whose key isn't used; (source, doc_id, pos, sentence). Evaluation fails if one is used after all."""
    found = P.sentences(books.select("doc_id", "source", "text")).drop("text")
    keys = used.select(T.match_key(F.col("text")).alias("key"))
    fresh = J.exclude(found, keys, key=T.match_key(F.col("sentence")))
    chosen = W.head_per_group(fresh, "source", per_source, "doc_id", "pos").withColumn("key", T.match_key(F.col("sentence")))
    return sets.assert_disjoint(chosen, keys, "key").select("source", "doc_id", "pos", "sentence")


def expansion_prompts(books: DataFrame, *blocked: DataFrame, characters: int = 100_000) -> DataFrame:
    """C3. (source, doc_id, pos, text): new stretches of text that read as prompts, each once, under a budget of characters
    spread over the sources. blocked: tables of one column of texts."""
    rows = books.select("source", "doc_id", F.posexplode(T.stretches(F.col("text"))).alias("pos", "raw")).where(T.is_expansion_candidate(F.col("raw")))
    rows = rows.select("source", "doc_id", "pos", T.squeeze(F.col("raw")).alias("text"))
    fresh = J.exclude(rows, sets.union_keys(*blocked), key=F.lower("text")) if blocked else rows
    first = W.dedup_first(fresh, F.lower("text"), "source", "doc_id", "pos")
    sources = max(1, books.select("source").distinct().count())
    return W.prefix_until(first, "source", "doc_id", F.length("text"), max(1, characters // sources), characters, "pos")


def dialogue_prompts(plays: DataFrame, used: DataFrame | None, quota: int) -> DataFrame:
    """C4. Spoken turns of usable length, from each play until the first that would pass the quota."""
    return W.prefix_within(P.turn_window(P.turns_from_play(plays), used), "play", "turn", F.length("said"), quota)


def schedule_corpus(prompts: DataFrame, mix: list[tuple[str, float]], voices: list[str], registry: DataFrame, key: str = "doc_id") -> DataFrame:
    """C5. Prompts with utt_id, teacher, voice, tags and licence; teachers that may not be used are refused."""
    rows = indexed(prompts, key)
    rows = rows.withColumn("teacher", W.schedule(F.col("idx"), mix)).withColumn("voice", W.assign_voice(F.col("idx"), voices)).withColumn("tags", T.scan_tags(F.col("text")))
    allowed = P.licence_gate(rows, registry, strict=True)
    licences = registry.select(F.col("name").alias("teacher"), F.col("licence").alias("license"))
    return allowed.join(few(licences), "teacher").withColumn("utt_id", F.format_string("%08d", "idx"))


def scheduled_corpus(prompts: DataFrame, mix: list[tuple[str, float]], voices: list[str], registry: DataFrame, seconds: Column, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """C5 in full: (records with duration_s, metadata: mix, records, hours, and each teacher's records and licence)."""
    rows = schedule_corpus(prompts, mix, voices, registry, key).withColumn("duration_s", seconds)
    weights = rows.sparkSession.createDataFrame(mix, "name string, weight double")
    by = rows.groupBy("teacher").agg(F.count("*").alias("n"), F.any_value("license").alias("license"))
    teachers = by.agg(F.array_sort(F.collect_list(F.struct("teacher", "n", "license"))).alias("teachers"))  # a row a teacher
    return rows, corpus_meta(rows, weights).crossJoin(teachers)  # one row each


def measure(waves: DataFrame, sr: int = 24000) -> DataFrame:
    """waves: wav. Adds every measure that the gates read."""
    rows = waves.withColumn("l", N.levels(F.col("wav"))).select("*", "l.*").drop("l")
    rows = rows.withColumn("duration_s", F.size("wav") / sr).withColumn("silence_ratio", N.silence_ratio(F.col("wav"))).withColumn("snr_db", N.estimate_snr_db(F.col("wav"), sr))
    return with_spectral(rows, "wav", sr)


def curate(waves: DataFrame, cfg: P.CurateConfig = P.CurateConfig(), sr: int = 24000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C6. (records with reasons and keep, report, reason counts)."""
    rows = P.apply_gates(measure(waves, sr), cfg)
    rows = P.asr_gate(rows, max_wer=cfg.max_wer) if "transcripts" in waves.columns else rows
    return rows, A.curation_report(rows), A.reason_counts(rows)


def ingest(words: DataFrame, min_s: float = 3.0, max_s: float = 15.0, gap_s: float = 0.3) -> DataFrame:
    """C7. words: recording, start, end, word; recordings may have any length. (utt_id, recording, start, end, text): segments, over-long ones split."""
    segments = W.segment_recordings(P.clean_words(words), "recording", min_s, max_s, gap_s)
    cut = W.split_recordings(segments, "recording", max_s)
    rows = indexed(cut.withColumnRenamed("n", "__n"), "__n", "n", ("recording",), ("p",)).select("recording", F.col("n").cast("int").alias("n"), "start", "end", F.trim("text").alias("text"))
    return rows.where((F.col("end") - F.col("start") >= min_s) & (F.col("text") != "")).withColumn("utt_id", F.concat_ws("_", "recording", F.format_string("%05d", "n"))).withColumn("text_source", F.lit("words"))


def mix_corpora(corpora: dict[str, DataFrame], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """C8. (records of all corpora in interleaved order of teachers, minutes by teacher). Records have doc_id."""
    rows = sets.union_corpora(corpora)
    rows = W.head_per_group(rows, "corpus", limit, "doc_id") if limit else rows
    return W.interleave(rows, "teacher", "doc_id", "corpus"), A.teacher_minutes(rows)


def feature_cache(records: DataFrame, mix: DataFrame) -> DataFrame:
    """C10. records: utt_id, text, teacher, voice, mos, energy (array). ids, durations, token energies and weights."""
    rows = J.attach_share(records, mix).withColumn("ids", T.char_ids(F.col("text")))
    n = F.greatest(F.least(F.size("ids"), F.size("energy")), F.lit(1))
    rows = rows.withColumn("durations", N.fallback_durations(F.transform("energy", lambda x: x.cast("double")), n))
    spans = N.token_spans(F.col("durations"), F.size("energy"))
    return rows.withColumn("token_energy", N.span_means(F.col("energy"), spans)).withColumn("weight", N.sample_weight(F.col("share"), F.col("mos")))


def build_cache(records: DataFrame, mix: DataFrame, folder: str, rate: int = 3, items: int = 500) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """C10 in full: (items as written, index of files, teachers, voices), the cache written to folder in files of `items` rows.

    records: utt_id, text, teacher, voice, mos, energy, f0 and latent (arrays over frames), token_frames (frames of each character, null without an
    alignment). Durations come from the alignment where it has one number a token and covers the frames, and are estimated from the energy
    elsewhere (aligned tells which). Tokens get means of energy and pitch (over voiced frames, filled from the nearest) and `rate` sub-span
    means of latent; teachers and voices are numbered in order of their first utt_id.
    """
    rows = J.attach_share(records, mix).withColumn("ids", T.char_ids(F.col("text"), add_special=False))
    frames = F.size("energy")
    spoken = F.aggregate("token_frames", F.lit(0), lambda a, x: a + x.cast("int"))
    fits = F.coalesce((F.size("token_frames") == F.size("ids")) & (spoken <= frames) & (F.size("ids") > 0), F.lit(False))
    n = F.greatest(F.least(F.size("ids"), frames), F.lit(1))
    guessed = N.fallback_durations(F.transform("energy", lambda x: x.cast("double")), n)
    rows = rows.withColumn("aligned", fits).withColumn("durations", F.when(fits, F.col("token_frames").cast("array<int>")).otherwise(guessed))
    spans = N.token_spans(F.col("durations"), frames)
    rows = rows.withColumn("token_energy", N.span_means(F.col("energy"), spans)).withColumn("token_f0", N.fill_nearest(N.span_means(F.col("f0"), spans, ignore_zeros=True)))
    rows = rows.withColumn("token_latent", align.token_vectors(F.col("latent"), F.col("durations"), rate)).withColumn("weight", N.sample_weight(F.col("share"), F.col("mos")))
    dims = {name: W.dense_index(records.where(F.col(name).isNotNull()), name, "utt_id") for name in ("teacher", "voice")}
    for name, dim in dims.items():
        rows = rows.join(dim.select(name, F.col("idx").alias(f"{name}_index")), name, "left")
    columns = ["utt_id", "ids", "aligned", "durations", "token_energy", "token_f0", "token_latent", "weight", "teacher_index", "voice_index"]
    index = write_shards(rows.select(columns), f"{folder}/items", items)
    index.write.mode("overwrite").json(f"{folder}/index")  # beside the shards
    spark = records.sparkSession
    return spark.read.parquet(f"{folder}/items"), spark.read.schema(index.schema).json(f"{folder}/index"), dims["teacher"], dims["voice"]


def expand_cache(base: DataFrame, extra: DataFrame, base_voices: DataFrame, extra_voices: DataFrame, prints: tuple[str, str], base_frames: DataFrame, extra_frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """C11 in full: merge first (U2), fit and apply statistics on the merged cache (A4, A5, J5), check its scale (A8) and widths (A9) last.

    base, extra: id, voice, width, tag; their frames: id, dim, value. Sources are the merge's tags. (items, normalised frames, scale check, widths).
    """
    merged = sets.merge_caches(base, extra, base_voices, extra_voices, *prints)
    side = F.element_at(F.split("tag", ">"), -1)
    frames = base_frames.withColumn("__side", F.lit("0")).unionByName(extra_frames.withColumn("__side", F.lit("1")))
    own = merged.select("id", side.alias("__side"), F.col("name").alias("voice"), F.col("tag").alias("source"))
    normed, scale = expand_corpus(frames.join(own, ["id", "__side"]).drop("__side").withColumnRenamed("id", "utt"))
    return merged, normed, scale, merged.groupBy("width").agg(F.count("*").alias("n"))


def expand_corpus(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C11. frames: utt, voice, source, dim, value, of the merged corpus. (normalised frames, scale check by voice)."""
    stats = A.voice_source_stats(frames)
    normed = J.apply_norm(frames, stats.where("all_sources = 0"), stats.where("all_sources = 1"))
    return normed, A.scale_check(normed)


def validate(records: DataFrame, holdout: DataFrame) -> DataFrame:
    """C12. (check, bad): rows that break each rule; all should be 0. records: utt_id, text, sample_rate, duration_s, license."""
    one = lambda name, df: df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad")
    missing = records.where(F.col("utt_id").isNull() | F.col("text").isNull() | F.col("license").isNull())
    checks = [
        one("missing fields", missing),
        one("repeated ids", A.duplicates(records, F.col("utt_id"))),
        one("held-out texts", J.holdout_overlap(records, holdout)),
        one("duration", records.where(~F.col("duration_s").between(3, 30))),
        one("further sample rates", records.select("sample_rate").distinct().offset(1)),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def validation_report(records: DataFrame, holdout: DataFrame, files: DataFrame, low: float = 1.0, high: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """C12 in full: (checks, summary). records also hold wav_path and voice; files: path, of what exists.

    checks: validate()'s and the records whose file is missing. summary: one row of records, distinct and repeated texts, voices, held-out texts,
    and the durations' hours, median, bounds and number out of range (a warning, not a check).
    """
    lost = records.join(files.select(F.col("path").alias("wav_path")).distinct(), "wav_path", "left_anti")
    checks = validate(records, holdout).unionByName(lost.agg(F.count("*").alias("bad")).select(F.lit("missing files").alias("check"), "bad"))
    texts = records.groupBy("text").agg(F.count("*").alias("n")).agg(F.count("text").alias("distinct_texts"), F.count_if(F.col("n") > 1).alias("repeated_texts"))
    counts = records.agg(F.count("*").alias("records"), F.count_distinct("voice").alias("voices"))
    held = holdout.select(F.lower(F.trim("text")).alias("t")).distinct().agg(F.count("*").alias("held_out"))
    return checks, counts.crossJoin(texts).crossJoin(held).crossJoin(A.duration_summary(records, "duration_s", low, high))  # one row each


def shared_targets(base: DataFrame, variants: DataFrame, offset: int | None = None) -> tuple[DataFrame, DataFrame]:
    """C13 in full: (renditions, originals), each utt_id, kind and target, the mean series of a pair averaged over each token's frames.

    base: utt_id, idx, durations, series; variants: utt_id, variant_of (or idx, where items are paired by offset), series. A pair's shared series is the mean
    of both over the shorter one (F48), its target a mean a token (F43). originals: the control, with targets of their own series alone. Refused
    if a variant has no base record.
    """
    own = base.select("utt_id", "idx", "durations", "series")
    if offset is None:
        missing = variants.join(own.select(F.col("utt_id").alias("variant_of")), "variant_of", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"no base record of {missing[0]['utt_id']}")
        pairs = J.pair_by_ref(variants, own)
    else:
        named = own.select([F.col(c).alias(f"base_{c}") for c in own.columns])
        pairs = variants.join(named, F.col("idx") == F.col("base_idx") + offset)
    shared = N.mean_series(F.col("series"), F.col("base_series"))
    renditions = pairs.select("utt_id", F.lit("shared").alias("kind"), align.span_average(shared, F.col("base_durations")).alias("target"))
    originals = own.select("utt_id", F.lit("own").alias("kind"), align.span_average(F.col("series"), F.col("durations")).alias("target"))
    return renditions, originals


def rendition_pairs(base: DataFrame, variants: DataFrame) -> DataFrame:
    """C13. base: utt_id, series; variants: variant_of, series. Pairs with their shared (mean) series."""
    pairs = J.pair_by_ref(variants, base)
    return pairs.withColumn("shared", N.mean_series(F.col("series"), F.col("base_series")))


def paired_batches(items: DataFrame, id_col: str, voice: str, size: int, seed: int, epoch: int) -> DataFrame:
    """C14. Items in an epoch's batches with a partner of the same voice and one of another."""
    rows = W.epoch_batches(items, id_col, size, seed, epoch)
    pos = J.positive_pair(items, voice, id_col, seed + epoch).select(F.col("id").alias(id_col), F.col("partner").alias("positive"))
    neg = J.negative_pair(items, voice, id_col, seed + epoch).select(F.col("id").alias(id_col), F.col("partner").alias("negative"))
    return rows.join(pos, id_col).join(neg, id_col)


def cropped(items: DataFrame, id_col: str, frames: list[str], tokens: list[str], size: int, seed: int, epoch: int, durations: str = "durations") -> DataFrame:
    """Items whose frame arrays are cut to a window of `size` frames at a hashed place, and whose token arrays to the tokens it touches (F47).

    An item that is no longer than the window, or can't be cropped, stays whole. Adds crop (null for these).
    """
    total = F.size(frames[0])
    draw = hash_key(seed + epoch, id_col)
    start = F.pmod(draw, F.greatest(total - size + 1, F.lit(1)).cast("bigint")).cast("int")
    crop = F.when(total > size, align.crop_to_tokens(F.col(durations), F.col(frames[0]), start, F.lit(size)))
    rows = items.withColumn("crop", crop)
    cut = {c: F.when(F.col("crop").isNull(), F.col(c)).otherwise(F.slice(c, F.col("crop.start") + 1, F.col("crop.frames"))) for c in frames}
    cut |= {c: F.when(F.col("crop").isNull(), F.col(c)).otherwise(F.slice(c, F.col("crop.first") + 1, F.col("crop.last") - F.col("crop.first"))) for c in tokens}
    return rows.withColumns(cut)


def training_batches(
    items: DataFrame, id_col: str, voice: str, size: int, seed: int, epoch: int, frames: list[str], tokens: list[str], reference: str, crop_frames: int | None = None, max_ref: int | None = None, scalars: tuple[str, ...] = ()
) -> DataFrame:
    """C14. An epoch's padded batches: cropped items (W18, F47) with the reference series of another item of their voice and of one of another
    voice (J11, J12), all columns padded with masks (W19). durations must be among tokens. The reference is cut to max_ref frames.
    """
    batches = paired_batches(items, id_col, voice, size, seed, epoch)
    batches = cropped(batches, id_col, frames, tokens, crop_frames, seed, epoch) if crop_frames else batches
    series = items.select(F.col(id_col).alias("__id"), F.col(reference).alias("__ref"))
    for kind in ("positive", "negative"):
        own = series.select(F.col("__id").alias(kind), F.col("__ref").alias(f"ref_{kind}"))
        batches = batches.join(own, kind, "left")
    axes = {"text": tokens, "frame": frames, "ref": ["ref_positive"], "ref_neg": ["ref_negative"]}
    caps = {} if max_ref is None else {"ref": max_ref, "ref_neg": max_ref}
    return W.pad_columns(batches, "batch", "slot", axes, caps, (id_col, voice, "positive", "negative", *scalars))


def disjoint_corpus(prompts: DataFrame, voices: DataFrame, waves: DataFrame, n_val: int, cfg: P.CurateConfig = P.CurateConfig()) -> tuple[DataFrame, DataFrame]:
    """C9. prompts: text; voices: voice; waves: text, voice, wav. (kept records of the grid with their split, report)."""
    rows, report, _ = curate(J.grid(prompts, voices).join(waves, ["text", "voice"]), cfg)
    return W.split_by_text(rows.where("keep"), "text", n_val), report


def claims_report(claims: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """C15. Each claim's measurement and outcome, and what evidence is kept for it. claims also holds path."""
    from millrace.sources.manifests import evidence_manifest

    return A.evaluate_claims(claims, reports).join(evidence_manifest(claims.select("claim", "path"), files), "claim")
