"""Registered queries of batches, fingerprints and spectra over the given tables, each with SQL for the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import align, picks, signal
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.operators.order import indexed
from millrace.plans import jobs
from millrace.plans.adapters import frames, scratch, table
from millrace.plans.more_queries import SIG, SILENT, YIN, signals, vectors
from millrace.plans.queries import LONG, SENT, hashed_sql, negatives_sql, query, r6, rounded
from millrace.sources import manifests as S

#: Items i(id, voice, x, durations, ids, energy): vectors as series of 64 frames and eight tokens.
ITEMS = "i AS (SELECT vec_id AS id, label AS voice, [CAST(v AS DOUBLE) for v in embedding] AS x, [4, 4, 8, 8, 12, 12, 8, 8] AS durations, [k + vec_id % 10 for k in range(1, 9)] AS ids FROM embeddings)"
PADDED = "list_concat({0}, [0 for k in range({1} - len({0}))])"


@query(
    f"""WITH {ITEMS}, b AS (SELECT id, row_number() OVER (ORDER BY md5('0:1:' || id), id) - 1 AS nth, count(*) OVER () AS n FROM i),
    p AS (SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS positive FROM i WINDOW w AS (PARTITION BY voice ORDER BY {hashed_sql(1, 'id')}, id)), {negatives_sql('i', 1)},
    c AS (SELECT i.*, nth // 16 AS batch, nth % 16 AS slot, positive, partner AS negative, {hashed_sql(1, 'id')} % 41 AS start FROM i JOIN b USING (id) JOIN p USING (id) LEFT JOIN np USING (id) WHERE nth < n // 16 * 16),
    e AS (SELECT *, len([t for t in [4, 8, 16, 24, 36, 48, 56, 64] if t < start]) AS first, least(len([t for t in [4, 8, 16, 24, 36, 48, 56, 64] if t < start + 23]) + 1, 8) AS last FROM c),
    k AS (SELECT e.*, e.x[start + 1:start + 24] AS cx, e.ids[first + 1:last] AS cids, e.durations[first + 1:last] AS cdur, q.x[:20] AS rp, r.x[:20] AS rn FROM e JOIN i q ON q.id = positive JOIN i r ON r.id = negative),
    w AS (SELECT *, max(len(cids)) OVER (PARTITION BY batch) AS width FROM k)
    SELECT batch, slot, id AS vec_id, voice AS label, positive, negative, {PADDED.format('cids', 'width')} AS ids, {PADDED.format('cdur', 'width')} AS durations, [CASE WHEN k < len(cids) THEN 1 ELSE 0 END for k in range(width)] AS text_mask,
      cx AS x, [1 for k in range(24)] AS frame_mask, rp AS ref_positive, [1 for k in range(20)] AS ref_mask, rn AS ref_negative, len(cids) AS tokens FROM w"""
)
def c14_training_batches(spark, d):
    """All columns of an epoch's padded batches, with crops of 24 frames and references of 20."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: k + F.col("vec_id") % 10)
    items = vectors(spark, d).withColumn("durations", F.array(*map(F.lit, [4, 4, 8, 8, 12, 12, 8, 8]))).withColumn("ids", ids.cast("array<bigint>"))
    out = jobs.training_batches(items, "vec_id", "label", 16, 0, 1, ["x"], ["ids", "durations"], "x", crop_frames=24, max_ref=20)
    cols = ["vec_id", "label", "positive", "negative", "ids", "durations", "text_mask", "x", "frame_mask", "ref_positive", "ref_mask", "ref_negative", "text_lengths"]
    each = out.select("batch", F.posexplode(F.arrays_zip(*cols)).alias("slot", "r"))
    return each.select("batch", F.col("slot").cast("bigint").alias("slot"), *[F.col(f"r.{c}").alias("tokens" if c == "text_lengths" else c) for c in cols])


def stft_sql(n: int, hop: int) -> str:
    """l{n}(vec_id, c, m): convergence and log distance of v(vec_id, a, b), 64 samples each, in frames of n around every hop-th sample."""
    at = f"CASE WHEN abs(i * {hop} + j - {n // 2}) < 64 THEN abs(i * {hop} + j - {n // 2}) ELSE 126 - (i * {hop} + j - {n // 2}) END + 1"
    hann = f"(0.5 - 0.5 * cos(2 * pi() * j / {n}))"
    size = lambda f: f"[sqrt(list_sum([{f}[j + 1] * {hann} * cos(2 * pi() * j * k / {n}) for j in range({n})]) ^ 2 + list_sum([{f}[j + 1] * {hann} * sin(2 * pi() * j * k / {n}) for j in range({n})]) ^ 2) for k in range({n // 2 + 1})]"
    return f"""f{n} AS (SELECT vec_id, i, [a[{at}] for j in range({n})] AS x, [b[{at}] for j in range({n})] AS y FROM (SELECT *, unnest(range({64 // hop + 1})) AS i FROM v)),
    s{n} AS (SELECT vec_id, {size('x')} AS x, {size('y')} AS y FROM f{n}),
    l{n} AS (SELECT vec_id, sqrt(sum(list_sum([(y[k] - x[k]) ^ 2 for k in range(1, {n // 2 + 2})]))) / (sqrt(sum(list_sum([t * t for t in y]))) + 1e-7) AS c, sum(list_sum([abs(ln(x[k] + 1e-7) - ln(y[k] + 1e-7)) for k in range(1, {n // 2 + 2})])) / sum(len(x)) AS m FROM s{n} GROUP BY 1)"""


@query(
    f"""WITH v AS (SELECT a.vec_id, [CAST(x AS DOUBLE) for x in a.embedding] AS a, [CAST(x AS DOUBLE) for x in b.embedding] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), {stft_sql(8, 2)}, {stft_sql(16, 4)}, {stft_sql(32, 8)}
    SELECT vec_id, round((l8.c + l16.c + l32.c) / 3, 6) AS stft_convergence, round((l8.m + l16.m + l32.m) / 3, 6) AS stft_log_mag, round((l8.c + l16.c + l32.c + l8.m + l16.m + l32.m) / 3, 6) AS stft_loss FROM l8 JOIN l16 USING (vec_id) JOIN l32 USING (vec_id)"""
)
def f50_stft_loss(spark, d):
    """Each vector against the next one, as signals, at three resolutions."""
    v = vectors(spark, d)
    pairs = v.select("vec_id", "x").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    out = signal.with_stft_loss(pairs, "x", "y", ((8, 2), (16, 4), (32, 8)))
    return r6(out.select("vec_id", "stft_convergence", "stft_log_mag", "stft_loss"), "stft_convergence", "stft_log_mag", "stft_loss")


@query(
    """SELECT l_orderkey, l_linenumber, sha256('{"v":{"a":{"line":' || l_linenumber || ',"ship":"' || l_linestatus || '"},"flags":["' || l_returnflag || '","' || l_linestatus || '"],"order":' || l_orderkey || '}}') AS print,
      true AS alike FROM lineitem"""
)
def f18_config_fingerprint(spark, d):
    """A struct, and a map of maps with its entries the other way round, have one fingerprint."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    flags = F.array("l_returnflag", "l_linestatus")
    one = F.struct(F.col("l_orderkey").alias("order"), flags.alias("flags"), F.struct(F.col("l_linestatus").alias("ship"), F.col("l_linenumber").alias("line")).alias("a"))
    two = F.struct(F.struct(F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("ship")).alias("a"), flags.alias("flags"), F.col("l_orderkey").alias("order"))
    return rows.select("l_orderkey", "l_linenumber", T.config_fingerprint(one).alias("print"), (T.config_fingerprint(one) == T.config_fingerprint(two)).alias("alike"))


@query(
    """WITH l AS (SELECT l_orderkey AS g, l_returnflag AS name, l_linenumber AS part, sha256(CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.0') AS h FROM lineitem),
    t AS (SELECT g, name, sha256(string_agg(h, '' ORDER BY part, h)) AS h FROM l GROUP BY ALL)
    SELECT g AS l_orderkey, sha256(string_agg(sha256(name || ':' || h), '' ORDER BY name)) AS fingerprint FROM t GROUP BY 1"""
)
def f18_weight_fingerprint(spark, d):
    """Orders as models: return flags as tensors, lines as their parts."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("part"), F.array("l_quantity").alias("values"))
    return align.weight_fingerprint(rows, "l_orderkey")


@query(
    f"""WITH {SIG}, {SILENT}, {YIN}, u AS (SELECT user_id, avg((f > 0)::INT) AS v, coalesce(list_sort(list(f) FILTER (f > 0))[(count(*) FILTER (f > 0)) // 2 + 1], 0) AS p FROM f0 JOIN g USING (user_id) WHERE len(x) >= 40 GROUP BY 1),
    gp AS (SELECT user_id, x FROM g WHERE len(x) >= 60), fr2 AS (SELECT user_id, i, [x[CASE WHEN abs(i * 8 + j - 16) < len(x) THEN abs(i * 8 + j - 16) ELSE 2 * (len(x) - 1) - (i * 8 + j - 16) END + 1] for j in range(32)] AS f FROM (SELECT user_id, x, unnest(range(len(x) // 8 + 1)) AS i FROM gp)),
    sp AS (SELECT user_id, [greatest(sqrt(list_sum([f[j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 32)) * cos(2 * pi() * j * k / 32) for j in range(32)]) ^ 2 + list_sum([f[j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 32)) * sin(2 * pi() * j * k / 32) for j in range(32)]) ^ 2), 1e-8) for k in range(17)] AS m FROM fr2),
    fl AS (SELECT user_id, avg(exp(list_avg([ln(t) for t in m])) / list_avg(m)) AS fl FROM sp GROUP BY 1), z AS (SELECT avg(v) AS v, list_sort(list(p))[count(*) // 2 + 1] AS p, avg(fl) AS f FROM u LEFT JOIN fl USING (user_id))
    SELECT round(v, 6) AS voiced, round(p, 3) AS median_f0, round(f, 6) AS flatness, v BETWEEN 0.25 AND 0.9 AND p BETWEEN 70 AND 350 AND coalesce(f < 0.65, true) AS speech_like FROM z"""
)
def f53_speech_of_signals(spark, d):
    """Speech-likeness from signals alone, short ones left out, in frames of 32 at 800 Hz."""
    out = align.speech_of_signals(signals(spark, d), "wav", sr=800, hop=8, frame=32, low=60, high=200, threshold=0.8, least=40, least_flat=60)
    return out.select(F.round("voiced", 6).alias("voiced"), F.round("median_f0", 3).alias("median_f0"), F.round("flatness", 6).alias("flatness"), "speech_like")


# --- full reports (A25, A26, A27, L8) and jobs (C1, C5, C10 to C13) -----------------------------------


@query(
    """WITH m AS (SELECT source AS teacher, text, quality AS mos, CASE WHEN doc_id % 5 > 0 THEN len(string_split(text, ' ')) END AS n, length(text) * 256 / 24000.0::DOUBLE * 1.05::DOUBLE AS dur FROM documents LEFT JOIN labels USING (doc_id)),
    e AS (SELECT *, CASE WHEN n > 0 AND dur > 0 THEN abs(n * 5.0::DOUBLE * 256 / 24000 - dur) / dur END AS err FROM m), t AS (SELECT map_from_entries(list((teacher, n) ORDER BY teacher)) AS teachers FROM (SELECT teacher, count(*) AS n FROM m GROUP BY 1)),
    o AS (SELECT count(*) AS records, count(n) AS aligned, quantile_cont(CASE WHEN err IS NOT NULL THEN n END::DOUBLE, 0.5) AS chars, quantile_cont(err, 0.5) AS med, list_sort(list(err) FILTER (err IS NOT NULL)) AS es, avg(mos) AS mean, quantile_cont(mos::DOUBLE, 0.5) AS mmed, list_sort(list(mos) FILTER (mos IS NOT NULL)) AS ms FROM e)
    SELECT records, aligned, round(aligned / records, 6) AS coverage, chars AS chars_median, round(med, 6) AS median_error, round(es[least(len(es) - 1, floor(len(es) * 0.9)::BIGINT) + 1], 6) AS p90_error, round(mean, 6) AS mos_mean, mmed AS mos_median,
      CAST(ms[least(len(ms) - 1, floor(len(ms) * 0.1)::BIGINT) + 1] AS DOUBLE) AS mos_p10, CAST(ms[least(len(ms) - 1, floor(len(ms) * 0.9)::BIGINT) + 1] AS DOUBLE) AS mos_p90, list_sort(list_transform(map_entries(teachers), lambda x: x.key || '=' || x.value)) AS teachers,
      ['all scored=' || (len(ms) = records), 'carries an alignment=true', 'one frame per character=false', 'reproduces the duration=' || (med < 0.1)] AS checks FROM o, t"""
)
def a25_alignment_report(spark, d):
    """Words of five frames as alignments, on four of five documents."""
    base = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("mos")), "doc_id", "left")
    held = F.when(F.col("doc_id") % 5 > 0, F.transform(F.split("text", " "), lambda w: F.lit(5)))
    rows = base.select(F.col("source").alias("teacher"), "text", "mos", held.alias("token_frames"), (F.length("text") * 256 / F.lit(24000.0) * 1.05).alias("duration_s"))
    entries = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string"))))
    out = A.alignment_report(rows)
    return r6(out.withColumn("teachers", entries("teachers")).withColumn("checks", entries("checks")), "coverage", "median_error", "p90_error", "mos_mean")


PAIRED = "b AS (SELECT a.vec_id AS utt, [abs(CAST(v AS DOUBLE)) for v in a.embedding] AS x, [abs(CAST(v AS DOUBLE)) for v in b.embedding][:60] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(
    f"""WITH {PAIRED}, p AS (SELECT utt, list_sum(x) * 1.02 AS f, x[i] AS x, y[i] AS y FROM b, range(1, 61) t(i)),
    c AS (SELECT utt, any_value(f) AS f, corr(x, y) AS r, sum(x) AS sx, sum(y) AS sy FROM p GROUP BY 1), e AS (SELECT r, abs(sx - f) / greatest(f, 1.0::DOUBLE) AS a, abs(sy - f) / greatest(f, 1.0::DOUBLE) AS b, abs(sx - sy) / greatest(sx, 1.0::DOUBLE) AS c FROM c)
    SELECT count(*) AS utterances, round(quantile_cont(r, 0.5), 6) AS median_r, round(quantile_cont(a, 0.5), 6) AS median_aligned_error, round(quantile_cont(b, 0.5), 6) AS median_fallback_error,
      quantile_cont(r, 0.5) < 0.5 AS structure, bool_and(a < 0.05 AND b < 0.05) AS cover, bool_and(c < 0.05) AS agree FROM e"""
)
def a26_alignment_summary(spark, d):
    """Absolute vectors as durations, the next vector (60 tokens of it) as the estimate."""
    v = vectors(spark, d).select("vec_id", F.transform("x", F.abs).alias("x"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("x", 1, 60).alias("y")), "vec_id")
    rows = both.select(F.col("vec_id").alias("utt"), F.col("x").alias("aligned"), F.col("y").alias("fallback"), (F.aggregate("x", F.lit(0.0), lambda a, b: a + b) * 1.02).alias("audio_frames"))
    out = A.alignment_summary(A.alignment_comparison(rows))
    named = {"structure": "changes the structure", "cover": "cover the audio", "agree": "agree on the length"}
    return r6(out.select("utterances", "median_r", "median_aligned_error", "median_fallback_error", *[F.col("checks")[k].alias(c) for c, k in named.items()]), "median_r", "median_aligned_error", "median_fallback_error")


@query(
    """WITH v AS (SELECT a.vec_id AS utt, CASE WHEN a.vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, [CAST(x AS DOUBLE) for x in a.embedding] AS x, [CAST(x AS DOUBLE) for x in b.embedding] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    l AS (SELECT utt, split, i % 8 AS dim, i // 8 AS tok, x[i + 1] AS t, y[i + 1] AS p FROM v, range(64) r(i)),
    k AS (SELECT utt, split, avg(abs(p - t)) FILTER (dim = 0) AS duration_mae, sum(p) FILTER (dim = 0) / greatest(sum(t) FILTER (dim = 0), 1.0::DOUBLE) AS duration_ratio, avg(abs(p - t)) FILTER (dim = 1) AS f0_mae, avg(abs(p - t)) FILTER (dim = 2) AS energy_mae,
      sum(p * t) / greatest(sqrt(sum(p * p)) * sqrt(sum(t * t)), 1e-8) AS cosine FROM l GROUP BY ALL),
    r AS (SELECT utt, avg(c) AS dim_correlation FROM (SELECT utt, dim, corr(t, p) AS c FROM l GROUP BY ALL HAVING stddev_samp(t) >= 1e-6 AND stddev_samp(p) >= 1e-6) GROUP BY 1),
    m AS (SELECT split, avg(duration_mae) AS duration_mae, avg(duration_ratio) AS duration_ratio, avg(f0_mae) AS f0_mae, avg(energy_mae) AS energy_mae, avg(cosine) AS cosine, avg(dim_correlation) AS dim_correlation FROM k JOIN r USING (utt) GROUP BY 1),
    u AS (UNPIVOT m ON duration_mae, duration_ratio, f0_mae, energy_mae, cosine, dim_correlation INTO NAME measure VALUE v)
    SELECT measure, round(max(v) FILTER (split = 'train'), 6) AS train, round(max(v) FILTER (split = 'val'), 6) AS val, round(max(v) FILTER (split = 'train') - max(v) FILTER (split = 'val'), 6) AS gap FROM u GROUP BY 1"""
)
def a27_fit_report(spark, d):
    """The next vector as the prediction; its first three dimensions as durations, pitch and energy."""
    rows = frames(spark, d).select("utt", (F.col("dim") % 8).alias("dim"), F.floor(F.col("dim") / 8).alias("tok"), "value")
    both = rows.withColumnRenamed("value", "true").join(rows.select((F.col("utt") - 1).alias("utt"), "dim", "tok", F.col("value").alias("pred")), ["utt", "dim", "tok"])
    latents = both.withColumn("split", F.when(F.col("utt") % 4 == 0, "val").otherwise("train"))
    pick = lambda c, k: F.max(F.when(F.col("dim") == k, F.col(c)))
    names = ["dur", "f0", "energy"]
    tokens = latents.groupBy("split", "utt", "tok").agg(*[pick(c, k).alias(f"{c}_{n}") for k, n in enumerate(names) for c in ("true", "pred")])
    return r6(A.fit_report(tokens, latents), "train", "val", "gap")


@query("SELECT CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, coalesce(label, -1) AS voice, count(*) AS n FROM embeddings GROUP BY ALL")
def a27_voice_counts(spark, d):
    return A.voice_counts(table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 4 == 0, "val").otherwise("train").alias("split"), F.col("label").alias("voice")))


@query(
    """WITH s AS (SELECT l_linenumber AS setting, avg(l_tax - 0.04::DOUBLE) AS m, coalesce(stddev_samp(l_tax - 0.04::DOUBLE), 0) AS sd, count(*) AS n FROM lineitem WHERE l_partkey % 7 = 0 GROUP BY 1)
    SELECT setting, round(m, 6) AS mean, round(sd, 6) AS std, n, CASE WHEN m - sd <= 0 AND m + sd >= 0 THEN 'indistinguishable from zero' ELSE 'clear of zero' END AS verdict, setting = first_value(setting) OVER (ORDER BY m DESC, setting) AS best FROM s"""
)
def l8_sweep(spark, d):
    rows = table(spark, d, "lineitem").where("l_partkey % 7 = 0").select(F.col("l_linenumber").alias("setting"), (F.col("l_tax") - 0.04).alias("value"))
    return r6(picks.sweep(rows, "setting").select("setting", "mean", "std", "n", "verdict", "best"), "mean", "std")


@query(
    f"""WITH {SENT}, k AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(sentence), '[^a-z]', '', 'g') ORDER BY source, doc_id, pos) AS n FROM s),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS turn, dense_rank() OVER (ORDER BY source) AS g FROM k WHERE n = 1),
    c AS (SELECT source, count(*) AS n FROM (SELECT source, row_number() OVER (ORDER BY turn, g) AS rank FROM t QUALIFY rank <= 500) GROUP BY 1)
    SELECT d.source, CAST(sum(length(text)) AS BIGINT) AS chars, (SELECT count(*) FROM s WHERE s.source = d.source) AS sentences_found, (SELECT count(*) FROM t WHERE t.source = d.source) AS sentences_kept, (SELECT coalesce(max(n), 0) FROM c WHERE c.source = d.source) AS selected FROM documents d GROUP BY 1"""
)
def c1_provenance(spark, d):
    books = table(spark, d, "documents")
    return jobs.prompt_provenance(books, jobs.build_prompts(books, 500))


@query(
    """WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, length(text) / 15.0::DOUBLE AS s FROM documents), t AS (SELECT *, CASE WHEN i * 0.61803398875 - floor(i * 0.61803398875) < 0.3 THEN 'x' ELSE 'y' END AS teacher FROM p),
    b AS (SELECT teacher, count(*) AS n FROM t GROUP BY 1) SELECT count(*) AS n, round(sum(s) / 3600, 6) AS hours, 'x=0.3,y=0.7' AS mix, (SELECT string_agg(teacher || ':' || n || ':' || CASE teacher WHEN 'x' THEN 'mit' ELSE 'cc0' END, ',' ORDER BY teacher) FROM b) AS teachers FROM t"""
)
def c5_corpus_meta(spark, d):
    registry = spark.sql("SELECT * FROM VALUES ('x', 'mit', false), ('y', 'cc0', false) AS t(name, licence, restricted)")
    rows = table(spark, d, "documents").select("doc_id", "text")
    meta = jobs.scheduled_corpus(rows, [("x", 0.3), ("y", 0.7)], ["v0", "v1"], registry, F.length("text") / 15.0)[1]
    mix = F.array_join(F.transform(F.map_entries("mix"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    teachers = F.array_join(F.transform("teachers", lambda x: F.concat_ws(":", x["teacher"], x["n"].cast("string"), x["license"])), ",")
    return meta.select("n", F.round("hours", 6).alias("hours"), mix.alias("mix"), teachers.alias("teachers"))


@query(
    f"""WITH i AS (SELECT vec_id, vec_id AS id, label, 'v' || (label % 7) AS name, vec_id % 2 AS side, embedding FROM embeddings), f AS (SELECT id, side, name AS voice, CASE WHEN side = 0 THEN '0' ELSE '1' END AS source, dim, CAST(embedding[dim + 1] AS DOUBLE) AS value FROM i, range(64) r(dim)),
    k AS (SELECT voice FROM f GROUP BY 1 HAVING count(DISTINCT source) > 1), a AS (SELECT voice, source, dim, avg(value) AS m, greatest(stddev_samp(value), 1e-6) AS s FROM f SEMI JOIN k USING (voice) GROUP BY ALL),
    b AS (SELECT voice, dim, avg(value) AS m, greatest(stddev_samp(value), 1e-6) AS s FROM f GROUP BY ALL)
    SELECT id, side, f.voice, dim, round((value - coalesce(a.m, b.m)) / coalesce(a.s, b.s), 6) + 0 AS normed FROM f LEFT JOIN a USING (voice, source, dim) LEFT JOIN b USING (voice, dim)"""
)
def c11_expand_cache(spark, d):
    """Odd vectors merged into a cache of the even ones, whose voices have other numbers, then normalised."""
    rows = vectors(spark, d).withColumn("name", F.concat(F.lit("v"), F.col("label") % 7))
    sides = []
    for side in (0, 1):
        own = rows.where(F.col("vec_id") % 2 == side)
        voices = own.select("name").distinct().withColumn("voice", F.substring("name", 2, 9).cast("bigint") + 3 * side)
        items = own.join(voices, "name").select(F.col("vec_id").alias("id"), "voice", F.size("x").alias("width"), F.lit("").alias("tag"))
        long = own.select(F.col("vec_id").alias("id"), F.posexplode("x").alias("dim", "value"))
        sides.append((items, voices, long))
    (base, base_voices, base_frames), (extra, extra_voices, extra_frames) = sides
    items, normed, scale, widths = jobs.expand_cache(base, extra, base_voices, extra_voices, ("p", "p"), base_frames, extra_frames)
    return normed.select(F.col("utt").alias("id"), F.col("source").cast("bigint").alias("side"), "voice", "dim", (F.round("normed", 6) + F.lit(0.0)).alias("normed"))


@query(
    """WITH r AS (SELECT doc_id // 2 AS utt_id, text, lang, length(text) / 150.0::DOUBLE AS s FROM documents), t AS (SELECT text, count(*) AS n FROM r GROUP BY 1)
    SELECT (SELECT count(*) FROM r) AS records, (SELECT count(DISTINCT lang) FROM r) AS voices, (SELECT count(*) FROM t) AS distinct_texts, (SELECT count(*) FROM t WHERE n > 1) AS repeated_texts, (SELECT count(DISTINCT lower(trim(text, ' '))) FROM benchmark) AS held_out,
      (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS missing, round(sum(s) / 3600, 6) AS hours, round(quantile_cont(s, 0.5), 6) AS median, round(min(s), 6) AS min, round(max(s), 6) AS max, count(*) FILTER (s < 1 OR s > 30) AS out_of_range FROM r"""
)
def c12_validation_report(spark, d):
    """Files exist for two of three documents."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.floor(F.col("doc_id") / 2).alias("utt_id"), "text", F.col("lang").alias("voice"), F.lit(8000).alias("sample_rate"), (F.length("text") / 150.0).alias("duration_s"), F.col("lang").alias("license"), F.concat(F.lit("wav/"), F.col("doc_id").cast("string")).alias("wav_path"))
    files = docs.where("doc_id % 3 > 0").select(F.concat(F.lit("wav/"), F.col("doc_id").cast("string")).alias("path"))
    checks, summary = jobs.validation_report(rows, table(spark, d, "benchmark"), files)
    lost = checks.where("check = 'missing files'").select(F.col("bad").alias("missing"))
    return r6(summary.crossJoin(lost), "hours", "median", "min", "max")  # one row each


@query(
    """WITH b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings), p AS (SELECT v.vec_id, [(v.x[k] + b.x[k]) / 2 for k in range(1, 65)] AS s FROM b v JOIN b ON v.i = b.i + 5),
    u AS (SELECT vec_id AS utt_id, 'shared' AS kind, s FROM p UNION ALL SELECT vec_id, 'own', x FROM b)
    SELECT utt_id, kind, [round(list_sum(s[a[1] + 1:a[2]]) / (a[2] - a[1]), 6) + 0 for a in [[0, 10], [10, 11], [14, 64]]] AS target FROM u"""
)
def c13_shared_targets(spark, d):
    """Each vector with the one five places before, three tokens of 10, 0 (a frame at least) and 3 frames; what follows goes to the last."""
    rows = indexed(vectors(spark, d), "vec_id", "idx").select(F.col("vec_id").alias("utt_id"), "idx", F.array(F.lit(10), F.lit(0), F.lit(3)).alias("durations"), F.col("x").alias("series"))
    renditions, originals = jobs.shared_targets(rows, rows.select("utt_id", "idx", "series"), offset=5)
    return renditions.unionByName(originals).select("utt_id", "kind", rounded(F.col("target"), 6).alias("target"))


@query(
    """WITH i AS (SELECT doc_id, source, lang, row_number() OVER (ORDER BY doc_id) - 1 AS n, length(text) AS c FROM documents),
    t AS (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS k FROM documents GROUP BY 1), v AS (SELECT lang, row_number() OVER (ORDER BY min(doc_id), lang) - 1 AS k FROM documents GROUP BY 1),
    x AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS turn, count(*) OVER () AS m, [CAST(e AS DOUBLE) for e in embedding] AS x FROM embeddings)
    SELECT doc_id AS utt_id, t.k AS teacher_index, v.k AS voice_index, doc_id % 3 = 0 AS aligned, 64 AS frames, round(CASE WHEN source = 'src0' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS weight,
      CASE WHEN doc_id % 3 = 0 THEN [round(list_sum([abs(e) for e in x[k * 6 + 1:k * 6 + 6]]) / 6, 6) + 0 for k in range(10)] END AS energy, CASE WHEN doc_id % 3 = 0 THEN [round((x[k * 2 + 1] + x[k * 2 + 2]) / 2, 6) + 0 for k in range(30)] END AS latent
    FROM i JOIN t USING (source) JOIN v USING (lang) JOIN x ON turn = doc_id % m"""
)
def c10_build_cache(spark, d):
    """Ten characters of each document, every third one with an alignment, over vectors as series; read back from the files, of 100 items at most."""
    docs = table(spark, d, "documents")
    turns = indexed(vectors(spark, d).select("vec_id", "x"), "vec_id", "turn").select("turn", "x")
    n = F.broadcast(turns.agg(F.count("*").alias("n")))
    rows = docs.crossJoin(n).withColumn("turn", F.pmod("doc_id", "n")).join(turns, "turn")  # one row
    given = F.when(F.col("doc_id") % 3 == 0, F.array_repeat(F.lit(6), 10))
    rows = rows.select(F.col("doc_id").alias("utt_id"), F.rpad(F.lit(""), 10, "abcde").alias("text"), F.col("source").alias("teacher"), F.col("lang").alias("voice"), F.lit(None).cast("double").alias("mos"), F.transform("x", F.abs).alias("energy"), F.transform("x", lambda v: F.when(v > 0, v * 100).otherwise(F.lit(0.0))).alias("f0"), F.col("x").alias("latent"), given.alias("token_frames"))
    items, index, _, _ = jobs.build_cache(rows, spark.sql("SELECT 'src0' AS name, 0.5D AS weight"), scratch(spark), items=100)
    most = F.broadcast(index.agg(F.max("n").alias("most")))
    kept = items.crossJoin(most).where("most <= 100")  # one row
    total = F.aggregate("durations", F.lit(0), lambda a, x: a + x)
    measured = {"energy": rounded(F.col("token_energy"), 6), "latent": rounded(F.flatten("token_latent"), 6)}
    return kept.select("utt_id", "teacher_index", "voice_index", "aligned", F.when(F.col("aligned"), total + 4).otherwise(total).alias("frames"), F.round("weight", 6).alias("weight"), *[F.when(F.col("aligned"), x).alias(c) for c, x in measured.items()])


# --- whole results of scans, joins, reports and inverse functions --------------------------------------


@query("SELECT source, length(t) AS n, md5(t) AS print FROM (SELECT source, string_agg(coalesce(text, ''), '|' ORDER BY doc_id) AS t FROM documents GROUP BY 1)")
def s6_read_books(spark, d):
    """A file a source, with header and footer around its texts, read back whole."""
    folder = scratch(spark)
    each = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["t"]), "|")
    book = F.concat(F.lit(f"Title\n{S.BOOK_START} EBOOK ***\n"), body, F.lit(f"\n{S.BOOK_END} EBOOK ***\nLicence"))
    each.select("source", book.alias("value")).repartition("source").write.partitionBy("source").text(folder)
    out = S.read_books(spark, f"{folder}/*/*.txt").withColumn("text", F.trim(F.regexp_replace("text", r"^ EBOOK \*\*\*\n|\n$", "")))
    return out.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), F.length("text").cast("bigint").alias("n"), F.md5("text").alias("print"))


@query(
    f"""WITH {SIG}, p AS (SELECT user_id, x, unnest(range(len(x) * 2)) AS i FROM g WHERE len(x) >= 2), q AS (SELECT user_id, x, i, i * ((len(x) - 1)::DOUBLE / (len(x) * 2 - 1)) AS pos FROM p),
    f AS (SELECT *, least(floor(pos)::INT, len(x) - 1) AS low FROM q) SELECT user_id, list(round(x[low + 1] + (x[least(low + 2, len(x))] - x[low + 1]) * (pos - low), 6) + 0 ORDER BY i) AS y FROM f GROUP BY 1"""
)
def s8_resampled(spark, d):
    """Each user's signal at twice its rate, every sample."""
    rows = signals(spark, d).where(F.size("wav") >= 2)
    return rows.select("user_id", rounded(N.resample(F.col("wav"), 1, 2), 6).alias("y"))


@query(
    f"""WITH {LONG}, x AS (SELECT utt AS k, dim AS frame, value FROM f WHERE utt % 2 = 0), y AS (SELECT utt - 1 AS k, dim AS frame, value FROM f WHERE utt % 2 = 1),
    r AS (SELECT x.k, s.shift, corr(x.value, y.value) AS rho FROM x, (SELECT unnest(range(-3, 4)) AS shift) s JOIN y ON y.k = x.k AND y.frame = x.frame + s.shift GROUP BY ALL HAVING count(*) >= 20)
    SELECT k, arg_max(shift, rho) AS shift, round(max(rho), 6) AS rho FROM r GROUP BY k"""
)
def j15_shift_and_rho(spark, d):
    f = frames(spark, d).select("utt", F.col("dim").alias("frame"), "value")
    a = f.where("utt % 2 = 0").withColumnRenamed("utt", "k")
    b = f.where("utt % 2 = 1").select((F.col("utt") - 1).alias("k"), "frame", "value")
    return r6(J.best_shift(a, b, "k", 3).select("k", F.col("shift").cast("bigint").alias("shift"), "rho"), "rho")


@query("WITH l AS (SELECT user_id, row_number() OVER w AS frame, value AS x, lag(value) OVER w AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, frame, x, y FROM l WHERE y IS NOT NULL")
def j17_zipped_values(spark, d):
    """Each user's series against itself one place later, value by value."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    placed = indexed(table(spark, d, "events").select("user_id", at, "event_id", "value"), "at", "frame", ("user_id",), ("event_id",))
    rows = placed.select("user_id", (F.col("frame") + 1).alias("frame"), "value")
    return J.zip_min(rows, rows.withColumn("frame", F.col("frame") + 1), ["user_id", "frame"]).select("user_id", "frame", "x", "y")


@query(
    f"""WITH {SIG}, l AS (SELECT 20 * log10(greatest(list_max([abs(v) for v in x]), 1e-8)) AS p, 20 * log10(greatest(sqrt(list_sum([v * v for v in x]) / len(x)), 1e-8)) AS r, len(x) / 200.0::DOUBLE AS d FROM g),
    m AS (SELECT quantile_cont(r, 0.5) AS r, quantile_cont(p, 0.5) AS p, quantile_cont(p - r, 0.5) AS c, quantile_cont(d, 0.5) AS d, count(*) AS n FROM l)
    SELECT round(r, 6) AS rms_db, round(p, 6) AS peak_db, round(c, 6) AS crest_db, round(d, 6) AS duration_s, n, list_filter([CASE WHEN r < -40 THEN 'quiet' END, CASE WHEN p > -0.1 THEN 'clipped' END, CASE WHEN d < 0.5 THEN 'short' END], lambda x: x IS NOT NULL) AS failed FROM m"""
)
def a31_levels_and_checks(spark, d):
    rows = signals(spark, d).select(N.levels(F.col("wav")).alias("l"), (F.size("wav") / 200.0).alias("duration_s")).select("l.*", "duration_s")
    return r6(A.level_summary(rows).select("rms_db", "peak_db", "crest_db", "duration_s", "n", "failed"), "rms_db", "peak_db", "crest_db", "duration_s")


@query(
    """SELECT event_type AS metric, round(avg(value) FILTER (user_id % 3 <> 0 AND value >= 50), 6) AS mean, count(*) FILTER (user_id % 3 <> 0 AND value >= 50) AS n, list_sort(list(DISTINCT 'absent for ' || user_id % 6) FILTER (user_id % 3 = 0)) AS reasons FROM events GROUP BY 1"""
)
def a34_means_and_reasons(spark, d):
    """Values under 50 aren't numbers; users divisible by 3 have no measure, for two reasons."""
    ev = table(spark, d, "events")
    value = F.when(F.col("value") >= 50, F.col("value")).otherwise(F.lit(float("nan")))
    rows = ev.select(F.col("event_type").alias("metric"), value.alias("value"), (F.col("user_id") % 3 != 0).alias("available"), F.concat(F.lit("absent for "), (F.col("user_id") % 6).cast("string")).alias("reason"))
    return r6(A.metric_report(rows).select("metric", "mean", "n", "reasons"), "mean")


@query("SELECT o_orderkey, round(CASE WHEN f <= 60 THEN 0 ELSE 60 END * pow(2, least(greatest(log2(greatest(f, 60) / 60.0::DOUBLE) / log2(500 / 60.0::DOUBLE), 0), 1) * log2(500 / 60.0::DOUBLE)), 5) AS f0 FROM (SELECT o_orderkey, o_totalprice % 700 + 1 AS f FROM orders)")
def f39_pitch_round_trip(spark, d):
    """Pitch to the scale from 0 to 1 and back: itself within the range, the upper bound above, unvoiced (0) below."""
    f = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") % 700 + 1).alias("f"))
    return f.select("o_orderkey", F.round(N.normalized_to_f0(N.f0_to_normalized(F.col("f"))), 5).alias("f0"))


@query("SELECT vec_id AS utt, dim, round(CAST(embedding[dim + 1] AS DOUBLE), 5) AS value FROM embeddings, range(64) r(dim)")
def f46_round_trip(spark, d):
    """Normalised by the population's statistics and back."""
    f = frames(spark, d)
    rows = f.join(A.population_norm(f).drop("n"), "dim")
    back = N.denormalize(N.normalize(F.col("value"), F.col("mean"), F.col("var")), F.col("mean"), F.col("var"))
    return rows.select("utt", "dim", F.round(back, 5).alias("value"))


@query(
    """WITH w AS (SELECT a.vec_id, [CAST(x AS DOUBLE) for x in a.embedding] AS a, [CAST(x AS DOUBLE) for x in b.embedding] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(greatest(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) - 0.05, 0), 6) AS hinge FROM w"""
)
def f54_cosine_hinge(spark, d):
    v = vectors(spark, d)
    both = v.select("vec_id", "x").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return r6(both.select("vec_id", N.cosine_hinge(F.col("x"), F.col("y"), 0.05).alias("hinge")), "hinge")


@query(
    """WITH k AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    s AS (SELECT CAST(doc_id AS VARCHAR) AS i, doc_id || '|' || source || '|' || lang AS r FROM documents), h AS (SELECT hex(encode(i)) AS i, hex(encode(r)) AS r FROM s),
    c AS (SELECT xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(i), 2), lambda j: CAST('0x' || substr(i, j, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 64 AS s,
        xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(r), 2), lambda j: CAST('0x' || substr(r, j, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM h, k),
    g AS (SELECT s, CAST(sum(h) AS BIGINT) AS h, count(*) AS n FROM c GROUP BY 1) SELECT sha256('[' || string_agg('{"s":' || s || ',"h":' || h || ',"n":' || n || '}', ',' ORDER BY s) || ']') AS fingerprint, CAST(sum(n) AS BIGINT) AS items FROM g"""
)
def f23_cache_fingerprint(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("teacher"), F.col("lang").alias("voice"))
    return align.cache_provenance(rows).select("fingerprint", "items")


@query(
    """WITH t AS (SELECT conv_id, turn, [length(text), turn, 7][:1 + turn % 3] AS ids FROM conversations), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS w FROM t)
    SELECT conv_id, turn, list_concat(ids, [0 for k in range(w - len(ids))]) AS ids, [CASE WHEN k < len(ids) THEN 1 ELSE 0 END for k in range(w)] AS mask, CAST(w AS INT) AS width FROM m"""
)
def w19_pad_columns(spark, d):
    """Conversations as batches of turns of one to three numbers, with their masks."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.slice(F.array(F.length("text").cast("bigint"), F.col("turn").cast("bigint"), F.lit(7).cast("bigint")), F.lit(1), (F.col("turn") % 3 + 1).cast("int")).alias("ids"))
    out = W.pad_columns(rows, "conv_id", "turn", {"text": ["ids"]}, scalars=("turn",))
    each = out.select("conv_id", "text_width", F.explode(F.arrays_zip("turn", "ids", "text_mask")).alias("r"))
    return each.select("conv_id", "r.turn", "r.ids", F.col("r.text_mask").alias("mask"), F.col("text_width").alias("width"))
