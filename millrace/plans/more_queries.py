"""Further registered queries: reports, spans, signals and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import align, picks, sets, signal
from millrace.operators import filters as P
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.plans.adapters import frames, records, series, table, timed
from millrace.plans.queries import LONG, READINGS, RECORDS, SERIES, STEMS, WS, bootstrap_sql, docs, hashed_sql, query, r6, rounded
from millrace.sources import manifests as S

VEC = "w AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def signals(spark, d):
    """user_id, wav: each user's event values in order."""
    by = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    return by.select("user_id", F.transform("r", lambda x: x["value"] / 100).alias("wav"))


SIG = "g AS (SELECT user_id, list(value / 100 ORDER BY ts, event_id) AS x FROM events GROUP BY 1)"


@query(f"WITH {VEC} SELECT vec_id, [round(v / list_max([abs(y) for y in x]) * 0.6, 6) + 0 for v in x] AS y FROM w")
def f35_peak_normalised(spark, d):
    return vectors(spark, d).select("vec_id", rounded(N.normalize_peak(F.col("x")), 6).alias("y"))


@query(f"WITH {VEC}, e AS (SELECT vec_id, [list_sum([v * v for v in x[i * 8 + 1:i * 8 + 8]]) / 8 for i in range(8)] AS e FROM w) SELECT vec_id, round(len([v for v in e if v < list_max(e) * 0.1]) / len(e), 6) AS silence FROM e")
def f31_silence(spark, d):
    return r6(vectors(spark, d).select("vec_id", N.silence_ratio(F.col("x"), 10.0, 8).alias("silence")), "silence")


@query(
    """WITH l AS (SELECT l_suppkey, list(l_quantity ORDER BY l_orderkey, l_linenumber) AS x FROM lineitem GROUP BY 1),
    e AS (SELECT l_suppkey, list_sort([greatest(list_sum([v * v for v in x[i * 64 + 1:i * 64 + 64]]) / 64, 1e-12) for i in range(len(x) // 64)]) AS e FROM l),
    q AS (SELECT l_suppkey, e, (len(e) - 1) * 0.9::DOUBLE AS a, (len(e) - 1) * 0.1::DOUBLE AS b FROM e),
    s AS (SELECT l_suppkey, CASE WHEN len(e) >= 4 THEN 10 * log10((e[floor(a)::INT + 1] + (e[ceil(a)::INT + 1] - e[floor(a)::INT + 1]) * (a - floor(a))) / (e[floor(b)::INT + 1] + (e[ceil(b)::INT + 1] - e[floor(b)::INT + 1]) * (b - floor(b)))) END AS db FROM q)
    SELECT l_suppkey, round(CASE WHEN db >= 0.5 THEN db END, 5) AS db FROM s"""
)
def f33_snr(spark, d):
    """Each supplier's quantities as a signal with frames of 64."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("r"))
    return rows.select("l_suppkey", F.round(N.estimate_snr_db(F.transform("r", lambda x: x["l_quantity"]), 3200, 20.0, 0.5), 5).alias("db"))


@query(f"WITH {VEC} SELECT vec_id, [round(20 * log10(greatest(sqrt(list_sum([v * v for v in x[greatest(i * 8 - 8, 0) + 1:least(i * 8 + 8, 64)]]) / 16), 1e-8)), 5) + 0 for i in range(9)] AS db FROM w")
def f36_frame_energy(spark, d):
    return vectors(spark, d).select("vec_id", rounded(N.frame_energy_db(F.col("x"), 16, 8), 5).alias("db"))


@query("SELECT event_id, CASE WHEN value * 5 <= 0 THEN 0 ELSE 1 + CAST(round_even(least(greatest(log2(greatest(value * 5, 60) / 60) / log2(500.0 / 60), 0), 1) * 255, 0) AS INT) END AS bin FROM events")
def f39_pitch_bins(spark, d):
    return table(spark, d, "events").select("event_id", N.f0_to_bins(F.col("value") * 5).alias("bin"))


@query("SELECT l_orderkey, l_linenumber, round((ln(greatest(l_quantity, 1)) - 1.728) / 0.390, 6) AS z, CAST(l_quantity AS INT) AS back FROM lineitem")
def f40_duration_scale(spark, d):
    z = N.duration_to_normalized(F.col("l_quantity"))
    return r6(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z"), N.normalized_to_duration(z).alias("back")), "z")


@query(
    f"""WITH {VEC} SELECT vec_id, [round(list_sum(x[a[1] + 1:a[2]]) / (a[2] - a[1]), 6) + 0 for a in [[0, 4], [4, 5], [4, 16], [16, 25], [25, 45], [45, 52]]] AS means FROM w"""
)
def f41_span_means(spark, d):
    durations = F.array(*map(F.lit, [4, 0, 12, 9, 20, 7]))
    means = N.span_means(F.col("x"), N.token_spans(durations, F.size("x")))
    return vectors(spark, d).select("vec_id", rounded(means, 6).alias("means"))


@query(f"WITH {VEC} SELECT vec_id, [round(list_sum(x[a[1] + 1:a[2]]) / (a[2] - a[1]), 6) + 0 for a in [[0, 4], [4, 8], [8, 16], [16, 24], [24, 36], [36, 48], [48, 56], [56, 64]]] AS v FROM w")
def f42_token_vectors(spark, d):
    """Two vectors a token, of tokens of 8, 16, 24 and 16 frames."""
    v = align.token_vectors(F.col("x"), F.array(*map(F.lit, [8, 16, 24, 16])), 2)
    return vectors(spark, d).select("vec_id", rounded(F.flatten(v), 6).alias("v"))


@query(f"WITH {VEC} SELECT vec_id, [round(list_sum(x[a[1] + 1:a[2]]) / (a[2] - a[1]), 6) + 0 for a in [[0, 10], [10, 11], [15, 64]]] AS v FROM w")
def f43_span_average(spark, d):
    v = align.span_average(F.col("x"), F.array(F.lit(10), F.lit(0), F.lit(4)))
    return vectors(spark, d).select("vec_id", rounded(v, 6).alias("v"))


@query(f"WITH {VEC} SELECT vec_id, [CASE WHEN i < 60 THEN round(list_sum(x[i // 10 * 10 + 1:i // 10 * 10 + 10]) / 10, 6) + 0 ELSE round(x[i + 1], 6) + 0 END for i in range(64)] AS v FROM w")
def f44_at_rate(spark, d):
    v = align.at_rate(F.col("x"), F.array(F.lit(20), F.lit(20), F.lit(20)), 2)
    return vectors(spark, d).select("vec_id", rounded(v, 6).alias("v"))


@query("SELECT vec_id, vec_id % 40 AS start, 16 AS frames, list_sum([CASE WHEN (i + 1) * 8 < vec_id % 40 THEN 1 ELSE 0 END for i in range(8)])::INT AS first, list_sum([CASE WHEN (i + 1) * 8 < vec_id % 40 + 15 THEN 1 ELSE 0 END for i in range(8)])::INT + 1 AS last FROM embeddings")
def f47_crop(spark, d):
    c = align.crop_to_tokens(F.array(*[F.lit(8)] * 8), F.col("x"), (F.col("vec_id") % 40).cast("int"), F.lit(16))
    return vectors(spark, d).select("vec_id", c.alias("c")).select("vec_id", "c.*")


@query(
    """WITH w AS (SELECT a.vec_id, [CAST(x AS DOUBLE) for x in a.embedding] AS a, [CAST(x AS DOUBLE) for x in b.embedding] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_sum([(a[i] + b[i]) / 2 for i in range(1, 65)]), 6) AS shared, round(list_sum([abs(ln(greatest(a[i], 1e-5)) - ln(greatest(b[i], 1e-5))) for i in range(1, 65)]) / 64, 6) AS log_l1,
      round(list_sum([10 * log10(greatest(list_sum([v * v for v in a[k * 16 + 1:k * 16 + 16]]), 1e-10) / greatest(list_sum([(a[j] - b[j]) ^ 2 for j in range(k * 16 + 1, k * 16 + 17)]), 1e-10)) for k in range(4)]) / 4, 6) AS seg_snr FROM w"""
)
def f50_pair_metrics(spark, d):
    v = vectors(spark, d).select("vec_id", "x")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    return r6(both.select("vec_id", N.total(N.mean_series(x, y)).alias("shared"), N.log_mag_l1(x, y).alias("log_l1"), N.segmental_snr(x, y, 16).alias("seg_snr")), "shared", "log_l1", "seg_snr")


@query(
    """WITH w AS (SELECT a.vec_id, [CAST(x AS DOUBLE) for x in a.embedding] AS a, [CAST(x AS DOUBLE) for x in b.embedding] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    c AS (SELECT vec_id, [[list_sum([(a[t * 16 + j + 1] - b[t * 16 + j + 1]) * cos(pi() / 16 * (j + 0.5) * k) for j in range(16)]) * sqrt(2.0 / 16) for k in range(1, 13)] for t in range(4)] AS c FROM w)
    SELECT vec_id, round(list_sum([10 / ln(10) * sqrt(2 * list_sum([v * v for v in f])) for f in c]) / 4, 5) AS mcd FROM c"""
)
def f51_mcd(spark, d):
    v = vectors(spark, d).select("vec_id", N.fold(F.col("x"), 16).alias("a"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", F.round(N.mcd(F.col("a"), F.col("b")), 5).alias("mcd"))


@query(f"WITH {LONG}, s AS (SELECT dim, avg(value) AS m, var_pop(value) AS v FROM f GROUP BY 1) SELECT utt, dim, round((value - m) / sqrt(v + 1e-5), 5) AS z FROM f JOIN s USING (dim)")
def f46_normalised(spark, d):
    f = frames(spark, d)
    rows = f.join(A.population_norm(f).drop("n"), "dim")
    return rows.select("utt", "dim", F.round(N.normalize(F.col("value"), F.col("mean"), F.col("var")), 5).alias("z"))


#: Samples x of g(user_id, x) in frames of 32 around every 8th sample: fr(user_id, i, f); outside is silence, or (REFLECTED) the signal mirrored.
SILENT = "fr AS (SELECT user_id, i, [CASE WHEN i * 8 + j - 16 BETWEEN 0 AND len(x) - 1 THEN x[i * 8 + j - 15] ELSE 0.0 END for j in range(32)] AS f FROM (SELECT user_id, x, unnest(range(len(x) // 8 + 1)) AS i FROM g))"
REFLECTED = """gp AS (SELECT user_id, list_concat(x, [0.0::DOUBLE for k in range(greatest(0, 32 - len(x)))]) AS x FROM g),
    fr AS (SELECT user_id, i, [x[CASE WHEN abs(i * 8 + j - 16) < len(x) THEN abs(i * 8 + j - 16) ELSE 2 * (len(x) - 1) - (i * 8 + j - 16) END + 1] for j in range(32)] AS f FROM (SELECT user_id, x, unnest(range(len(x) // 8 + 1)) AS i FROM gp))"""
SPECTRUM = "sp AS (SELECT user_id, i, [list_sum([f[j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 32)) * cos(2 * pi() * j * k / 32) for j in range(32)]) ^ 2 + list_sum([f[j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 32)) * sin(2 * pi() * j * k / 32) for j in range(32)]) ^ 2 for k in range(17)] AS p FROM fr)"


@query(
    f"""WITH {SIG}, {REFLECTED}, {SPECTRUM}, c AS (SELECT user_id, [list_sum(p[:k]) / greatest(list_sum(p), 1e-12) for k in range(1, 18)] AS c FROM sp),
    h AS (SELECT user_id, list_min([k for k in range(17) if c[k + 1] >= 0.95]) * 750.0 AS a, list_min([k for k in range(17) if c[k + 1] >= 0.99]) * 750.0 AS b FROM c)
    SELECT user_id, round(avg(a), 3) AS rolloff95_hz, round(avg(b), 3) AS bandwidth99_hz FROM h GROUP BY 1"""
)
def f34_spectral(spark, d):
    """Each user's event values as a signal of 24 kHz, in frames of 32."""
    out = signal.with_spectral(signals(spark, d), n_fft=32)
    return out.select("user_id", F.round("rolloff95_hz", 3).alias("rolloff95_hz"), F.round("bandwidth99_hz", 3).alias("bandwidth99_hz"))


#: Six triangles on the mel scale over 17 bins of 0 to 12 kHz.
TRIANGLES = """ed AS (SELECT [700 * (10 ^ (2595 * log10(1 + 12000 / 700.0) * m / 7 / 2595) - 1) for m in range(8)] AS e),
    tr AS (SELECT [[greatest(0, least((k * 750.0 - e[b]) / (e[b + 1] - e[b]), (e[b + 2] - k * 750.0) / (e[b + 2] - e[b + 1]))) * 2 / (e[b + 2] - e[b]) for k in range(17)] for b in range(1, 7)] AS t FROM ed)"""


@query(
    f"""WITH {SIG}, {REFLECTED}, {SPECTRUM}, {TRIANGLES}, m AS (SELECT user_id, i, [ln(greatest(list_sum([sqrt(p[k]) * t[b][k] for k in range(1, 18)]), 1e-5)) for b in range(1, 7)] AS m FROM sp, tr)
    SELECT user_id, i AS frame, [round(v, 4) + 0 for v in m] AS bands FROM m"""
)
def f37_log_mel(spark, d):
    """Each user's event values as a signal of 24 kHz, in frames of 32 and six bands."""
    out = signal.with_log_mel(signals(spark, d), n_fft=32, hop=8, bands=6)
    return out.select("user_id", F.posexplode("log_mel").alias("frame", "m")).select("user_id", F.col("frame").cast("bigint").alias("frame"), rounded(F.col("m"), 4).alias("bands"))


#: Pitch by YIN of frames of 32 at 800 Hz from 60 to 200 Hz, threshold 0.8: lags 4 to 13.
YIN = """ce AS (SELECT user_id, i, [v - list_avg(f) for v in f] AS f FROM fr),
    di AS (SELECT user_id, i, [list_sum([CASE WHEN j + t < 32 THEN (f[j + 1] - f[j + t + 1]) ^ 2 ELSE 0.0 END for j in range(32)]) for t in range(15)] AS d, list_sum([v * v for v in f]) AS en FROM ce),
    cm AS (SELECT user_id, i, d, en, [CASE WHEN t = 0 THEN 1.0 ELSE d[t + 1] / greatest(list_sum(d[:t + 1]) / t, 1e-9) END for t in range(15)] AS c FROM di),
    lo AS (SELECT *, list_min([t for t in range(4, 14) if (t = 4 OR c[t + 1] <= c[t]) AND (t = 13 OR c[t + 1] <= c[t + 2]) AND c[t + 1] < 0.8 AND en > 1e-8]) AS first FROM cm),
    ta AS (SELECT *, least(greatest(first, 5), 12) AS a FROM lo),
    pi AS (SELECT user_id, i, first, 800.0 / greatest(a + least(greatest(0.5 * (d[a] - d[a + 2]) / greatest(abs(d[a] - 2 * d[a + 1] + d[a + 2]), 1e-12), -1), 1), 1) AS p FROM ta),
    f0 AS (SELECT user_id, i, CASE WHEN first IS NOT NULL AND p BETWEEN 60 AND 200 THEN p ELSE 0.0 END AS f FROM pi)"""


@query(f"WITH {SIG}, {SILENT}, {YIN} SELECT user_id, list(round(f, 3) ORDER BY i) AS f0 FROM f0 GROUP BY 1")
def f38_pitch(spark, d):
    """Event values as a signal of 800 Hz, in frames of 32."""
    out = signal.with_f0(signals(spark, d), sr=800, hop=8, frame=32, low=60, high=200, threshold=0.8)
    return out.select("user_id", rounded(F.col("f0"), 3).alias("f0"))


@query(
    f"""WITH {SIG}, {SILENT}, ce AS (SELECT user_id, i, [(f[j + 1] - list_avg(f)) * (0.5 - 0.5 * cos(2 * pi() * j / 32)) for j in range(32)] AS f FROM fr),
    ac AS (SELECT user_id, i, [list_sum([CASE WHEN j + t < 32 THEN f[j + 1] * f[j + t + 1] ELSE 0.0 END for j in range(32)]) / greatest(list_sum([v * v for v in f]), 1e-8) for t in range(15)] AS r FROM ce),
    ta AS (SELECT *, list_max(r[5:13]) AS b, list_position(r, list_max(r[5:13])) - 1 AS a FROM ac),
    pi AS (SELECT user_id, i, b, 800.0 / greatest(a + least(greatest(0.5 * (r[a] - r[a + 2]) / greatest(abs(r[a] - 2 * r[a + 1] + r[a + 2]), 1e-8), -0.5), 0.5), 1) AS p FROM ta)
    SELECT user_id, list(round(CASE WHEN b > 0.3 AND p BETWEEN 60 AND 200 THEN p ELSE 0.0 END, 3) ORDER BY i) AS f0 FROM pi GROUP BY 1"""
)
def f38_pitch_autocorrelation(spark, d):
    out = signal.with_f0(signals(spark, d), sr=800, hop=8, frame=32, low=60, high=200, method="autocorr")
    return out.select("user_id", rounded(F.col("f0"), 3).alias("f0"))


@query("SELECT conv_id, turn, text AS said FROM conversations WHERE length(text) BETWEEN 25 AND 220 AND text NOT IN (SELECT text FROM conversations WHERE turn = 0)")
def p9_turn_window(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("said"))
    return P.turn_window(rows, rows.where("turn = 0")).select("conv_id", "turn", "said")


#: Spoken turns said(play, turn, speaker, said) of the conversations written as plays, a line for the role before each text.
TURNS = r"""li AS (SELECT conv_id AS play, turn * 100000 + generate_subscripts(x, 1) AS n, trim(unnest(x), ' ') AS line FROM (SELECT conv_id, turn, string_split(replace(upper(role) || '.' || chr(10) || text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM conversations)),
    sp AS (SELECT *, regexp_matches(line, '^([A-Z][A-Z0-9 .''\-]{1,30})\.\s*$') AS spoke FROM li WHERE line <> ''),
    tn AS (SELECT *, sum(spoke::INT) OVER (PARTITION BY play ORDER BY n) AS turn FROM sp),
    said AS (SELECT play, turn, max(CASE WHEN spoke THEN regexp_extract(line, '^([A-Z][A-Z0-9 .''\-]{1,30})\.\s*$', 1) END) AS speaker,
      trim(regexp_replace(string_agg(line, ' ' ORDER BY n) FILTER (NOT spoke AND NOT regexp_matches(line, '^[\[(].*[\])]\s*$') AND NOT regexp_matches(line, '(?i)gutenberg|copyright|licence|license|transcriber|www\.|http|^\s*(act|scene)\b|dramatis personae')), '\s+', ' ', 'g')) AS said
      FROM tn WHERE turn > 0 GROUP BY play, turn)"""


def plays(spark, d):
    """Conversations written as plays."""
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat(F.upper("role"), F.lit(".\n"), "text").alias("t")).alias("t"))
    return rows.groupBy(F.col("conv_id").alias("play")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["t"]), "\n").alias("text"))


@query(f"WITH {TURNS} SELECT * FROM said WHERE said <> ''")
def p8_turns_from_play(spark, d):
    return P.turns_from_play(plays(spark, d))


@query(f"WITH {TURNS}, k AS (SELECT *, sum(length(said)) OVER (PARTITION BY play ORDER BY turn) AS upto FROM said WHERE said <> '' AND length(said) BETWEEN 25 AND 220) SELECT play, turn, speaker, said FROM k WHERE upto <= 300")
def c4_dialogue_prompts(spark, d):
    from millrace.plans.jobs import dialogue_prompts

    return dialogue_prompts(plays(spark, d), None, 300)


@query("WITH w AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value - 20 AS e, event_type AS w FROM events) SELECT event_id FROM w WHERE e > s AND w <> ''")
def p13_clean_words(spark, d):
    rows = timed(spark, d).withColumn("end", F.col("start") + F.col("value") - 20)
    return P.clean_words(rows).select("event_id")


@query("SELECT l_partkey % 40 AS dim, count(*) AS n FROM lineitem GROUP BY 1 HAVING stddev_samp(l_tax) >= 0.025")
def p14_varied_dims(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("dim"), "l_tax")
    return P.varied_dims(rows, "dim", "l_tax", 0.025).groupBy("dim").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT count(*) FILTER (teacher = 'src0' AND suffix(text, '.')) AS taken, count(*) FILTER (teacher <> 'src0') AS other_teacher, count(*) FILTER (teacher = 'src0' AND NOT suffix(text, '.')) AS without_variant FROM r")
def p12_only_teacher(spark, d):
    return P.only_teacher(records(spark, d), "src0", F.when(F.col("text").endswith("."), F.array(F.lit("v"))).otherwise(F.array().cast("array<string>")))[1]


@query("WITH u AS (SELECT user_id, list(struct_pack(w := event_type, s := epoch_us(ts) / 1e6) ORDER BY ts, event_id) AS l FROM events GROUP BY 1) SELECT user_id, array_to_string([l[i].w || CASE WHEN i < len(l) AND (l[i + 1].s - l[i].s) * 1000 >= 7200000 THEN ',' ELSE '' END for i in range(1, len(l) + 1)], ' ') AS text FROM u")
def w6_punctuate(spark, d):
    """A comma where two hours pass."""
    words = timed(spark, d).select(F.col("key").alias("user_id"), "start", F.col("start").alias("end"), "event_id", "word")
    tokens = W.punctuated(words, "user_id", ("start", "event_id"), 7_200_000.0)
    return tokens.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "event_id", "token"))), lambda x: x["token"]), " ").alias("text"))


@query(
    f"""WITH {VEC}, z AS (SELECT vec_id, [CASE WHEN abs(v) < 0.15 THEN 0.0 ELSE v END for v in x] AS z FROM w), k AS (SELECT vec_id, z, [i for i in range(1, len(z) + 1) if z[i] <> 0] AS hit FROM z)
    SELECT vec_id, [CASE WHEN z[i] <> 0 OR len(hit) = 0 THEN z[i] ELSE z[list_sort([[abs(j - i), j] for j in hit])[1][2]] END for i in range(1, len(z) + 1)] AS y FROM k"""
)
def w11_fill_nearest(spark, d):
    """Small components are filled from their neighbours."""
    return vectors(spark, d).select("vec_id", N.fill_nearest(F.transform("x", lambda v: F.when(F.abs(v) < 0.15, 0.0).otherwise(v))).alias("y"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(round_even(l_quantity * 93.75 / count(*) OVER (PARTITION BY l_orderkey, l_returnflag), 0), 1) AS INT) AS frames FROM lineitem")
def w13_char_frames(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return W.char_frames(rows, "l_orderkey", "l_returnflag", "l_quantity").select("l_orderkey", "l_linenumber", "frames")


@query("SELECT doc_id, ['a', 'b', 'c'][doc_id % 3 + 1] AS pick FROM documents")
def w22_pick_variant(spark, d):
    return docs(spark, d).select("doc_id", W.pick_variant(F.col("doc_id"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("pick"))


@query(f"SELECT conv_id, turn, coalesce(({READINGS})[1], text) AS variant, len({READINGS}) = 0 AS reused FROM {STEMS} JOIN conversations USING (conv_id, turn)")
def f16_aligned_variants(spark, d):
    return align.aligned_variants(table(spark, d, "conversations")).select("conv_id", "turn", "variant", "reused")


@query(
    rf"""WITH d AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS nth FROM (SELECT doc_id, {WS.format("lower(text)")} AS x FROM documents)),
    s AS (SELECT DISTINCT w, [CASE WHEN instr('əɪʊɛæɑɔʌɜɐᵻiueoaɚɝ', c) > 0 THEN 2.0::DOUBLE WHEN instr('ˈˌː', c) > 0 THEN 0.0 ELSE 1.0 END for c in string_split(w, '')] AS ws FROM d),
    r AS (SELECT w, ws, [greatest(CAST(round_even(length(w) * 3 * CASE WHEN list_sum(ws) > 0 THEN x / list_sum(ws) ELSE 1.0::DOUBLE / len(ws) END, 0) AS INT), 1) for x in ws] AS f FROM s),
    p AS (SELECT w, [CASE WHEN i = list_position(f, list_max(f)) THEN CAST(greatest(f[i] + length(w) * 3 - list_sum(f), 1) AS INT) ELSE f[i] END for i in range(1, len(f) + 1)] AS f FROM r)
    SELECT doc_id, list(f ORDER BY nth) AS frames FROM d JOIN p USING (w) GROUP BY 1"""
)
def f22_phoneme_frames(spark, d):
    """A word's letters stand for its phonemes."""
    words = docs(spark, d).select("doc_id", T.words(F.lower("text")).alias("w"))
    return words.select("doc_id", align.phoneme_frames_each(F.transform("w", lambda w: F.length(w) * 3), F.col("w")).alias("frames"))


@query("SELECT count(*) AS items, list_sort(list(DISTINCT source)) AS teachers, list_sort(list(DISTINCT lang)) AS voices FROM documents")
def f23_provenance(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("teacher"), F.col("lang").alias("voice"))
    return align.cache_provenance(rows).select("items", "teachers", "voices")


@query("WITH m AS (SELECT doc_id, len(string_split(text, ' ')) AS n, length(text) AS c, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT count(*) AS n, count(*) AS aligned, round(quantile_cont(abs(n * 2.0 - c) / c, 0.5), 6) AS median_error, round(quantile_cont(abs(n * 2.0 - c) / c, 0.9), 6) AS p90_error, round(avg(quality), 6) AS mos_mean FROM m")
def a25_alignment_evidence(spark, d):
    rows = records(spark, d).select("text", F.transform(F.split("text", " "), lambda w: F.lit(2)).alias("token_frames"), (F.length("text") * 256 / 24000.0).alias("duration_s"), "mos")
    return r6(A.alignment_evidence(rows).select("n", "aligned", "median_error", "p90_error", "mos_mean"), "median_error", "p90_error", "mos_mean")


@query(
    """WITH w AS (SELECT a.vec_id, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id AS utt, round(corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)), 6) AS r FROM w GROUP BY 1"""
)
def a26_alignment_value(spark, d):
    v = vectors(spark, d).select("vec_id", "x")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return r6(A.alignment_value(both.select(F.col("vec_id").alias("utt"), F.col("x").alias("aligned"), F.col("y").alias("fallback"))).select("utt", "r"), "r")


@query("SELECT l_returnflag AS split, round(avg(abs(l_quantity - l_linenumber)), 6) AS duration_mae, round(sum(l_linenumber) / sum(l_quantity), 6) AS length_ratio, round(avg(abs(l_tax - l_discount)), 6) AS f0_mae, count(*) AS tokens FROM lineitem GROUP BY 1")
def a27_fit_diagnosis(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("split"), F.col("l_quantity").alias("true_dur"), F.col("l_linenumber").alias("pred_dur"), F.col("l_tax").alias("true_f0"), F.col("l_discount").alias("pred_f0"), F.col("l_tax").alias("true_energy"), F.col("l_tax").alias("pred_energy"))
    return r6(A.fit_diagnosis(rows).select("split", "duration_mae", "length_ratio", "f0_mae", "tokens"), "duration_mae", "length_ratio", "f0_mae")


@query(
    f"""WITH {VEC}, l AS (SELECT 20 * log10(greatest(list_max([abs(v) for v in x]), 1e-8)) AS p, 20 * log10(greatest(sqrt(list_sum([v * v for v in x]) / len(x)), 1e-8)) AS r, len(x) / 64.0 AS d FROM w)
    SELECT round(quantile_cont(r, 0.5), 6) AS rms_db, round(quantile_cont(p, 0.5), 6) AS peak_db, round(quantile_cont(p - r, 0.5), 6) AS crest_db, count(*) AS n FROM l"""
)
def a31_level_summary(spark, d):
    rows = vectors(spark, d).select(N.levels(F.col("x")).alias("l"), (F.size("x") / 64.0).alias("duration_s")).select("l.*", "duration_s")
    return r6(A.level_summary(rows).select("rms_db", "peak_db", "crest_db", "n"), "rms_db", "peak_db", "crest_db")


@query(
    f"""WITH {LONG}, s AS (SELECT x.utt AS a, y.utt AS b, corr(x.value, y.value) AS rho FROM f x JOIN f y ON x.voice = y.voice AND x.utt < y.utt AND x.dim = y.dim GROUP BY ALL),
    h AS (SELECT vec_id, row_number() OVER (ORDER BY {hashed_sql(0, 'vec_id')}, vec_id) - 1 AS i FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON b.i = a.i + 1 WHERE a.i % 2 = 0),
    c AS (SELECT p.a, corr(x.value, y.value) AS rho FROM p JOIN f x ON x.utt = p.a JOIN f y ON y.utt = p.b AND y.dim = x.dim GROUP BY ALL),
    r AS (SELECT 'same' AS class, rho FROM s UNION ALL SELECT 'control', rho FROM c) SELECT class, round(avg(rho), 6) AS mean, count(*) AS n, round(min(rho), 6) AS min, round(max(rho), 6) AS max FROM r GROUP BY 1"""
)
def a32_agreement(spark, d):
    """All pairs of vectors of one label, and disjoint pairs in hash order."""
    e = table(spark, d, "embeddings")
    v = vectors(spark, d).select("vec_id", F.posexplode("x").alias("dim", "v"))
    pairs = J.control_pairs(e, "vec_id", n=None).join(v.select(F.col("vec_id").alias("a"), "dim", F.col("v").alias("x")), "a").join(v.select(F.col("vec_id").alias("b"), "dim", F.col("v").alias("y")), ["b", "dim"])
    control = A.agreement_report(pairs.groupBy("pair").agg(F.corr("x", "y").alias("rho")).limit(0), pairs.groupBy("pair").agg(F.corr("x", "y").alias("rho")))
    return r6(A.pair_agreement(e, "label", "vec_id", "embedding").unionByName(control), "mean", "min", "max")


@query(
    f"""WITH {SERIES}, c AS (SELECT a.utt, a.dim, corr(a.value, b.value) AS r FROM z a JOIN z b ON b.utt = a.utt + 1 AND a.dim = b.dim AND a.frame = b.frame GROUP BY ALL HAVING stddev_samp(a.value) >= 1e-6 AND stddev_samp(b.value) >= 1e-6),
    p AS (SELECT 0 AS g, utt AS k, avg(r) AS v FROM c GROUP BY utt), {bootstrap_sql('p', 2000)}
    SELECT round(avg(v), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, round(sqrt(greatest(avg(v), 0)), 6) AS ceiling, 0.0 AS median_shift, 0.0 AS length_mismatch, count(*) AS pairs,
      CASE WHEN any_value(low) >= 0.6 THEN 'reliable' WHEN any_value(high) < 0.6 THEN 'unreliable' ELSE 'undecided' END AS verdict FROM p JOIN ci USING (g)"""
)
def a33_reliability(spark, d):
    f = series(spark, d)
    other = f.select((F.col("utt") - 1).alias("utt"), "dim", "frame", "value")
    rho = A.per_dim_rho(J.zip_min(f, other, ["utt", "dim", "frame"]), ["utt"])
    pairs = rho.select(F.col("utt").alias("pair"), "rho", F.lit(0).alias("shift"), F.lit(64).alias("n_a"), F.lit(64).alias("n_b"))
    return r6(A.reliability_report(pairs), "mean", "low", "high", "ceiling", "median_shift", "length_mismatch")


@query("SELECT event_type AS metric, round(avg(value) FILTER (user_id % 3 <> 0), 6) AS mean, count(*) FILTER (user_id % 3 <> 0) AS n FROM events GROUP BY 1")
def a34_metric_report(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("metric"), "value", (F.col("user_id") % 3 != 0).alias("available"), F.lit("absent").alias("reason"))
    return r6(A.metric_report(rows).select("metric", "mean", "n"), "mean")


@query("WITH v AS (SELECT user_id AS k, avg(value) AS value FROM events GROUP BY 1), c AS (SELECT user_id AS k, min(value) AS c FROM events WHERE event_type = 'click' GROUP BY 1) SELECT k, round(CASE WHEN c < 5 THEN value END, 6) AS value, round(c, 6) AS control FROM v LEFT JOIN c USING (k)")
def a35_control_gated(spark, d):
    ev = table(spark, d, "events").withColumn("k", F.col("user_id"))
    value = ev.groupBy("k").agg(F.avg("value").alias("value"))
    control = ev.where("event_type = 'click'").groupBy("k").agg(F.min("value").alias("value"))
    return r6(A.control_gated(value, control, "k", 5.0).select("k", "value", "control"), "value", "control")


@query(f"WITH {RECORDS} SELECT round(sum(duration_s) / 3600, 6) AS hours FROM r")
def a39_hours(spark, d):
    return r6(A.corpus_hours(records(spark, d)), "hours")


@query(
    """WITH g AS (SELECT user_id, list(CASE WHEN event_type = 'click' THEN 0 ELSE value * 4 END ORDER BY ts, event_id) AS f FROM events GROUP BY 1),
    m AS (SELECT len([x for x in f if x > 0]) / len(f) AS s, len([x for x in f if x > 100]) / len(f) AS o, list_median([x for x in f if x > 0]) AS m FROM g)
    SELECT round(avg(s), 6) AS voiced, round(avg(o), 6) AS voiced_strict, round(avg(m), 6) AS mean_f0, round(quantile_cont(m, 0.5), 6) AS median_f0, count(*) AS n FROM m"""
)
def a40_pitch_summary(spark, d):
    """Event values as pitch; a second tracker hears nothing under 100 Hz."""
    by = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.when(F.col("event_type") == "click", 0.0).otherwise(F.col("value") * 4).alias("f")))).alias("r"))
    rows = by.select(F.transform("r", lambda x: x["f"]).alias("f0"), F.transform("r", lambda x: F.when(x["f"] > 100, x["f"]).otherwise(0.0)).alias("strict"))
    return r6(A.pitch_summary(rows, others=("strict",)).select("voiced", "voiced_strict", "mean_f0", "median_f0", "n"), "voiced", "voiced_strict", "mean_f0", "median_f0")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem) ORDER BY l_orderkey LIMIT 1")
def l3_select_row(spark, d):
    return picks.select_row(table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), "l_extendedprice", order="l_orderkey")


@query("SELECT c_custkey, c_name, CAST(regexp_extract(c_name, '(\\d+)[^\\d]*$', 1) AS BIGINT) AS step FROM customer ORDER BY step DESC, c_name LIMIT 25")
def l7_order_by_step(spark, d):
    return picks.order_by_step(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", 25)


@query("SELECT conv_id, turn, regexp_replace(trim(text, ' '), '\\.$', '!') AS variant FROM conversations WHERE suffix(trim(text, ' '), '.') ORDER BY conv_id * 1000 + turn LIMIT 50")
def l6_first_variant(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("o")).where(F.trim("text").endswith("."))
    return picks.first_variant(rows, T.variants(F.col("text")), 50, "o").select("conv_id", "turn", "variant")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN '0' ELSE '1' END AS tag, label AS name FROM embeddings")
def u2_merge_caches(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("voice"), F.size("embedding").alias("width"), F.lit("").alias("tag"))
    names = items.select("voice", F.col("voice").cast("string").alias("name")).distinct()
    merged = sets.merge_caches(items.where("id % 2 = 0"), items.where("id % 2 = 1"), names, names, "f", "f")
    return merged.select("id", "tag", F.col("name").cast("int").alias("name"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def u3_assert_disjoint(spark, d):
    rows = docs(spark, d).select("doc_id", "source", "lang")
    return sets.assert_disjoint(rows.where("lang = 'en'"), rows.where("lang <> 'en'"), "lang").select("doc_id", "source")


@query(f"WITH {RECORDS} SELECT count(*) AS n, round(sum(duration_s) / 3600, 6) AS hours FROM r")
def s5_corpus_meta(spark, d):
    rows = records(spark, d)
    mix = A.effective_mix(rows).select(F.col("teacher").alias("name"), "weight")
    return r6(S.corpus_meta(rows, mix).select("n", "hours"), "hours")


@query("SELECT 's' || (doc_id % 3) || '_' || doc_id AS utt_id, 'shard' || (doc_id % 3) || '/' || source AS wav_path FROM documents")
def s11_merge_shards(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("utt_id"), F.col("source").alias("wav_path"))
    return S.merge_shards([rows.where(F.col("doc_id") % 3 == i) for i in range(3)]).select("utt_id", "wav_path")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 6 AS shard FROM documents")
def s12_shard_prompts(spark, d):
    return S.shard_prompts(docs(spark, d).select("doc_id"), "doc_id", 6)


@query("SELECT page_id, length(split_part(html, '<body', 1)) AS n FROM pages")
def s6_strip_markers(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.strip_markers(F.col("html"), "no such marker", "<body")).cast("bigint").alias("n"))


@query(f"WITH {SIG} SELECT user_id, len(x) * 2 AS n, round(x[1], 6) AS first, round(x[-1], 6) AS last FROM g WHERE len(x) >= 2")
def s8_resample(spark, d):
    y = N.resample(F.col("wav"), 1, 2)
    rows = signals(spark, d).where(F.size("wav") >= 2).select("user_id", y.alias("y"))
    return r6(rows.select("user_id", F.size("y").cast("bigint").alias("n"), F.element_at("y", 1).alias("first"), F.element_at("y", -1).alias("last")), "first", "last")


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, printf('%08d', i) AS utt_id, CASE WHEN i * 0.61803398875 - floor(i * 0.61803398875) < 0.3 THEN 'x' ELSE 'y' END AS teacher, ['v0', 'v1', 'v2'][i % 3 + 1] AS voice FROM p")
def c5_schedule(spark, d):
    from millrace.plans.jobs import schedule_corpus

    registry = spark.sql("SELECT * FROM VALUES ('x', 'mit', false), ('y', 'mit', false) AS t(name, licence, restricted)")
    return schedule_corpus(docs(spark, d).select("doc_id", "text"), [("x", 0.3), ("y", 0.7)], ["v0", "v1", "v2"], registry).select("doc_id", "utt_id", "teacher", "voice")


@query()
def c6_curate(spark, d):
    """Event values as signals of 8 kHz."""
    from millrace.plans.jobs import curate

    rows, _, _ = curate(signals(spark, d), P.CurateConfig(min_duration_s=0.005), 8000)
    return rows.select("user_id", "keep", "reasons")


@query("WITH l AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(before) AS n FROM l GROUP BY 1")
def j17_zip_min(spark, d):
    """Each user's series against itself one place later: one frame less."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("frame"), "value")
    return J.zip_min(rows, rows.withColumn("frame", F.col("frame") + 1), ["user_id", "frame"]).groupBy("user_id").agg(F.count("*").alias("n"))
