"""Registered queries of sources, sinks, jobs and streams over the given tables, each with SQL for the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import tables
from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import align, neartext, picks
from millrace.operators import filters as P
from millrace.operators import windows as W
from millrace.operators.order import indexed, quantiles
from millrace.plans import jobs
from millrace.plans.adapters import frames, records, scratch, table, timed
from millrace.plans.more_queries import VEC, vectors
from millrace.plans.queries import FALLBACK, HOURS, LONG, LONG_SPLIT, RECORDS, STRETCHES, docs, hashed_sql, hours, negatives_sql, query, r6, rounded, segments_sql
from millrace.sources import manifests as S
from millrace.streaming import streams

# --- sources and sinks (S) --------------------------------------------------------------------------

MANIFEST_SQL = "SELECT CAST(doc_id AS VARCHAR) AS utt_id, text, source AS teacher, lang AS voice, round(length(text) / 15.0, 4) AS duration_s FROM documents"


def written(spark, d, name):
    """A folder with the documents as a manifest of JSON lines."""
    folder = scratch(spark)
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("utt_id"), "text", F.col("source").alias("teacher"), F.col("lang").alias("voice"), F.round(F.length("text") / 15.0, 4).alias("duration_s"))
    rows.write.json(f"{folder}/{name}")
    return folder


@query(MANIFEST_SQL)
def s1_read_manifest(spark, d):
    return S.read_manifest(spark, f"{written(spark, d, 'manifest.jsonl')}/manifest.jsonl").select("utt_id", "text", "teacher", "voice", "duration_s")


@query(f"WITH m AS ({MANIFEST_SQL}) SELECT utt_id, voice, 'curated/kept.jsonl' AS found FROM m")
def s2_resolve_manifest(spark, d):
    folder = written(spark, d, "curated/kept.jsonl")
    path = S.resolve_manifest(spark, folder)
    return S.read_manifest(spark, path).select("utt_id", "voice", F.lit(path.removeprefix(f"{folder}/")).alias("found"))


@query(f"WITH {RECORDS} SELECT doc_id, duration_s BETWEEN 3 AND 30 AND coalesce(mos >= 0.5, true) AS keep, (SELECT count(*) FILTER (duration_s BETWEEN 3 AND 30 AND coalesce(mos >= 0.5, true)) FROM r) AS n_kept FROM r")
def s3_write_curation(spark, d):
    folder = scratch(spark)
    rows = P.apply_gates(records(spark, d), P.CurateConfig(min_mos=0.5)).select("doc_id", "keep", "duration_s", "reasons")
    S.write_curation(rows, folder, A.curation_report(rows))
    report = spark.read.json(f"{folder}/report").select("n_kept")
    return spark.read.parquet(f"{folder}/records").select("doc_id", F.col("keep").cast("boolean").alias("keep")).crossJoin(F.broadcast(report))  # one row


@query("SELECT doc_id, md5(text) AS print, true AS listed FROM documents")
def s4_write_shards(spark, d):
    """Every row comes back from a file of the index, which has at most 100."""
    folder = scratch(spark)
    index = S.write_shards(docs(spark, d).select("doc_id", "text"), folder, 100)
    rows = spark.read.parquet(folder).select("doc_id", F.md5("text").alias("print"), F.col("_metadata.file_path").alias("path"))
    return rows.join(index, "path", "left").select("doc_id", "print", F.coalesce(F.col("n") <= 100, F.lit(False)).alias("listed"))


@query("WITH v AS (SELECT o_custkey, list(CAST(o_totalprice * 100 AS BIGINT) % 30000 ORDER BY o_orderkey) AS x FROM orders GROUP BY 1) SELECT o_custkey, 16000 AS sample_rate, [round(v / 32768, 6) + 0 for v in x] AS wav FROM v")
def s7_decode_waves(spark, d):
    """Each customer's orders as the bytes of a WAV file."""
    little = lambda x, size: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(x), 2 * size, "0"), F.lit("(..)"), 1)), "")
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("bigint") % 30000).alias("v")))).alias("r"))
    data = F.array_join(F.transform("r", lambda x: little(x["v"], 2)), "")
    head = [F.lit(b"RIFF".hex()), little(36 + F.size("r") * 2, 4), F.lit((b"WAVE" + b"fmt ").hex()), *(little(F.lit(v), n) for v, n in ((16, 4), (1, 2), (1, 2), (16000, 4), (32000, 4), (2, 2), (16, 2))), F.lit(b"data".hex()), little(F.size("r") * 2, 4)]
    files = by.select(F.col("o_custkey").cast("string").alias("path"), F.unhex(F.concat(*head, data)).alias("content"))
    out = S.decode_waves(files)
    return out.select(F.col("path").cast("bigint").alias("o_custkey"), "sample_rate", rounded(F.col("wav").cast("array<double>"), 6).alias("wav"))


@query("SELECT vec_id AS idx, text, ['a', 'b', 'c'][vec_id % 3 + 1] AS voice FROM embeddings JOIN documents ON doc_id = vec_id")
def s9_rebuild_manifest(spark, d):
    files = table(spark, d, "embeddings").select(F.format_string("wavs/utt_%06d.wav", "vec_id").alias("path"))
    return S.rebuild_manifest(files, docs(spark, d).select(F.col("doc_id").alias("idx"), "text"), ["a", "b", "c"]).select("idx", "text", "voice")


@query("SELECT doc_id, 'corpora/one/' || source || '/' || doc_id || '.wav' AS wav_path, '/data/corpora/one' AS corpus_root FROM documents")
def s13_rebase_paths(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("wav_path"))
    return S.rebase_paths(rows, "/data/corpora/one", "/data").select("doc_id", "wav_path", "corpus_root")


EVIDENCE = """f AS (SELECT 'p' || page_id AS path, sha256(html) AS sha FROM pages WHERE page_id % 3 <> 1),
    cl AS (SELECT page_id AS claim, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 'p' || page_id END AS path FROM pages),
    ev AS (SELECT claim, cl.path, CASE WHEN cl.path IS NULL THEN 'no_source' WHEN sha IS NULL THEN 'retained' ELSE 'copied' END AS status, sha AS sha256 FROM cl LEFT JOIN f ON cl.path = f.path)"""


def evidence(spark, d):
    pages = table(spark, d, "pages")
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    claims = pages.select(F.col("page_id").alias("claim"), F.when(F.col("page_id") % 3 != 2, path).alias("path"))
    return claims, pages.where("page_id % 3 <> 1").select(path.alias("path"), F.col("html").cast("binary").alias("content"))


@query(f"WITH {EVIDENCE} SELECT * FROM ev")
def s14_evidence_manifest(spark, d):
    return S.evidence_manifest(*evidence(spark, d))


# --- single functions (W23, L1, F19, F20, F53, F55) -------------------------------------------------


@query(f"WITH {VEC} SELECT vec_id, flatten([[x[k] for t in range((vec_id + k) % 4)] for k in range(1, 9)]) AS y FROM w")
def w23_expand_to_frames(spark, d):
    durations = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: ((F.col("vec_id") + k) % 4).cast("int"))
    return vectors(spark, d).select("vec_id", N.expand_to_frames(F.slice("x", 1, 8), durations).alias("y"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 100")
def l1_head(spark, d):
    return picks.head(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 100, "l_extendedprice", "l_orderkey", "l_linenumber")


@query(
    """SELECT doc_id, xor(list_reduce(list_concat([4294967295], [ord(c)::BIGINT for c in string_split('7:' || doc_id, '')]),
      lambda a, c: list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS h FROM documents"""
)
def f19_stable_hash(spark, d):
    return docs(spark, d).select("doc_id", T.stable_hash(F.col("doc_id"), 7).alias("h"))


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN event_id END AS step, CASE WHEN event_type <> 'click' THEN floor(value) - 50.0 END AS percent FROM events")
def f20_parse_gate_line(spark, d):
    """Events as lines of a log; clicks are none."""
    v = F.floor("value") - 50
    line = F.when(F.col("event_type") == "click", "saved").otherwise(F.concat(F.lit("[gate] step "), F.col("event_id").cast("string"), F.lit(": text dependence "), F.when(v >= 0, "+").otherwise(""), v.cast("string"), F.lit("%")))
    return table(spark, d, "events").select("event_id", T.parse_gate_line(line).alias("g")).select("event_id", "g.step", "g.percent")


@query(
    """WITH g AS (SELECT user_id, list(CASE WHEN event_type = 'click' THEN 0 ELSE value * 4 END ORDER BY ts, event_id) AS f FROM events GROUP BY 1),
    m AS (SELECT len([x for x in f if x > 0]) / len(f) AS v, coalesce(list_sort([x for x in f if x > 0])[len([x for x in f if x > 0]) // 2 + 1], 0) AS p, user_id % 10 / 20.0::DOUBLE AS flat FROM g),
    o AS (SELECT avg(v) AS v, list_sort(list(p))[count(*) // 2 + 1] AS p, avg(flat) AS flat FROM m)
    SELECT round(v, 6) AS voiced, round(p, 6) AS median_f0, round(flat, 6) AS flatness, v BETWEEN 0.25 AND 0.9 AND p BETWEEN 70 AND 350 AND flat < 0.65 AS speech_like FROM o"""
)
def f53_speechlikeness(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.when(F.col("event_type") == "click", 0.0).otherwise(F.col("value") * 4).alias("f")))).alias("r"))
    rows = by.select(F.transform("r", lambda x: x["f"]).alias("f0"), (F.col("user_id") % 10 / 20.0).alias("flatness"))
    return r6(align.speechlikeness(rows), "voiced", "median_f0", "flatness")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_extendedprice / (l_quantity - 10) END AS rtf FROM lineitem")
def f55_rtf(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.rtf(F.col("l_extendedprice"), F.col("l_quantity") - 10).alias("rtf"))


# --- jobs (C) ---------------------------------------------------------------------------------------


@query(
    f"""WITH {STRETCHES}, b AS (SELECT DISTINCT lower(trim(text, ' ')) AS k FROM benchmark), a AS (SELECT * FROM q ANTI JOIN b ON lower(q.line) = b.k),
    o AS (SELECT *, length(line) AS n FROM a QUALIFY row_number() OVER (PARTITION BY lower(line) ORDER BY source, doc_id, pos) = 1),
    u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id, pos) AS upto FROM o), t AS (SELECT * FROM u WHERE upto - n < greatest(1, 20000 // (SELECT count(DISTINCT source) FROM documents))),
    g AS (SELECT source, sum(n) AS s FROM t GROUP BY 1), h AS (SELECT source, coalesce(sum(s) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
    SELECT source, doc_id, pos, line AS text FROM t JOIN h USING (source) WHERE before + upto - n < 20000"""
)
def c3_expansion_prompts(spark, d):
    out = jobs.expansion_prompts(docs(spark, d), table(spark, d, "benchmark").select("text"), characters=20_000)
    return out.select("source", "doc_id", F.col("pos").cast("bigint").alias("pos"), "text")


@query(
    f"""WITH RECURSIVE {HOURS}, {LONG_SPLIT}, o AS (SELECT k, s, e, words, row_number() OVER (PARTITION BY k ORDER BY n, s) - 1 AS i FROM pieces)
    SELECT k AS recording, i AS n, round(s, 4) AS start, round(e, 4) AS end, words, k || '_' || lpad(CAST(i AS VARCHAR), 5, '0') AS utt_id FROM o WHERE e - s >= 3"""
)
def c7_ingest(spark, d):
    """Events as words of a recording a user, an hour for a second; of the words only valid ones."""
    hour = (F.col("start") / 3600).alias("start")
    words = timed(spark, d).select(F.col("key").alias("recording"), hour, (F.col("start") / 3600 + 0.05).alias("end"), "word")
    bad = words.select("recording", "start", (F.col("start") - 1).alias("end"), "word")
    out = jobs.ingest(words.unionByName(bad), gap_s=6.0)
    return out.select("recording", "n", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.size(F.split("text", " ")).alias("words"), "utt_id")


@query(
    """WITH u AS (SELECT 'documents' AS corpus, doc_id, source AS teacher FROM documents UNION ALL SELECT 'orders', o_orderkey, o_orderstatus FROM orders)
    SELECT corpus, doc_id, teacher, row_number() OVER (PARTITION BY teacher ORDER BY doc_id, corpus) - 1 AS turn, dense_rank() OVER (ORDER BY teacher) AS group_rank FROM u"""
)
def c8_mix_corpora(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("teacher"), (F.col("o_totalprice") / 1e5).alias("duration_s"))
    rows, _ = jobs.mix_corpora({"documents": records(spark, d).select("doc_id", "teacher", "duration_s"), "orders": orders})
    return rows.select("corpus", "doc_id", "teacher", "turn", "group_rank")


@query()
def c9_disjoint_corpus(spark, d):
    """Customers' orders as signals of two voices: kept records with their split."""
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") / 1e6).alias("v")))).alias("r"))
    voices = spark.sql("SELECT explode(array('low', 'high')) AS voice")
    waves = by.select(F.col("o_custkey").cast("string").alias("text"), F.transform("r", lambda x: x["v"]).alias("w")).crossJoin(voices)
    waves = waves.select("text", "voice", F.transform("w", lambda v: F.when(F.col("voice") == "low", v / 2).otherwise(v)).alias("wav"))
    rows, _ = jobs.disjoint_corpus(waves.select("text").distinct(), voices, waves, 200, P.CurateConfig(min_duration_s=0.0, min_bandwidth_hz=0.0, min_rms_dbfs=-20.0, max_silence_ratio=1.0))
    return rows.select("text", "voice", "split")


@query(
    f"""WITH {LONG}, a AS (SELECT voice, source, dim, avg(value) AS m, greatest(stddev_samp(value), 1e-6) AS s FROM f SEMI JOIN (SELECT voice FROM f GROUP BY 1 HAVING count(DISTINCT source) > 1) k USING (voice) GROUP BY ALL),
    b AS (SELECT voice, dim, avg(value) AS m, greatest(stddev_samp(value), 1e-6) AS s FROM f GROUP BY ALL)
    SELECT utt, dim, round((value - coalesce(a.m, b.m)) / coalesce(a.s, b.s), 6) AS normed FROM f LEFT JOIN a USING (voice, source, dim) LEFT JOIN b USING (voice, dim)"""
)
def c11_expand_corpus(spark, d):
    return r6(jobs.expand_corpus(frames(spark, d))[0].select("utt", "dim", "normed"), "normed")


def corpus_rows(spark, d):
    """Documents as a corpus with faults: ids twice, three sample rates, missing licences."""
    return docs(spark, d).select(F.floor(F.col("doc_id") / 2).alias("utt_id"), "text", (8000 + F.col("doc_id") % 3).alias("sample_rate"), (F.length("text") / 150.0).alias("duration_s"), F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("license"))


@query(
    """WITH r AS (SELECT doc_id // 2 AS utt_id, text, length(text) / 150.0 AS s, 8000 + doc_id % 3 AS rate, CASE WHEN doc_id % 7 > 0 THEN lang END AS licence FROM documents)
    SELECT 'missing fields' AS check, count(*) AS bad FROM r WHERE utt_id IS NULL OR text IS NULL OR licence IS NULL UNION ALL SELECT 'repeated ids', count(*) FROM (SELECT utt_id FROM r GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'held-out texts', count(*) FROM benchmark WHERE lower(trim(text, ' ')) IN (SELECT lower(trim(text, ' ')) FROM r) UNION ALL SELECT 'duration', count(*) FROM r WHERE NOT s BETWEEN 3 AND 30
    UNION ALL SELECT 'further sample rates', count(DISTINCT rate) - 1 FROM r"""
)
def c12_validate(spark, d):
    return jobs.validate(corpus_rows(spark, d), table(spark, d, "benchmark"))


@query("SELECT b.vec_id AS variant, a.vec_id AS base, [(CAST(a.embedding[i] AS DOUBLE) + CAST(b.embedding[i] AS DOUBLE)) / 2 for i in range(1, 65)] AS shared FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 3")
def c13_rendition_pairs(spark, d):
    base = vectors(spark, d).select(F.col("vec_id").alias("utt_id"), F.col("x").alias("series"))
    variants = base.select(F.col("utt_id").alias("variant"), (F.col("utt_id") - 3).alias("variant_of"), "series")
    out = jobs.rendition_pairs(base, variants)
    return out.select("variant", F.col("base_utt_id").alias("base"), "shared")


@query(
    f"""WITH i AS (SELECT vec_id AS id, label AS voice FROM embeddings), b AS (SELECT id, voice, row_number() OVER (ORDER BY md5('0:1:' || id), id) - 1 AS nth, count(*) OVER () AS n FROM i),
    p AS (SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS positive FROM i WINDOW w AS (PARTITION BY voice ORDER BY {hashed_sql(1, 'id')}, id)), {negatives_sql('i', 1)}
    SELECT id AS vec_id, b.voice AS label, nth // 16 AS batch, nth % 16 AS slot, positive, partner AS negative FROM b JOIN p USING (id) LEFT JOIN np USING (id) WHERE nth < n // 16 * 16"""
)
def c14_paired_batches(spark, d):
    return jobs.paired_batches(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 16, 0, 1)


@query(f"WITH {EVIDENCE} SELECT claim, path, status, sha256, CAST(length(html) AS VARCHAR) AS measured, CASE WHEN length(html) >= 400 THEN 'pass' ELSE 'fail' END AS outcome FROM ev JOIN pages ON page_id = claim")
def c15_claims_report(spark, d):
    claims, files = evidence(spark, d)
    claims = claims.select("claim", "path", F.col("claim").alias("report"), F.lit("size.chars").alias("field"), F.lit(">=").alias("op"), F.lit(400.0).alias("bound"), F.lit(None).cast("string").alias("other_field"))
    reports = table(spark, d, "pages").select(F.col("page_id").alias("report"), F.to_json(F.struct(F.struct(F.length("html").alias("chars")).alias("size"))).alias("json"))
    return jobs.claims_report(claims, reports, files).select("claim", "path", "status", "sha256", "measured", "outcome")


TURNED = "t AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS turn, [abs(CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings)"
CHARS = "' abcdefghijklmnopqrstuvwxyz0123456789.,!?;:''\"-()[]'"


@query(
    rf"""WITH {TURNED}, i AS (SELECT doc_id, source, list_concat([2], [CASE WHEN instr({CHARS}, c) > 0 THEN instr({CHARS}, c) + 27 ELSE 1 END for c in string_split(text, '') if c <> '' AND (c = ' ' OR NOT regexp_matches(c, '^\s$'))], [3]) AS ids FROM documents),
    z AS (SELECT doc_id, source, ids, e, greatest(least(len(ids), len(e)), 1) AS n FROM i JOIN t ON turn = doc_id % (SELECT count(*) FROM embeddings)), {FALLBACK.format('z')}
    SELECT doc_id AS utt_id, ids, durations, round(greatest(CASE WHEN source = 'src0' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 0.05::DOUBLE), 6) AS weight FROM dz"""
)
def c10_feature_cache(spark, d):
    """Every document has a series: vectors are taken in turn, and with no vectors at all the series is empty."""
    turns = indexed(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "vec_id", "turn")
    n = F.broadcast(table(spark, d, "embeddings").agg(F.count("*").alias("n")))
    placed = docs(spark, d).crossJoin(n).withColumn("at", F.when(F.col("n") > 0, F.pmod(F.coalesce("doc_id", F.lit(0)), "n")))  # one row
    rows = placed.join(turns, F.col("at") == F.col("turn"), "left").withColumn("x", F.coalesce("x", F.array().cast("array<double>"))).select(F.col("doc_id").alias("utt_id"), "text", F.col("source").alias("teacher"), F.col("lang").alias("voice"), F.lit(None).cast("double").alias("mos"), F.transform("x", F.abs).alias("energy"))
    return r6(jobs.feature_cache(rows, spark.sql("SELECT 'src0' AS name, 0.5D AS weight")).select("utt_id", "ids", "durations", "weight"), "weight")


# --- near-duplicate texts (C16) ------------------------------------------------------------------------


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS j, len(ws) AS n FROM d),
    i AS (SELECT doc_id, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS t FROM w QUALIFY j = 0 OR j <= n - 5),
    s AS (SELECT DISTINCT doc_id, t FROM i), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT t FROM s GROUP BY 1 HAVING count(*) > 1),
    r AS (SELECT doc_id, t, n FROM s SEMI JOIN f USING (t) JOIN n USING (doc_id)),
    l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), z AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT z.x, u.y FROM z JOIN u ON z.y = u.x)
    SELECT z.x AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(z.y) AS component_id FROM z LEFT JOIN n ON n.doc_id = z.x GROUP BY 1"""
)
def c16_near_duplicates(spark, d):
    """Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return neartext.near_duplicates(docs(spark, d))


# --- streams (T): the events' files as they come, a slice of time after another --------------------------


def slices(spark, d, parts=3):
    """(the events' slice number, by time: cuts at exact quantiles; the folder for what comes of them)."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    ev = table(spark, d, "events").withColumn("at", at)
    cuts = [c for c in quantiles(ev, F.col("at"), [k / parts for k in range(1, parts)]) if c is not None]
    number = sum((F.col("at") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    return ev.withColumn("slice", number).drop("at"), scratch(spark)


def arrivals(spark, d, run, parts=3):
    """Writes a slice to folder/in, as many files as Spark has tasks for, then calls run(stream, folder), again and again; the folder."""
    ev, folder = slices(spark, d, parts)
    for k in range(parts):
        ev.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{folder}/in")
        run(streams.events_stream(spark, f"{folder}/in"), folder)
    return folder


def ended(spark, stream, folder, name):
    streams.append_manifest(stream, f"{folder}/{name}", f"{folder}/{name}-state").awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")


#: Slice numbers of the events, as slices() gives them.
SLICED = "ev AS (SELECT *, (epoch_us(ts) / 1e6 > a)::INT + (epoch_us(ts) / 1e6 > b)::INT AS slice FROM events, (SELECT quantile_cont(epoch_us(ts) / 1e6, 1 / 3::DOUBLE) AS a, quantile_cont(epoch_us(ts) / 1e6, 2 / 3::DOUBLE) AS b FROM events))"


@query("SELECT event_id, user_id, event_type, value FROM events")
def t1_append_manifest(spark, d):
    """Files that come in three times; a further run finds nothing new."""
    folder = arrivals(spark, d, lambda stream, folder: ended(spark, stream, folder, "out"))
    return ended(spark, streams.events_stream(spark, f"{folder}/in"), folder, "out").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def t2_process_new(spark, d):
    """The producer writes slices and then its marker; the consumer runs until it sees that."""
    ev, folder = slices(spark, d)
    batch = lambda df, i: df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{folder}/sums/batch={i}")
    for k in range(3):
        ev.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{folder}/in")
        if k == 2:
            spark.range(1).write.parquet(f"{folder}/ended")
        streams.process_until(spark, lambda: streams.events_stream(spark, f"{folder}/in"), batch, f"{folder}/ledger", f"{folder}/ended" if k == 2 else f"{folder}/in", 0.0)
    sums = spark.read.parquet(f"{folder}/sums").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.select("event_type", "n", F.round("total", 4).alias("total"))


@query(
    f"""WITH {SLICED}, s AS (SELECT user_id, slice, avg(value) AS m, var_pop(value) AS v FROM ev GROUP BY ALL), l AS (SELECT user_id, list(m ORDER BY slice) AS m, list(v ORDER BY slice) AS v FROM s GROUP BY 1)
    SELECT user_id, round(list_reduce(m, lambda a, x: 0.99::DOUBLE * a + 0.01::DOUBLE * x), 8) AS mean, round(list_reduce(v, lambda a, x: 0.99::DOUBLE * a + 0.01::DOUBLE * x), 5) AS var FROM l"""
)
def t3_ema_norm(spark, d):
    """Three batches: the first one's statistics are copied, the others' mixed in."""

    def run(stream, folder):
        streams.ema_norm_tables(stream, f"{folder}/stats", f"{folder}/state").awaitTermination()

    stats = spark.read.parquet(f"{arrivals(spark, d, run)}/stats")
    last = stats.groupBy("user_id").agg(F.max_by("mean", "batch").alias("mean"), F.max_by("var", "batch").alias("var"))
    return last.select("user_id", F.round("mean", 8).alias("mean"), F.round("var", 5).alias("var"))


@query(
    """WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events))
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def t4_sessions(spark, d):
    """Sessions that the watermark has passed."""
    folder = arrivals(spark, d, lambda stream, folder: ended(spark, streams.sessions(stream), folder, "sessions"))
    return spark.read.parquet(f"{folder}/sessions").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first"), "n")


@query(f"WITH RECURSIVE {HOURS}, {segments_sql('w', 'g', '3.0', '15.0', '6.0')} SELECT key, round(s, 4) AS start, round(e, 4) AS end, last - first + 1 AS words FROM g")
def t4_capped_segments(spark, d):
    """W7's segments from a stream in three batches and an end marker a key. An hour counts as a second, so the watermark's hour is a second, too."""
    ev, folder = slices(spark, d)
    words = ev.select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("start"), F.col("event_type").alias("word"), "slice")
    words = words.select("key", F.timestamp_micros((F.col("start") * 1e6).cast("bigint")).alias("ts"), "start", (F.col("start") + 0.05).alias("end"), "word", "slice")
    now = words.agg(F.max("ts").alias("ts"))  # a marker comes when the last word does, or it would be late
    over = words.select("key").distinct().crossJoin(F.broadcast(now)).select("key", "ts", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("word"), F.lit(3).alias("slice"))
    every = words.unionByName(over)
    for k in range(4):
        every.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("key bigint, ts timestamp, start double, end double, word string").parquet(f"{folder}/in")
        streams.capped_segments_tables(stream, f"{folder}/segments", f"{folder}/state", late_s=5.0, gap_s=6.0, hold_s=1e9).awaitTermination()
    return spark.read.parquet(f"{folder}/segments/done").select("key", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.col("n").alias("words"))


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'click'")
def t5_validate_stream(spark, d):
    held = spark.sql("SELECT ' CLICK ' AS event_type")
    folder = arrivals(spark, d, lambda stream, folder: ended(spark, streams.validate_stream(stream, held, "event_id", "event_type"), folder, "valid"))
    return spark.read.parquet(f"{folder}/valid").select("event_id", "user_id")


@query(
    """WITH r AS (SELECT doc_id // 2 AS utt_id, text, length(text) / 150.0 AS s, 8000 + doc_id % 3 AS rate, CASE WHEN doc_id % 7 > 0 THEN lang END AS licence FROM documents)
    SELECT 'missing fields' AS check, count(*) AS bad FROM r WHERE utt_id IS NULL OR text IS NULL OR licence IS NULL UNION ALL SELECT 'repeated ids', count(*) FROM (SELECT utt_id FROM r GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'held-out texts', count(*) FROM benchmark WHERE lower(trim(text, ' ')) IN (SELECT lower(trim(text, ' ')) FROM r) UNION ALL SELECT 'duration', count(*) FROM r WHERE NOT s BETWEEN 3 AND 30
    UNION ALL SELECT 'further sample rates', count(DISTINCT rate) - 1 FROM r"""
)
def t5_validation_counters(spark, d):
    """The running counters after the last of three batches: those of C12 on the whole table."""
    folder = scratch(spark)
    rows = corpus_rows(spark, d).withColumn("utt_id", F.col("utt_id").cast("string"))
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("text", "utt_id"), F.lit(3)) == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        streams.validation_counters(stream, table(spark, d, "benchmark"), f"{folder}/state", f"{folder}/ledger").awaitTermination()
    found = spark.read.parquet(f"{folder}/state/counters")
    return found.groupBy("check").agg(F.max_by("bad", "batch").alias("bad"))


@query("WITH h AS (SELECT event_id, row_number() OVER (ORDER BY md5('5:0:' || event_id), event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, i // 64 AS batch, i % 64 AS slot FROM h WHERE i < n // 64 * 64 AND i // 64 >= 40")
def t6_resume(spark, d):
    """An epoch's batches from a saved position on."""
    return streams.resume(W.epoch_batches(table(spark, d, "events").select("event_id"), "event_id", 64, 5, 0), 40)


@query("WITH h AS (SELECT event_id, row_number() OVER (ORDER BY md5('5:0:' || event_id), event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, i // 64 AS batch, i % 64 AS slot FROM h WHERE i < n // 64 * 64")
def t6_stop_and_resume(spark, d):
    """A run that stops after 40 batches, and one that reads its position and goes on: each row once."""
    folder = scratch(spark)
    epoch = lambda: W.epoch_batches(table(spark, d, "events").select("event_id"), "event_id", 64, 5, 0)
    streams.run_batches(epoch(), folder, stop=40)
    streams.run_batches(epoch(), folder)
    return spark.read.schema("event_id bigint, slot bigint, batch bigint").parquet(f"{folder}/batches").select("event_id", "batch", "slot")


# --- table functions (X) ------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {HOURS}, {segments_sql('w', 'g', '3.0', '15.0', '6.0')} SELECT CAST(key AS VARCHAR) AS key, CAST(n AS INT) AS n, round(s, 4) AS start, round(e, 4) AS end, CAST(last - first + 1 AS INT) AS words FROM g")
def x6_segment_words(spark, d):
    """W7's segments by a table function, called from SQL on partitions of the words."""
    tables.register(spark)
    hours(spark, d).createOrReplaceTempView("millrace_hours")
    return spark.sql(
        """SELECT key, n, round(start, 4) AS start, round(end, 4) AS end, words
        FROM segment_words(TABLE(SELECT key, start, end, word FROM millrace_hours) PARTITION BY key ORDER BY (start, end, word), 3.0D, 15.0D, 6.0D)"""
    )
