"""Registered queries of the corpus operators, each with SQL for the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import filters as P
from millrace.operators import joins as J
from millrace.operators import order, picks, sets
from millrace.operators import windows as W
from millrace.plans.adapters import frames, records, series, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def rounded(xs, digits: int):
    """An array's values rounded; 0.0 stands for -0.0, which arrays would be told apart by (in SQL: round(x, n) + 0)."""
    return F.transform(xs, lambda v: F.round(v, digits) + F.lit(0.0))


# Pieces of SQL that several oracles share.
LONG = "f AS (SELECT vec_id AS utt, label AS voice, vec_id % 2 AS source, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
SERIES = f"{LONG}, z AS (SELECT utt, voice, dim % 8 AS dim, dim // 8 AS frame, value FROM f)"
RECORDS = "r AS (SELECT doc_id, source AS teacher, lang AS voice, text, length(text) / 150.0::DOUBLE AS duration_s, CAST(quality AS DOUBLE) AS mos FROM documents LEFT JOIN labels USING (doc_id))"
WS = "list_filter(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"
HEADS = "'" + "','".join(T.HEADINGS) + "'"
ROMANS = "|".join(T.ROMAN)
SENT = rf"""
 s0 AS (SELECT doc_id, source, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS raw, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS pos FROM documents),
 s1 AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM s0),
 s2 AS (SELECT doc_id, source, pos, trim(regexp_replace(replace(replace(line, '_', ' '), '--', ', '), '\s+', ' ', 'g')) AS sentence FROM s1 WHERE line <> '' AND length(line) <= 400),
 s3 AS (SELECT *, string_split(sentence, ' ') AS ws FROM s2 WHERE regexp_matches(sentence, '^[A-Za-z][A-Za-z ,;:''\-()]*[.!?]$')),
 s AS (SELECT doc_id, source, pos, sentence FROM s3 WHERE len(ws) BETWEEN 8 AND 22 AND len(list_filter(ws, lambda x: length(x) > 16)) = 0
   AND len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) = 0
   AND upper(trim(ws[1], '.,;:!?')) NOT IN ({HEADS}, 'ADVENTURE') AND NOT regexp_matches(sentence, '\b({ROMANS})\b\.?$')
   AND len(list_filter(ws, lambda x: x[1] = upper(x[1]) AND x[1] <> lower(x[1]))) / len(ws) <= 0.5)"""


# Fixed values of the text rules, as SQL: text in {0} normalised (no text of the given tables changes under NFKC).
ABBREVIATED = {
    True: lambda x: reduce(lambda out, p: f"replace({out}, '{p[0]}', '{p[1]}')", T.ABBREVIATIONS.items(), x),
    False: lambda x: reduce(lambda out, p: f"regexp_replace({out}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){p[0][:-1]}\\.', '\\1{p[1]}', 'g')" if p[0][0].isalpha() else f"replace({out}, '{p[0]}', '{p[1]}')", T.ABBREVIATIONS.items(), x),
}
DIGIT = "CASE c " + " ".join(f"WHEN '{i}' THEN '{w}'" for i, w in enumerate(T.DIGITS)) + " END"


def normal_sql(x: str, compat: bool) -> str:
    marks = f"regexp_replace(translate({x}, '’“”', chr(39) || '""'), '[–—]', ' - ', 'g')"
    low = f"lower({ABBREVIATED[compat](marks)})"
    runs = rf"regexp_extract_all({low}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
    said = f"array_to_string([CASE WHEN regexp_matches(w, '^[0-9]+$') THEN array_to_string([{DIGIT} for c in string_split(w, '')], ' ') ELSE w END for w in {runs}], '')"
    return f"trim(regexp_replace(regexp_replace({said}, '[^a-z0-9''\\-.,!?;:()\\[\\] ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tagged_sql(x: str, compat: bool) -> str:
    parts = f"string_split(regexp_replace({x}, '(<[a-zA-Z_ ]+>)', chr(2) || '\\1' || chr(2), 'g'), chr(2))"
    each = f"list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 THEN lower(p) ELSE {normal_sql('p', compat)} END)"
    return f"trim(regexp_replace(array_to_string(list_filter({each}, lambda p: p <> ''), ' '), '\\s+', ' ', 'g'))"


TOKENS = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9'' ]', ' ', 'g'), ' +'), lambda x: x <> '')"
#: Edit distances d of the token lists a and b of pr(k, a, b): a row of the table of distances for each token of a.
EDITS = """ta AS (SELECT k, unnest(range(1, len(a) + 1)) AS i, unnest([hash(x) for x in a]) AS x FROM pr),
    dp AS (SELECT k, 0 AS i, unnest(range(len(b) + 1)) AS j, unnest(range(len(b) + 1)) AS v, unnest(list_concat([0::UBIGINT], [hash(x) for x in b])) AS y FROM pr
    UNION ALL SELECT k, i, j, j + min(t - j) OVER (PARTITION BY k ORDER BY j) AS v, y FROM (
      SELECT dp.k, ta.i, j, y, CASE WHEN j = 0 THEN ta.i ELSE least(v + 1, lag(v) OVER (PARTITION BY dp.k ORDER BY j) + CASE WHEN ta.x = y THEN 0 ELSE 1 END) END AS t
      FROM dp JOIN ta ON ta.k = dp.k AND ta.i = dp.i + 1)),
    ed AS (SELECT k, v AS d FROM dp JOIN (SELECT k, len(a) AS la, len(b) AS lb FROM pr) n USING (k) WHERE i = la AND j = lb)"""
WER = "CASE WHEN len({0}) = 0 THEN CASE WHEN len({1}) = 0 THEN 0.0 ELSE 1.0 END ELSE d / len({0}) END"


def docs(spark, d):
    return table(spark, d, "documents")


# --- prompts (C1, C2, C3, P4 to P7, W1 to W5, L1) ---------------------------------------------------


@query(f"WITH {SENT} SELECT doc_id, source, pos, sentence FROM s")
def p6_sentences(spark, d):
    return P.sentences(docs(spark, d).select("doc_id", "source", "text")).select("doc_id", "source", "pos", "sentence")


@query(
    f"""WITH {SENT}, k AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(sentence), '[^a-z]', '', 'g') ORDER BY source, doc_id, pos) AS n FROM s),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS turn, dense_rank() OVER (ORDER BY source) AS g FROM k WHERE n = 1)
    SELECT row_number() OVER (ORDER BY turn, g) AS rank, source, sentence FROM t QUALIFY rank <= 500"""
)
def c1_build_prompts(spark, d):
    """Sentences, first of each key, interleaved by source, the first 500."""
    from millrace.plans.jobs import build_prompts

    return build_prompts(docs(spark, d), 500).select("rank", "source", "sentence")


@query(
    f"""WITH {SENT}, b AS (SELECT DISTINCT regexp_replace(lower(text), '[^a-z]', '', 'g') AS k FROM benchmark),
    a AS (SELECT * FROM s ANTI JOIN b ON regexp_replace(lower(s.sentence), '[^a-z]', '', 'g') = b.k)
    SELECT source, doc_id, pos, sentence FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) <= 20"""
)
def c2_holdout_prompts(spark, d):
    from millrace.plans.jobs import holdout_prompts

    return holdout_prompts(docs(spark, d), table(spark, d, "benchmark"), 20)


@query(
    rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, text, {WS.format("text")} AS ws FROM documents)
    SELECT doc_id, len(ws) >= 5 AND len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) = 0 AND upper(ws[1]) NOT IN ({HEADS})
      AND NOT list_contains({T.ROMAN}, upper(trim(ws[-1], '.,;:!?'))) AND len(list_filter(ws, lambda x: x[1] = upper(x[1]) AND x[1] <> lower(x[1]))) / len(ws) <= 0.5 AS prose FROM t"""
)
def p4_prose_like(spark, d):
    return docs(spark, d).select("doc_id", T.is_prose_like(F.col("text")).alias("prose"))


STRETCHES = r"""l AS (SELECT doc_id, source, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line, pos FROM (SELECT doc_id, source, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS pos FROM
      (SELECT doc_id, source, regexp_extract_all(translate(text, chr(13) || chr(10), '  '), '[^.!?]+[.!?]') AS x FROM documents))),
    q AS (SELECT * FROM l WHERE length(line) BETWEEN 60 AND 220 AND length(line) - length(replace(line, ' ', '')) >= 6 AND regexp_matches(line, '^\p{Lu}')
      AND NOT regexp_matches(line, '[_\[\]{}]|http|Gutenberg|Copyright|CHAPTER|^Chapter')
      AND length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) <= 0.3 * greatest(1, length(regexp_replace(line, '[^\p{L}]', '', 'g')))
      AND len(string_split(line, ' ')) BETWEEN 8 AND 40 AND regexp_matches(line, '[.!?]$'))"""


@query(f"WITH {STRETCHES} SELECT doc_id, line FROM q")
def p7_expansion_candidates(spark, d):
    rows = docs(spark, d).select("doc_id", F.explode(T.stretches(F.col("text"))).alias("raw"))
    return rows.where(T.is_expansion_candidate(F.col("raw"))).select("doc_id", T.squeeze(F.col("raw")).alias("line"))


@query(
    f"""WITH {SENT}, k AS (SELECT source, sentence, doc_id, pos FROM s),
    a AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY source ORDER BY doc_id, pos) AS upto FROM k) SELECT source, sentence, doc_id, pos FROM a WHERE upto <= 3000"""
)
def w4_prefix_within(spark, d):
    rows = P.sentences(docs(spark, d).select("doc_id", "source", "text")).select("source", "sentence", "doc_id", "pos")
    return W.prefix_within(rows, "source", "doc_id", F.length("sentence"), 3000, "pos")


@query(
    f"""WITH {SENT}, k AS (SELECT source, sentence, doc_id, pos FROM s),
    a AS (SELECT *, length(sentence) AS n, sum(length(sentence)) OVER (PARTITION BY source ORDER BY doc_id, pos) AS upto FROM k),
    o AS (SELECT * FROM a WHERE upto - n < 2000), g AS (SELECT source, sum(n) AS t FROM o GROUP BY source),
    h AS (SELECT source, coalesce(sum(t) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
    SELECT o.source, sentence, doc_id, pos FROM o JOIN h USING (source) WHERE b + upto - n < 15000"""
)
def w5_prefix_until(spark, d):
    rows = P.sentences(docs(spark, d).select("doc_id", "source", "text")).select("source", "sentence", "doc_id", "pos")
    return W.prefix_until(rows, "source", "doc_id", F.length("sentence"), 2000, 15000, "pos")


@query("SELECT doc_id, source, text FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
def w1_dedup_first(spark, d):
    return W.dedup_first(docs(spark, d).select("doc_id", "source", "text"), F.lower("text"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS turn, dense_rank() OVER (ORDER BY l_returnflag) AS group_rank FROM lineitem")
def w2_interleave(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return W.interleave(rows, "l_returnflag", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_returnflag", "turn", "group_rank")


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 5")
def w3_head_per_group(spark, d):
    return W.head_per_group(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), "l_suppkey", 5, "l_orderkey", "l_linenumber")


# --- text functions (F) -----------------------------------------------------------------------------


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS alnum, trim(lower(text), ' ') AS strip FROM documents")
def f7_match_keys(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", *[T.match_key(c, m).alias(m) for m in ("letters", "alnum", "strip")])


@query("SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9'' ]', ' ', 'g'), ' +'), lambda x: x <> '') AS tokens FROM documents")
def f6_wer_tokens(spark, d):
    return docs(spark, d).select("doc_id", T.wer_tokens(F.col("text")).alias("tokens"))


@query(
    r"""WITH c AS (SELECT doc_id, [x for x in string_split(text, '') if x <> '' AND (x = ' ' OR NOT regexp_matches(x, '^\s$'))] AS cs FROM documents)
    SELECT doc_id, list_concat([2], [CASE WHEN instr(' abcdefghijklmnopqrstuvwxyz0123456789.,!?;:''"-()[]', x) > 0 THEN instr(' abcdefghijklmnopqrstuvwxyz0123456789.,!?;:''"-()[]', x) + 27 ELSE 1 END for x in cs], [3]) AS ids FROM c"""
)
def f4_char_ids(spark, d):
    return docs(spark, d).select("doc_id", T.char_ids(F.col("text")).alias("ids"))


@query(r"""SELECT doc_id, regexp_replace(replace(replace(text, chr(10), ''), chr(13), ''), '[^ a-z0-9.,!?;:''"()\[\]-]', '<unk>', 'g') AS text FROM documents""")
def f5_char_round_trip(spark, d):
    """Characters with an id come back from their ids."""
    return docs(spark, d).select("doc_id", T.from_char_ids(T.char_ids(F.col("text"))).alias("text"))


@query("SELECT doc_id, [t for t in ['<laugh>','<sigh>','<calm>'] if contains(lower('<Laugh> ' || text), t)] AS tags FROM documents")
def f3_scan_tags(spark, d):
    return docs(spark, d).select("doc_id", T.scan_tags(F.concat(F.lit("<Laugh> "), "text"), ["<laugh>", "<sigh>", "<calm>"]).alias("tags"))


TAGGED = "'<Laugh> ' || text || ' 10 St. <odd_tag><calm>Mr. 7a, no. 42'"
UNTAGGED = f"regexp_replace({TAGGED}, '<[a-zA-Z_ ]+>', ' ', 'g')"


@query(f"SELECT doc_id, {tagged_sql(TAGGED, False)} AS plain, {tagged_sql(TAGGED, True)} AS compat FROM documents")
def f1_normalize_text(spark, d):
    """Texts with some tags, numbers and abbreviations around them."""
    text = F.concat(F.lit("<Laugh> "), "text", F.lit(" 10 St. <odd_tag><calm>Mr. 7a, no. 42"))
    return docs(spark, d).select("doc_id", T.normalize_text(text).alias("plain"), T.normalize_text(text, compat=True).alias("compat"))


@query(f"SELECT doc_id, {normal_sql(UNTAGGED, False)} AS plain, ['<laugh>', '<calm>'] AS tags FROM documents")
def f2_split_tags(spark, d):
    text = F.concat(F.lit("<Laugh> "), "text", F.lit(" 10 St. <odd_tag><calm>Mr. 7a, no. 42"))
    plain, tags = T.split_tags(text)
    return docs(spark, d).select("doc_id", plain.alias("plain"), tags.alias("tags"))


BEFORE = "coalesce(lag(text) OVER w, last_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, text, {BEFORE} AS other FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    pr AS (SELECT conv_id * 1000 + turn AS k, {TOKENS.format('text')} AS a, {TOKENS.format('other')} AS b FROM t), {EDITS}
    SELECT k // 1000 AS conv_id, k % 1000 AS turn, round({WER.format('a', 'b')}, 6) AS wer FROM pr JOIN ed USING (k)"""
)
def f8_word_error_rate(spark, d):
    """Turns against the turn before them."""
    rows = J.shuffled_control(table(spark, d, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.round(T.word_error_rate(F.col("text"), F.col("other_text")), 6).alias("wer"))


#: Three turns in a row stand for one utterance's transcripts: e(conv_id, part, wer).
THREES = f"""t AS (SELECT conv_id, turn, turn // 3 AS part, {TOKENS.format('text')} AS w FROM conversations),
    two AS (SELECT x.conv_id, x.part, x.w AS a, y.w AS b, row_number() OVER () AS k FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.part = y.part AND x.turn < y.turn),
    pr AS (SELECT k, a, b FROM two), {EDITS},
    e AS (SELECT t.conv_id, t.part, coalesce(any_value(m), 0.0) AS wer, count(DISTINCT turn) AS texts FROM t
      LEFT JOIN (SELECT conv_id, part, avg(greatest({WER.format('a', 'b')}, {WER.format('b', 'a')})) AS m FROM two JOIN ed USING (k) GROUP BY 1, 2) p ON t.conv_id = p.conv_id AND t.part = p.part GROUP BY 1, 2)"""


def threes(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 3).alias("part")).agg(F.array_sort(F.collect_list("text")).alias("texts"))


@query(f"WITH RECURSIVE {THREES} SELECT conv_id, part, round(wer, 6) AS wer FROM e")
def f14_pairwise_wer(spark, d):
    return threes(spark, d).select("conv_id", "part", F.round(T.average_pairwise_wer(F.col("texts")), 6).alias("wer"))


@query(
    f"""WITH RECURSIVE {THREES} SELECT conv_id, part, conv_id % 5 <> 0 AND NOT (texts >= 2 AND wer > 0.9) AS keep, CASE WHEN conv_id % 5 <> 0 AND texts >= 2 AND wer > 0.9 THEN ['asr_disagreement'] ELSE [] END AS reasons, round(CASE WHEN conv_id % 5 <> 0 AND texts >= 2 THEN wer END, 6) AS asr_wer,
    CASE WHEN conv_id % 5 <> 0 AND texts < 2 THEN ['asr_skipped'] ELSE [] END AS notes FROM e"""
)
def p3_asr_gate(spark, d):
    none = F.array().cast("array<string>")
    rows = threes(spark, d).withColumnRenamed("texts", "transcripts").select("*", (F.col("conv_id") % 5 != 0).alias("keep"), none.alias("reasons"), none.alias("notes"))
    out = P.asr_gate(rows, max_wer=0.9)
    return r6(out.select("conv_id", "part", "keep", F.transform("reasons", lambda r: F.substring_index(r, "(", 1)).alias("reasons"), "notes", "asr_wer"), "asr_wer")


#: The readings of text t, s being t without its last mark.
READINGS = r"""list_filter([CASE WHEN suffix(t, '.') THEN s || '!' END, CASE WHEN suffix(t, '.') THEN s || '?' END, CASE WHEN regexp_matches(t, '[!?]$') THEN s || '.' END,
      CASE WHEN length(t) > 60 AND regexp_matches(t[21:], '\b(and|but|which|while|because|when|that)\b') THEN replace(t[:20] || regexp_replace(t[21:], '(?s)^(.*?)\b(and|but|which|while|because|when|that)\b', '\1,\2'), ' ,', ',') END], lambda x: x IS NOT NULL)"""
STEMS = "(SELECT conv_id, turn, t, regexp_replace(t, '[.!?]$', '') AS s FROM (SELECT conv_id, turn, trim(text, ' ') AS t FROM conversations))"


@query(f"SELECT conv_id, turn, {READINGS} AS readings FROM {STEMS}")
def f15_variants(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.variants(F.col("text")).alias("readings"))


@query("SELECT event_id, props->>'$.k' AS k, md5(props) AS print, sha256(props) AS print256 FROM events")
def f21_dig(spark, d):
    return table(spark, d, "events").select("event_id", T.dig(F.col("props"), "k").alias("k"), F.md5("props").alias("print"), T.fingerprint(F.col("props")).alias("print256"))


@query("SELECT source, n, weight FROM (SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 0.6 WHEN 'src1' THEN 1.0 ELSE NULL END AS weight FROM documents GROUP BY source)")
def f17_parse_mix(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n")).select("source", "n", F.try_element_at(T.parse_mix(F.lit("src0=.6, src1")), F.col("source")).alias("weight"))


# --- filters, licences and gates (P, A1, C6) --------------------------------------------------------


@query(
    f"""WITH {RECORDS} SELECT doc_id, list_filter([CASE WHEN duration_s < 3.0 THEN printf('too_short(%.2fs<3.0)', duration_s) END, CASE WHEN duration_s > 30.0 THEN printf('too_long(%.2fs>30.0)', duration_s) END,
    CASE WHEN mos < 2.0 THEN printf('low_mos(%.2f)', mos) END], lambda x: x IS NOT NULL) AS reasons FROM r"""
)
def p1_gates(spark, d):
    return P.apply_gates(records(spark, d)).select("doc_id", "reasons")


@query(
    f"""WITH {RECORDS}, k AS (SELECT *, NOT (duration_s < 3 OR duration_s > 30 OR coalesce(mos < 0.5, false)) AS keep FROM r)
    SELECT count(*) AS n_total, count(*) FILTER (keep) AS n_kept, count(*) FILTER (NOT keep) AS n_rejected, round(coalesce(sum(duration_s) FILTER (keep), 0) / 3600, 6) AS hours_kept FROM k"""
)
def a1_curation_report(spark, d):
    return r6(A.curation_report(P.apply_gates(records(spark, d), P.CurateConfig(min_mos=0.5))), "hours_kept")


@query(
    f"""WITH {RECORDS} SELECT unnest(list_filter([CASE WHEN duration_s < 3 THEN 'too_short' END, CASE WHEN duration_s > 30 THEN 'too_long' END, CASE WHEN mos < 0.5 THEN 'low_mos' END], lambda x: x IS NOT NULL)) AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def a1_reason_counts(spark, d):
    return A.reason_counts(P.apply_gates(records(spark, d), P.CurateConfig(min_mos=0.5)))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def p10_licence_gate(spark, d):
    registry = spark.sql("SELECT * FROM VALUES ('src1', false), ('src2', true), ('src3', false) AS t(name, restricted)")
    return P.licence_gate(docs(spark, d).select("doc_id", "source"), registry, "source")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 32)")
def p11_min_support(spark, d):
    return P.min_support(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", 32)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE r <= floor(n * 0.4)")
def p15_cap_share(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return P.cap_share(rows, "l_suppkey", "l_returnflag", 0.4, "at").drop("at")


@query("SELECT event_id, user_id, value, round(max(value) OVER w - min(value) OVER w, 6) AS spread, max(value) OVER w - min(value) OVER w > 90 AS disagrees FROM events WINDOW w AS (PARTITION BY user_id, event_type)")
def p16_disagreement(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "value", F.concat_ws("|", "user_id", "event_type").alias("k"))
    return r6(P.flag_disagreement(rows, 90, "k", "value").drop("k"), "spread")


# --- joins (J) --------------------------------------------------------------------------------------


@query("SELECT doc_id, source, CASE source WHEN 'src0' THEN 0.4 WHEN 'src1' THEN 0.25 ELSE 1.0 END AS share FROM documents")
def j1_attach_share(spark, d):
    mix = spark.sql("SELECT * FROM VALUES ('src0', 0.4D), ('src1', 0.25D) AS t(name, weight)")
    return J.attach_share(docs(spark, d).select("doc_id", "source"), mix, "source")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS base_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1")
def j2_pair_by_ref(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return J.pair_by_ref(rows, rows.where("l_linenumber = 1"), "l_orderkey", "l_orderkey").select("l_orderkey", "l_linenumber", F.col("base_l_linenumber").alias("base_line"))


@query("WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT a.doc_id, b.doc_id AS other FROM i a JOIN i b ON b.i = a.i + 5")
def j3_pair_by_offset(spark, d):
    rows = order.indexed(docs(spark, d).select("doc_id"), "doc_id")
    return J.pair_by_offset(rows, 5).select("doc_id", F.col("other_doc_id").alias("other"))


@query(
    """WITH m(name, voice) AS (VALUES ('en', 0), ('fr', 1)), u AS (SELECT lang AS name, min(doc_id) AS first FROM documents GROUP BY 1),
    e AS (SELECT name, row_number() OVER (ORDER BY u.first) - 1 AS v FROM u), k AS (SELECT e.name, m.voice AS known, e.v FROM e LEFT JOIN m USING (name)),
    p AS (SELECT name, coalesce(known, 1 + row_number() OVER (PARTITION BY known IS NULL ORDER BY v, name)) AS merged_voice FROM k)
    SELECT doc_id, lang AS name, merged_voice FROM documents JOIN p ON lang = p.name"""
)
def j4_remap_keys(spark, d):
    rows = docs(spark, d)
    extra = W.dense_index(rows, "lang", "doc_id").select(F.col("lang").alias("name"), F.col("idx").alias("voice"))
    merged = spark.sql("SELECT * FROM VALUES (0L, 'en'), (1L, 'fr') AS t(voice, name)")
    numbered = rows.join(extra, F.col("lang") == F.col("name")).select("doc_id", "voice")
    return J.remap_keys(numbered, extra, merged).select("doc_id", "name", "merged_voice")


@query(
    f"""WITH {LONG}, a AS (SELECT voice, source, dim, avg(value) AS m, stddev_samp(value) AS s FROM f WHERE voice < 5 GROUP BY ALL),
    b AS (SELECT voice, dim, avg(value) AS m, stddev_samp(value) AS s FROM f WHERE voice < 8 GROUP BY ALL)
    SELECT utt, dim, round(coalesce((value - coalesce(a.m, b.m)) / coalesce(a.s, b.s), value), 6) AS normed FROM f LEFT JOIN a USING (voice, source, dim) LEFT JOIN b USING (voice, dim)"""
)
def j5_apply_norm(spark, d):
    f = frames(spark, d)
    a = A.group_stats(f.where("voice < 5"), ["voice", "source", "dim"])
    b = A.group_stats(f.where("voice < 8"), ["voice", "dim"])
    return r6(J.apply_norm(f, a, b).select("utt", "dim", "normed"), "normed")


@query("SELECT doc_id, text FROM documents WHERE lower(text) NOT IN (SELECT lower(text) FROM benchmark) AND lang NOT IN ('fr')")
def j6_exclude(spark, d):
    rows = J.exclude(docs(spark, d), table(spark, d, "benchmark").select(F.lower("text")), key=F.lower("text"))
    return J.exclude(rows, spark.sql("SELECT 'fr' AS k"), key="lang").select("doc_id", "text")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE lower(trim(o_orderstatus)) IN (SELECT lower(trim(l_linestatus)) FROM lineitem)")
def j7_overlap(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("text"))
    b = table(spark, d, "orders").withColumn("text", F.col("o_orderstatus"))
    return J.holdout_overlap(a, b).select("o_custkey", "o_orderkey")


@query("SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def j8_pairs_within(spark, d):
    return J.pairs_within(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    """WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), w AS (SELECT user_id, ts, event_id AS e FROM events WHERE event_type = 'click'),
    f AS (SELECT user_id, arg_min(e, ts) AS first FROM w GROUP BY 1)
    SELECT p.event_id, coalesce(w.e, f.first) AS word FROM p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts >= w.ts LEFT JOIN f ON p.user_id = f.user_id"""
)
def j9_asof(spark, d):
    ev = table(spark, d, "events")
    points = ev.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("pos"))
    words = ev.where("event_type = 'click'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("word"))
    return J.asof_word(points, words, "user_id").select("event_id", "word")


@query(
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + 5 AS b FROM lineitem),
    f AS (SELECT l_orderkey AS k, CAST(l_discount * 500 AS BIGINT) AS frame, l_linenumber AS m FROM lineitem) SELECT f.k, f.m, s.n FROM f JOIN s ON f.k = s.k AND frame >= a AND frame < b"""
)
def j10_frames_in_span(spark, d):
    li = table(spark, d, "lineitem")
    spans = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("bigint").alias("start"), (F.col("l_quantity").cast("bigint") + 5).alias("stop"))
    points = li.select(F.col("l_orderkey").alias("k"), F.round(F.col("l_discount") * 500).cast("bigint").alias("frame"), F.col("l_linenumber").alias("m"))
    return J.frames_in_span(points, spans, "k", width=16).select("k", "m", "n")


@query(
    """WITH h AS (SELECT vec_id, label, md5('0:' || vec_id) AS h FROM embeddings)
    SELECT vec_id AS id, label, coalesce(lead(vec_id) OVER w, first_value(vec_id) OVER w) AS partner FROM h WINDOW w AS (PARTITION BY label ORDER BY h, vec_id)"""
)
def j11_positive_pair(spark, d):
    return J.positive_pair(table(spark, d, "embeddings"), "label", "vec_id")


def hashed_sql(seed: int, x: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {x}), 1, 15))::BIGINT"


def negatives_sql(rows: str, seed: int) -> str:
    """np(id, voice, partner, other_key) of rows(id, voice)."""
    return f"""nr AS (SELECT id, voice, row_number() OVER (PARTITION BY voice ORDER BY {hashed_sql(seed, 'id')}, id) - 1 AS n, {hashed_sql(seed + 1, 'id')} AS draw FROM {rows}),
    nk AS (SELECT voice, count(*) AS size, row_number() OVER (ORDER BY voice) - 1 AS k, count(*) OVER () AS keys FROM {rows} GROUP BY 1),
    no AS (SELECT nr.*, (k + 1 + draw % greatest(keys - 1, 1)) % keys AS other FROM nr JOIN nk USING (voice) WHERE keys > 1),
    np AS (SELECT no.id, no.voice, t.id AS partner, t.voice AS other_key FROM no JOIN nk o ON o.k = no.other JOIN nr t ON t.voice = o.voice AND t.n = (no.draw // 65536) % o.size)"""


@query(f"WITH i AS (SELECT vec_id AS id, label AS voice FROM embeddings), {negatives_sql('i', 0)} SELECT i.id, i.voice AS label, partner, other_key FROM i LEFT JOIN np USING (id)")
def j12_negative_pair(spark, d):
    """Each vector has a partner of another label."""
    return J.negative_pair(table(spark, d, "embeddings"), "label", "vec_id").select("id", "label", "partner", "other_key")


@query("SELECT doc_id, n_name FROM documents, nation")
def j13_grid(spark, d):
    return J.grid(docs(spark, d).select("doc_id"), table(spark, d, "nation").select("n_name"))


@query(
    """WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS i FROM documents)
    SELECT a.i // 2 AS pair, a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.i < 240"""
)
def j14_control_pairs(spark, d):
    return J.control_pairs(docs(spark, d), "doc_id")


@query(
    f"""WITH {LONG}, x AS (SELECT utt AS k, dim AS frame, value FROM f WHERE utt % 2 = 0), y AS (SELECT utt - 1 AS k, dim AS frame, value FROM f WHERE utt % 2 = 1),
    r AS (SELECT x.k, s.shift, corr(x.value, y.value) AS rho FROM x, (SELECT unnest(range(-3, 4)) AS shift) s JOIN y ON y.k = x.k AND y.frame = x.frame + s.shift GROUP BY ALL HAVING count(*) >= 20)
    SELECT k, round(max(rho), 6) AS rho FROM r GROUP BY k"""
)
def j15_best_shift(spark, d):
    f = frames(spark, d).select("utt", F.col("dim").alias("frame"), "value")
    a = f.where("utt % 2 = 0").withColumnRenamed("utt", "k")
    b = f.where("utt % 2 = 1").select((F.col("utt") - 1).alias("k"), "frame", "value")
    return r6(J.best_shift(a, b, "k", 3).select("k", "rho"), "rho")


@query("SELECT conv_id, turn, coalesce(lag(text) OVER w, last_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def j16_shuffled_control(spark, d):
    return J.shuffled_control(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "other_text")


# --- aggregations (A) -------------------------------------------------------------------------------


@query(f"WITH {RECORDS} SELECT teacher, count(*) AS n, round(sum(duration_s) / 60, 6) AS minutes FROM r GROUP BY 1")
def a2_teacher_minutes(spark, d):
    return r6(A.teacher_minutes(records(spark, d)), "minutes")


@query("SELECT source AS teacher, CAST(count(*) AS DOUBLE) AS weight, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def a3_effective_mix(spark, d):
    return r6(A.effective_mix(docs(spark, d).withColumnRenamed("source", "teacher")), "share")


@query(f"WITH {LONG} SELECT voice, dim, round(avg(value), 6) AS mean, round(greatest(stddev_samp(value), 1e-6), 6) AS std, count(*) AS n FROM f GROUP BY ALL HAVING count(DISTINCT utt) >= 4")
def a4_voice_norm(spark, d):
    return r6(A.group_stats(frames(spark, d), ["voice", "dim"], support="utt", least=4), "mean", "std").select("voice", "dim", "mean", "std", "n")


@query(
    f"""WITH {LONG}, m AS (SELECT voice FROM f GROUP BY 1 HAVING count(DISTINCT source) > 1)
    SELECT voice, -1 AS source, dim, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM f GROUP BY voice, dim
    UNION ALL SELECT voice, source, dim, round(avg(value), 6), round(stddev_samp(value), 6), count(*) FROM f SEMI JOIN m USING (voice) GROUP BY voice, source, dim"""
)
def a5_voice_source_norm(spark, d):
    return r6(A.voice_source_stats(frames(spark, d)), "mean", "std").select("voice", F.coalesce("source", F.lit(-1)).alias("source"), "dim", "mean", "std", "n")


@query(f"WITH {LONG} SELECT dim, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var, count(*) AS n FROM f GROUP BY 1")
def a6_population_norm(spark, d):
    return r6(A.population_norm(frames(spark, d)), "mean", "var")


@query(
    f"""WITH {LONG}, b AS (SELECT utt % 8 AS batch, dim, avg(value) AS m, var_pop(value) AS v FROM f GROUP BY ALL)
    SELECT dim, round(list_reduce(list(m ORDER BY batch), lambda a, x: a * 0.99::DOUBLE + x * 0.01::DOUBLE), 6) AS mean, round(list_reduce(list(v ORDER BY batch), lambda a, x: a * 0.99::DOUBLE + x * 0.01::DOUBLE), 6) AS var FROM b GROUP BY 1"""
)
def a7_ema_norm(spark, d):
    by = frames(spark, d).groupBy((F.col("utt") % 8).alias("batch"), "dim").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return r6(A.ema_norm(by), "mean", "var")


@query(
    f"""WITH {LONG}, s AS (SELECT voice, dim, avg(value) AS m, stddev_samp(value) AS sd FROM f GROUP BY ALL), n AS (SELECT voice, (value - m) / sd AS v FROM f JOIN s USING (voice, dim))
    SELECT voice, round(stddev_samp(v), 6) AS std, round(abs(stddev_samp(v) - 1), 6) AS error, abs(stddev_samp(v) - 1) <= 0.15 AS ok FROM n GROUP BY 1"""
)
def a8_scale_check(spark, d):
    f = frames(spark, d)
    normed = J.apply_norm(f, A.group_stats(f.limit(0), ["voice", "source", "dim"]), A.group_stats(f, ["voice", "dim"]))
    return r6(A.scale_check(normed), "std", "error")


@query("SELECT CAST(len(embedding) AS INT) AS width, count(*) AS n FROM embeddings GROUP BY 1")
def a9_distinct_widths(spark, d):
    return A.distinct_widths(table(spark, d, "embeddings"), "embedding")


@query("SELECT lower(trim(text, ' ')) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a10_duplicates(spark, d):
    return A.duplicates(docs(spark, d), T.match_key(F.col("text"), "strip"))


@query(f"WITH {RECORDS} SELECT round(sum(duration_s) / 3600, 6) AS hours, round(quantile_cont(duration_s, 0.5), 6) AS median, round(min(duration_s), 6) AS min, round(max(duration_s), 6) AS max, count(*) FILTER (duration_s < 3 OR duration_s > 30) AS out_of_range FROM r")
def a11_durations(spark, d):
    return r6(A.duration_summary(records(spark, d)), "hours", "median", "min", "max")


@query("SELECT l_orderkey, l_linenumber FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem) WHERE l_extendedprice BETWEEN lo AND hi")
def a12_trim(spark, d):
    return A.trim_by_quantile(table(spark, d, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber")


@query("SELECT user_id, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.9)::BIGINT) + 1] AS p90, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY 1")
def a13_ranks(spark, d):
    ranks = A.order_statistics(table(spark, d, "events"), ("user_id",), F.col("value"), {"p90": A.nearest_rank(90), "upper_median": A.upper_median()})
    return ranks.select("user_id", "p90", "upper_median")


@query(
    f"""WITH {SERIES}, p AS (SELECT a.voice, a.dim, a.value AS x, b.value AS y FROM z a JOIN z b ON b.utt = a.utt + 1 AND a.dim = b.dim AND a.frame = b.frame),
    c AS (SELECT voice, dim, corr(x, y) AS r FROM p GROUP BY ALL HAVING stddev_samp(x) >= 1e-6 AND stddev_samp(y) >= 1e-6) SELECT voice, round(avg(r), 6) AS rho, count(*) AS dims FROM c GROUP BY 1"""
)
def a15_per_dim_rho(spark, d):
    z = series(spark, d)
    other = z.select((F.col("utt") - 1).alias("utt"), "dim", "frame", "value")
    pairs = J.zip_min(z, other, ["utt", "dim", "frame"]).join(z.select("utt", "voice").distinct(), "utt")
    return r6(A.per_dim_rho(pairs, ["voice"]), "rho")


def bootstrap_sql(rows: str, draws: int) -> str:
    """ci(g, low, high) of rows(g, k, v) by Poisson resampling; k is hashed."""
    p, upto, total = 0.36787944117144233, [], 0.0
    for k in range(8):
        total += p
        upto.append(repr(total))
        p /= k + 1
    times = " + ".join(f"(u >= {t})::INT" for t in upto)
    return f"""{_steps_sql("salts AS (SELECT range::UBIGINT AS x, range AS draw FROM range(1, " + str(draws + 1) + "))")},
    hk AS (SELECT g, v, ('0x' || substr(md5('0:' || k), 1, 15))::UBIGINT AS h FROM {rows} WHERE v IS NOT NULL),
    {_steps_sql("crossed AS (SELECT g, v, draw, xor(h, salts_m.x) AS x FROM hk, salts_m)")},
    w AS (SELECT g, v, draw, {times} AS t FROM (SELECT g, v, draw, (x >> 11)::DOUBLE * 1.1102230246251565e-16 AS u FROM crossed_m)),
    ms AS (SELECT g, draw, sum(v * t) / sum(t) AS m FROM w GROUP BY ALL HAVING sum(t) > 0),
    ci AS (SELECT g, s[least(floor(len(s) * 0.025)::INT + 1, len(s))] AS low, s[least(floor(len(s) * 0.975)::INT + 1, len(s))] AS high FROM (SELECT g, list(m ORDER BY m) AS s FROM ms GROUP BY 1))"""


def _steps_sql(cte: str) -> str:
    """cte (name AS (... x ...)) and name_m, with x mixed in four steps so that no step is written twice."""
    name = cte.split(" ", 1)[0]
    half = "((x::UHUGEINT * {0}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""{cte}, {name}_1 AS (SELECT * REPLACE (xor(x, x >> 30) AS x) FROM {name}), {name}_2 AS (SELECT * REPLACE ({half.format('13787848793156543929')} AS x) FROM {name}_1),
    {name}_3 AS (SELECT * REPLACE (xor(x, x >> 27) AS x) FROM {name}_2), {name}_4 AS (SELECT * REPLACE ({half.format('10723151780598845931')} AS x) FROM {name}_3), {name}_m AS (SELECT * REPLACE (xor(x, x >> 31) AS x) FROM {name}_4)"""


@query(
    f"""WITH e AS (SELECT event_type AS g, event_id AS k, value AS v FROM events), {bootstrap_sql('e', 400)}
    SELECT g AS event_type, round(avg(v), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM e JOIN ci USING (g) GROUP BY 1"""
)
def a16_bootstrap(spark, d):
    """By type: the mean and its bootstrap interval."""
    return r6(A.bootstrap_ci(table(spark, d, "events"), "value", "event_id", 400, by=("event_type",)), "mean", "low", "high")


@query("SELECT l_returnflag, round(avg(l_tax - 0.04), 6) AS mean, round(stddev_samp(l_tax - 0.04), 6) AS std, round(min(l_tax - 0.04), 6) AS min, round(max(l_tax - 0.04), 6) AS max, count(*) AS n, avg(l_tax - 0.04) - stddev_samp(l_tax - 0.04) <= 0 AND avg(l_tax - 0.04) + stddev_samp(l_tax - 0.04) >= 0 AS straddles_zero FROM lineitem GROUP BY 1")
def a17_spread(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_tax") - 0.04).alias("value"))
    return r6(A.spread_summary(rows, ["l_returnflag"]).drop("each"), "mean", "std", "min", "max")


@query("WITH s AS (SELECT l_linenumber, avg(l_quantity) AS m, max(l_quantity) - min(l_quantity) AS s FROM lineitem GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd_between, round(max(s), 6) AS spread_within, count(*) AS steps FROM s")
def a18_plateau(spark, d):
    return r6(A.plateau(table(spark, d, "lineitem"), "l_linenumber", "l_quantity"), "mean", "sd_between", "spread_within")


@query(
    """WITH s AS (SELECT l_linenumber, avg(l_tax) FILTER (l_returnflag = 'A') AS a, avg(l_tax) FILTER (l_returnflag = 'R') AS b, max(l_tax) FILTER (l_returnflag = 'A') - min(l_tax) FILTER (l_returnflag = 'A') AS sa,
    max(l_tax) FILTER (l_returnflag = 'R') - min(l_tax) FILTER (l_returnflag = 'R') AS sb FROM lineitem GROUP BY 1)
    SELECT l_linenumber, round(b - a, 6) AS delta, round(greatest(sa, sb), 6) AS spread, CASE WHEN abs(b - a) > greatest(sa, sb) THEN 'SEPARATED' WHEN b - a IS NOT NULL THEN 'inside the spread' ELSE 'no data' END AS verdict FROM s"""
)
def a19_run_verdict(spark, d):
    return r6(A.run_verdict(table(spark, d, "lineitem"), "l_returnflag", "A", "R", ["l_linenumber"], "l_tax"), "delta", "spread")


@query(
    """WITH a AS (SELECT l_linenumber AS k, avg(l_discount) AS m, stddev_samp(l_discount) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linenumber AS k, avg(l_discount) AS m, stddev_samp(l_discount) AS s FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber > 2 GROUP BY 1)
    SELECT k, round(b.m - a.m, 6) AS delta, round(greatest(a.s, b.s), 6) AS spread, CASE WHEN a.m IS NULL OR b.m IS NULL THEN 'partial' WHEN abs(b.m - a.m) < greatest(a.s, b.s) / 2 THEN 'unresolved' WHEN b.m > a.m THEN 'better' ELSE 'worse' END AS verdict FROM a FULL JOIN b USING (k)"""
)
def a20_arm_verdict(spark, d):
    arm = lambda cond: table(spark, d, "lineitem").where(cond).groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_discount").alias("mean"), F.stddev_samp("l_discount").alias("spread"))
    return r6(A.arm_verdict(arm("l_returnflag = 'A'"), arm("l_returnflag = 'N' AND l_linenumber > 2"), "k"), "delta", "spread")


BUDGET = """
    u AS (SELECT utt, voice, dim, avg(value) AS mu FROM {z} GROUP BY ALL), v AS (SELECT voice, dim, avg(mu) AS mv FROM u GROUP BY ALL), g AS (SELECT dim, avg(mu) AS mg FROM u GROUP BY ALL),
    l AS (SELECT *, lag(value) OVER (PARTITION BY utt, dim ORDER BY frame) AS p FROM {z}), a AS (SELECT utt, dim, sum(value * p) / sum(p * p) AS a FROM l GROUP BY ALL),
    j AS (SELECT l.*, mu, mv, mg, coalesce(a.a * p, value) AS ar FROM l JOIN u USING (utt, voice, dim) JOIN v USING (voice, dim) JOIN g USING (dim) LEFT JOIN a USING (utt, dim))
    SELECT round(1 - sum((value - mg) ^ 2) / sum(value * value), 6) AS r2_global, round(1 - sum((value - mv) ^ 2) / sum(value * value), 6) AS r2_voice, round(1 - sum((value - mu) ^ 2) / sum(value * value), 6) AS r2_utterance,
      round(1 - sum((value - ar) ^ 2) / sum(value * value), 6) AS r2_ar1, round(sum((value - ar) ^ 2) / sum(value * value), 6) AS residual, count(*) AS n FROM j"""


@query(f"WITH {SERIES}, {BUDGET.format(z='z')}")
def a21_variance_budget(spark, d):
    return r6(A.variance_budget(series(spark, d)), "r2_global", "r2_voice", "r2_utterance", "r2_ar1", "residual")


@query(f"WITH {SERIES}, w AS (SELECT utt, voice, dim * 2 + frame % 2 AS dim, frame // 2 AS frame, value FROM z), {BUDGET.format(z='w')}")
def a22_folded_budget(spark, d):
    return r6(A.variance_budget(A.folded(series(spark, d), 2)), "r2_global", "r2_voice", "r2_utterance", "r2_ar1", "residual")


@query(
    f"""WITH {LONG}, l AS (SELECT utt, value AS x, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 4) OVER w AS l4 FROM f WINDOW w AS (PARTITION BY utt ORDER BY dim)),
    r AS (SELECT utt, unnest([1, 2, 4]) AS lag, unnest([corr(x, l1), corr(x, l2), corr(x, l4)]) AS r FROM l GROUP BY utt) SELECT lag, round(avg(r), 6) AS rho, count(*) AS series FROM r WHERE r IS NOT NULL GROUP BY 1"""
)
def a23_autocorrelation(spark, d):
    f = frames(spark, d).select("utt", F.lit(0).alias("dim"), F.col("dim").alias("frame"), "value")
    return r6(A.autocorrelation(f, [1, 2, 4]), "rho")


@query(
    f"""WITH {SERIES}, l AS (SELECT dim, value AS x, lag(value) OVER (PARTITION BY utt, dim ORDER BY frame) AS p FROM z), k AS (SELECT * FROM l WHERE p IS NOT NULL),
    a AS (SELECT dim, sum(x * p) AS xp, sum(p * p) AS pp, sum(x * x) AS b, least(greatest(sum(x * p) / sum(p * p), 0), 2) AS alpha FROM k GROUP BY 1) SELECT dim, round(alpha, 6) AS alpha, round(b, 6) AS before, round(b - 2 * alpha * xp + alpha * alpha * pp, 6) AS after FROM a"""
)
def a24_regression(spark, d):
    from pyspark.sql import Window

    rows = series(spark, d).select("dim", F.col("value").alias("x"), F.lag("value").over(Window.partitionBy("utt", "dim").orderBy("frame")).alias("p")).where("p IS NOT NULL")
    return r6(A.regression(rows), "alpha", "before", "after")


@query("SELECT l_suppkey, round(sum(l_extendedprice * greatest(l_discount, 0.01)) / sum(greatest(l_discount, 0.01)), 4) AS mean, round(avg(greatest(l_discount, 0.01)), 6) AS mean_weight FROM lineitem GROUP BY 1")
def a28_weighted_mean(spark, d):
    out = A.weighted_mean(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_discount", 0.01)
    return out.select("l_suppkey", F.round("mean", 4).alias("mean"), F.round("mean_weight", 6).alias("mean_weight"))


@query("SELECT l_suppkey, round(avg(abs(l_tax - l_discount)) FILTER (l_linenumber < 4), 6) AS l1, round(avg((l_tax - l_discount) ^ 2) FILTER (l_linenumber < 4), 6) AS mse, count(*) FILTER (l_linenumber < 4) AS valid FROM lineitem GROUP BY 1")
def a29_masked_errors(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_tax").alias("pred"), F.col("l_discount").alias("true"), (F.col("l_linenumber") < 4).alias("valid"))
    return r6(A.masked_errors(rows, "l_suppkey"), "l1", "mse")


@query(
    """WITH c AS (SELECT l_suppkey, l_tax - avg(l_tax) OVER w AS a, l_discount - avg(l_discount) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_linenumber)) SELECT l_suppkey, round(avg((a - b) ^ 2), 6) AS mse FROM c GROUP BY 1"""
)
def a30_centred_mse(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("dim"), F.col("l_tax").alias("pred"), F.col("l_discount").alias("true"))
    return r6(A.centred_mse(rows, "l_suppkey"), "mse")


@query(
    """WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9'' ]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM conversations),
    p AS (SELECT a.w AS a, b.w AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    e AS (SELECT len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) + abs(len(a) - len(b)) AS e, greatest(len(a), 1) AS n FROM p) SELECT round(sum(e) / sum(n), 6) AS wer, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS words FROM e"""
)
def a36_corpus_wer(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp")), ["conv_id", "turn"])
    return r6(A.corpus_wer(pairs, "text", "hyp"), "wer")


@query(
    """SELECT event_id AS claim, props->>'$.k' AS measured, CASE WHEN CAST(props->>'$.k' AS DOUBLE) IS NULL THEN 'unmeasured' WHEN CAST(props->>'$.k' AS DOUBLE) >= value THEN 'pass' ELSE 'fail' END AS outcome FROM events"""
)
def a37_claims(spark, d):
    ev = table(spark, d, "events")
    claims = ev.select(F.col("event_id").alias("claim"), F.col("event_id").alias("report"), F.lit("k").alias("field"), F.lit(">=").alias("op"), F.col("value").alias("bound"), F.lit(None).cast("string").alias("other_field"))
    return A.evaluate_claims(claims, ev.select(F.col("event_id").alias("report"), F.col("props").alias("json"))).select("claim", "measured", "outcome")


@query(
    """WITH e AS (SELECT user_id AS u, event_id, event_type, value FROM events),
    r AS (SELECT u, count(*) AS n, min(value) AS low, max(value) AS high, bool_or(event_type = 'click') AS click, bool_or(event_type = 'error') AS error, arg_min(value, event_id) AS first,
            arg_max(event_id, struct_pack(v := value, i := -event_id)) AS top, arg_min(value, event_id) FILTER (event_type = 'purchase') AS bought FROM e GROUP BY 1),
    c AS (SELECT u, 'max' AS kind, high AS m, high >= 90 AS ok, NULL AS detail FROM r UNION ALL SELECT u, 'max_id', top, top >= 5000, NULL FROM r
      UNION ALL SELECT u, 'match', bought, bought <= 50, CASE WHEN bought IS NULL THEN 'no row matched: kind=purchase' END FROM r UNION ALL SELECT u, 'first', first, first >= 20, NULL FROM r
      UNION ALL SELECT u, 'sum', low + high, low + high <= 100, NULL FROM r UNION ALL SELECT u, 'sum_absent', NULL, NULL, 'missing fields: low, nope' FROM r
      UNION ALL SELECT u, 'checks', NULL, click AND error, concat(click::INT + error::INT, ' of 2', CASE WHEN NOT click AND NOT error THEN '; failing: click, error' WHEN NOT click THEN '; failing: click' WHEN NOT error THEN '; failing: error' END) FROM r
      UNION ALL SELECT u, 'less', low, low < n, NULL FROM r UNION ALL SELECT u, 'absent', NULL, NULL, 'no field nope' FROM r)
    SELECT u || '/' || kind AS claim, round(CAST(CASE WHEN u % 5 < 4 THEN m END AS DOUBLE), 6) AS measured, CASE WHEN u % 5 = 4 OR ok IS NULL THEN 'unmeasured' WHEN ok THEN 'pass' ELSE 'fail' END AS outcome,
      CASE WHEN u % 5 < 2 THEN 'new/' || u WHEN u % 5 < 4 THEN 'old/' || u END AS report_used, CASE WHEN u % 5 < 2 THEN 0 WHEN u % 5 < 4 THEN 1 ELSE 2 END AS missing,
      CASE WHEN u % 5 = 4 THEN 'no report: new/' || u || ', old/' || u ELSE detail END AS detail FROM c"""
)
def a37_claim_kinds(spark, d):
    """Every kind of claim about a report of each user's events; reports have two candidates, of which one, both or none exist."""
    ev = table(spark, d, "events").select(F.col("user_id").alias("u"), "event_id", F.col("event_type").alias("kind"), "value")
    row = F.struct(F.col("event_id").alias("id"), "kind", F.col("value").alias("seconds"))
    checks = F.struct(F.bool_or(F.col("kind") == "click").alias("click"), F.bool_or(F.col("kind") == "error").alias("error"))
    by = ev.groupBy("u").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), checks.alias("checks"))
    by = by.select("u", F.to_json(F.struct(F.struct("rows", "checks").alias("a"), "n", "low", "high")).alias("json"))
    where = F.when(F.col("u") % 5 < 2, F.array(F.lit("new/"), F.lit("old/"))).when(F.col("u") % 5 < 4, F.array(F.lit("old/"))).otherwise(F.array().cast("array<string>"))
    reports = by.select(F.explode(where).alias("at"), "u", "json").select(F.concat("at", F.col("u").cast("string")).alias("report"), "json")
    kinds = spark.sql(
        """SELECT * FROM VALUES ('max', 'a.rows', 'max_seconds', 'seconds', NULL, '>=', 90D, NULL), ('max_id', 'a.rows', 'max_seconds', 'id', NULL, '>=', 5000D, NULL), ('match', 'a.rows', 'kind=purchase', 'seconds', NULL, '<=', 50D, NULL),
        ('first', 'a.rows', '', 'seconds', NULL, '>=', 20D, NULL), ('sum', NULL, NULL, NULL, array('low', 'high'), '<=', 100D, NULL), ('sum_absent', NULL, NULL, NULL, array('low', 'nope'), '<=', 100D, NULL),
        ('checks', NULL, NULL, 'a.checks', NULL, 'all_true', NULL, NULL), ('less', NULL, NULL, 'low', NULL, 'lt_field', NULL, 'n'), ('absent', NULL, NULL, 'nope', NULL, '==', 1D, NULL)
        AS t(kind, list_field, select, field, fields, op, bound, other_field)"""
    )
    claims = by.select("u").crossJoin(F.broadcast(kinds))  # nine rows
    name = F.col("u").cast("string")
    claims = claims.withColumn("claim", F.concat_ws("/", name, "kind")).withColumn("reports", F.array(F.concat(F.lit("new/"), name), F.concat(F.lit("old/"), name))).drop("u", "kind")
    out = A.evaluate_claims(claims, reports)
    return out.select("claim", F.round(F.col("measured").try_cast("double"), 6).alias("measured"), "outcome", "report_used", F.size("missing").alias("missing"), "detail")


@query(
    """SELECT l_linenumber AS holdout, 'mae' AS metric, round(avg(l_tax) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_tax) FILTER (l_returnflag = 'R'), 6) AS R, bool_and(coalesce(l_discount < 0.1, false)) AS controls_ok,
    CASE WHEN avg(l_tax) FILTER (l_returnflag = 'A') < avg(l_tax) FILTER (l_returnflag = 'R') THEN 'A' ELSE 'R' END AS best FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1"""
)
def a38_compare_arms(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").select(F.col("l_linenumber").alias("holdout"), F.lit("mae").alias("metric"), F.col("l_returnflag").alias("arm"), F.col("l_tax").alias("value"), F.col("l_discount").alias("control"))
    return r6(A.compare_arms(rows, ["A", "R"], 0.1), "A", "R")


@query("SELECT l_returnflag AS component, round(100 * (avg(l_tax) - avg(l_discount)) / greatest(avg(l_discount), 1e-9), 6) AS percent, count(*) AS n FROM lineitem GROUP BY 1")
def a41_permutation_share(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("component"), F.col("l_tax").alias("shuffled"), F.col("l_discount").alias("right"))
    return r6(A.permutation_share(rows), "percent")


@query("SELECT source AS corpus, count(*) AS records, count(DISTINCT lower(trim(text, ' '))) AS unique_texts, count(DISTINCT lang) AS voices, count(*) FILTER (lower(trim(text, ' ')) IN (SELECT lower(trim(text, ' ')) FROM benchmark)) AS held_out FROM documents GROUP BY 1")
def a42_census(spark, d):
    rows = docs(spark, d).select(F.col("source").alias("corpus"), "text", F.col("lang").alias("voice"))
    return A.census(rows, table(spark, d, "benchmark"))


# --- windows, schedules and splits (W) --------------------------------------------------------------


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def w7_gap_sessions(spark, d):
    out = W.gap_sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first"), "n")


def segments_sql(words: str, name: str, min_s: str, max_s: str, gap_s: str) -> str:
    """{name}(key, n, first, last, s, e): segments of words(key, i, s, e), i from 1, by greedy cuts and a merge of short ones."""
    return f"""{name}0 AS (SELECT key, i, 0 AS g, s AS gs, e AS ge FROM {words} WHERE i = 1
      UNION ALL SELECT w.key, w.i, CASE WHEN cut THEN g + 1 ELSE g END, CASE WHEN cut THEN w.s ELSE gs END, w.e FROM (
        SELECT r.key, r.i, g, gs, ((w.s - ge >= {gap_s} AND ge - gs >= {min_s}) OR w.e - gs > {max_s}) AS cut FROM {name}0 r JOIN {words} w ON w.key = r.key AND w.i = r.i + 1) x JOIN {words} w ON w.key = x.key AND w.i = x.i + 1),
    {name}1 AS (SELECT key, g, min(i) AS first, max(i) AS last, min(gs) AS s, arg_max(ge, i) AS e FROM {name}0 GROUP BY key, g),
    {name}2 AS (SELECT *, sum(CASE WHEN g = 0 OR e - s >= {min_s} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY g) - 1 AS n FROM {name}1),
    {name} AS (SELECT key, n, min(first) AS first, max(last) AS last, arg_min(s, g) AS s, arg_max(e, g) AS e FROM {name}2 GROUP BY key, n)"""


#: Events as timed words w(key, i, s, e, word), an hour for a second.
HOURS = "w AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6::DOUBLE / 3600 AS s, epoch_us(ts) / 1e6::DOUBLE / 3600 + 0.05::DOUBLE AS e, event_type AS word FROM events)"


def hours(spark, d):
    """key, start, end, word: events as timed words, an hour for a second."""
    from millrace.plans.adapters import timed

    return timed(spark, d).select("key", (F.col("start") / 3600).alias("start"), (F.col("start") / 3600 + 0.05).alias("end"), "word")


@query(f"WITH RECURSIVE {HOURS}, {segments_sql('w', 'g', '3.0', '15.0', '6.0')} SELECT key, n, round(s, 4) AS start, round(e, 4) AS end, last - first + 1 AS words FROM g")
def w7_segments(spark, d):
    """Greedy segments of 3 to 15 seconds."""
    segs = W.segment_recordings(hours(spark, d), "key", gap_s=6.0)
    return segs.select("key", "n", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.size("words").alias("words"))


#: Segments longer than 15 seconds cut by the cap alone, or else in equal slices.
LONG_SPLIT = f"""{segments_sql('w', 'g', '3.0', '15.0', '6.0')},
    lo AS (SELECT g.key || '_' || g.n AS key, g.s, g.e, g.key AS k, g.n FROM g WHERE e - s > 15),
    ow AS (SELECT lo.key, row_number() OVER (PARTITION BY lo.key ORDER BY w.i) AS i, w.s, w.e, w.word FROM lo JOIN w ON w.key = lo.k AND w.s >= lo.s - 1e-6 AND w.s < lo.e),
    {segments_sql('ow', 'h', '15.0 / 4', '15.0', '1e9')},
    cu AS (SELECT key, count(*) AS c FROM h GROUP BY 1), wc AS (SELECT key, count(*) AS c FROM ow GROUP BY 1),
    eq AS (SELECT lo.*, greatest(CAST(ceil((e - s) / 15) AS INT), 2) AS m FROM lo JOIN cu USING (key) JOIN wc USING (key) WHERE cu.c < 2 AND wc.c >= 2),
    sl AS (SELECT key, k, n, s + j * ((e - s) / m) AS s, s + (j + 1) * ((e - s) / m) AS e FROM (SELECT *, unnest(range(m)) AS j FROM eq)),
    pieces AS (SELECT g.key AS k, g.n, g.s, g.e, g.last - g.first + 1 AS words FROM g WHERE e - s <= 15
      UNION ALL SELECT lo.k, lo.n, lo.s, lo.e, wc.c FROM lo JOIN wc USING (key) WHERE wc.c < 2
      UNION ALL SELECT lo.k, lo.n, h.s, h.e, h.last - h.first + 1 FROM lo JOIN h USING (key) JOIN cu USING (key) JOIN wc USING (key) WHERE cu.c >= 2 AND wc.c >= 2
      UNION ALL SELECT sl.k, sl.n, sl.s, sl.e, (SELECT CASE WHEN count(*) = 0 THEN (SELECT c FROM wc WHERE wc.key = sl.key) ELSE count(*) END FROM ow WHERE ow.key = sl.key AND ow.s >= sl.s AND ow.s < sl.e) FROM sl)"""


@query(f"WITH RECURSIVE {HOURS}, {LONG_SPLIT} SELECT k AS key, n, round(s, 4) AS start, round(e, 4) AS end, words FROM pieces")
def w8_split_segments(spark, d):
    cut = W.split_recordings(W.segment_recordings(hours(spark, d), "key", gap_s=6.0), "key", 15.0)
    return cut.select("key", "n", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.size(F.split("text", " ")).alias("words"))


@query("SELECT event_id, round(coalesce((epoch_us(lag(ts) OVER w) / 1e6 + epoch_us(ts) / 1e6) / 2, epoch_us(ts) / 1e6), 3) AS l, round(coalesce((epoch_us(lead(ts) OVER w) / 1e6 + epoch_us(ts) / 1e6) / 2, epoch_us(ts) / 1e6), 3) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def w12_midpoints(spark, d):
    from millrace.plans.adapters import timed

    rows = timed(spark, d).withColumn("end", F.col("start"))
    return W.extend_to_midpoints(rows, "key").select("event_id", F.round("left", 3).alias("l"), F.round("right", 3).alias("r"))


@query("SELECT lang, row_number() OVER (ORDER BY min(doc_id), lang) - 1 AS idx FROM documents GROUP BY 1")
def w14_dense_index(spark, d):
    return W.dense_index(docs(spark, d), "lang", "doc_id")


@query("SELECT doc_id, ['a', 'b', 'c'][doc_id % 3 + 1] AS voice, CASE WHEN doc_id * 0.61803398875 - floor(doc_id * 0.61803398875) < 0.4 THEN 'x' WHEN doc_id * 0.61803398875 - floor(doc_id * 0.61803398875) < 0.6 THEN 'y' ELSE 'z' END AS teacher FROM documents")
def w16_schedule(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", W.assign_voice(i, ["a", "b", "c"]).alias("voice"), W.schedule(i, [("x", 0.4), ("y", 0.2), ("z", 0.4)]).alias("teacher"))


@query(
    f"""WITH {SERIES}, l AS (SELECT *, lag(value) OVER (PARTITION BY utt, dim ORDER BY frame) AS p FROM z), s AS (SELECT utt, dim, avg(value) AS m, covar_pop(value, p) / (var_pop(p) FILTER (p IS NOT NULL)) AS a FROM l GROUP BY ALL)
    SELECT utt, dim, frame, round(coalesce(m + coalesce(a, 0) * (p - m), value), 6) AS predicted FROM l JOIN s USING (utt, dim)"""
)
def w17_ar1(spark, d):
    return r6(W.ar1(series(spark, d), ["utt", "dim"], "frame", "value").select("utt", "dim", "frame", "predicted"), "predicted")


@query(
    """WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1:2:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, i // 32 AS batch, i % 32 AS slot FROM h WHERE i < n // 32 * 32 AND i // 32 >= 3"""
)
def w18_epoch_batches(spark, d):
    return W.epoch_batches(docs(spark, d).select("doc_id"), "doc_id", 32, 1, 2, position=3)


@query(
    """WITH t AS (SELECT conv_id, turn, [length(text), turn] AS ids FROM conversations), m AS (SELECT conv_id, max(len(ids)) AS w FROM t GROUP BY 1)
    SELECT conv_id, list(ids ORDER BY turn) AS ids, list(len(ids) ORDER BY turn) AS lengths FROM t JOIN m USING (conv_id) GROUP BY 1"""
)
def w19_pad_batch(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array(F.length("text"), F.col("turn").cast("int")).alias("ids"))
    return W.pad_batch(rows, "conv_id", "turn", "ids").select("conv_id", "ids", "lengths")


@query("SELECT doc_id, CASE WHEN dense_rank() OVER (ORDER BY text) <= 100 THEN 'val' ELSE 'train' END AS split FROM documents")
def w20_split_by_text(spark, d):
    return W.split_by_text(docs(spark, d).select("doc_id", "text"), "text", 100).select("doc_id", "split")


@query(
    """WITH g AS (SELECT source AS g, count(*) AS n, md5('0:' || source) AS h FROM documents GROUP BY 1), k AS (SELECT g, sum(n) OVER (ORDER BY h, g) - n AS before FROM g)
    SELECT doc_id, CASE WHEN before < 150 THEN 'val' ELSE 'train' END AS split FROM documents JOIN k ON source = g"""
)
def w21_split_by_group(spark, d):
    return W.split_by_group(docs(spark, d).select("doc_id", "source"), F.col("source"), 150).select("doc_id", "split")


# --- picks and sets (L, U) --------------------------------------------------------------------------


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 6")
def l2_top_groups(spark, d):
    return picks.top_groups(docs(spark, d), "source")


@query("SELECT doc_id, text FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 40")
def l4_sample(spark, d):
    return picks.sample_n(docs(spark, d).select("doc_id", "text"), "doc_id", 40, 3)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 13 = 0")
def l5_every_kth(spark, d):
    return picks.every_kth(docs(spark, d).select("doc_id"), "doc_id", 13)


@query("SELECT l_suppkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def l8_best_row(spark, d):
    return picks.best_row(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice")


@query("SELECT 'documents' AS corpus, doc_id AS id, text, lang FROM documents UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark")
def u1_union_corpora(spark, d):
    return sets.union_corpora({"documents": docs(spark, d).select(F.col("doc_id").alias("id"), "text", "lang"), "benchmark": table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")}).select("corpus", "id", "text", "lang")


@query("SELECT DISTINCT lower(trim(x, ' ')) AS key FROM (SELECT text AS x FROM benchmark UNION ALL SELECT text FROM conversations) WHERE trim(x, ' ') <> ''")
def u5_union_keys(spark, d):
    return sets.union_keys(table(spark, d, "benchmark").select("text"), table(spark, d, "conversations").select("text"))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 5)")
def u4_difference(spark, d):
    rows = docs(spark, d).select("doc_id", "source")
    return sets.difference(rows, rows.where("doc_id < 5"), "source")


# --- arrays and signals (F30 on) --------------------------------------------------------------------


@query(
    """WITH w AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings)
    SELECT vec_id, round(20 * log10(greatest(list_max([abs(v) for v in x]), 1e-8)), 6) AS peak_db, round(20 * log10(greatest(sqrt(list_sum([v * v for v in x]) / len(x)), 1e-8)), 6) AS rms_db, round(len([v for v in x if abs(v) >= 0.99]) / len(x), 6) AS clipping_ratio FROM w"""
)
def f30_levels(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", N.levels(F.col("embedding")).alias("l"))
    return r6(rows.select("vec_id", "l.peak_db", "l.rms_db", "l.clipping_ratio"), "peak_db", "rms_db", "clipping_ratio")


@query(
    """WITH w AS (SELECT a.vec_id, [CAST(x AS DOUBLE) for x in a.embedding] AS a, [CAST(x AS DOUBLE) for x in b.embedding] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine, round(sqrt(list_sum([(a[i] - b[i]) ^ 2 for i in range(1, 65)])) / sqrt(list_dot_product(a, a)), 6) AS convergence FROM w"""
)
def f54_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    out = both.select("vec_id", N.cosine(F.col("embedding"), F.col("other")).alias("cosine"), N.spectral_convergence(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>")).alias("convergence"))
    return r6(out, "cosine", "convergence")


@query(
    """WITH x AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1), y AS (SELECT user_id, v, unnest(range(len(v) // 8)) AS fold FROM x)
    SELECT user_id, fold, round(list_avg(v[fold * 8 + 1:fold * 8 + 8]), 8) AS mean FROM y"""
)
def f32_folded_means(spark, d):
    ev = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value")
    return W.folded_means(ev, "user_id", ("at", "event_id"), "value", 8).select("user_id", "fold", F.round("mean", 8).alias("mean"))


@query("SELECT event_id, round(greatest(coalesce(CASE event_type WHEN 'click' THEN 0.5 END, 1) * coalesce(value / 100, 1), 0.05), 6) AS weight FROM events")
def f49_sample_weight(spark, d):
    ev = table(spark, d, "events")
    return r6(ev.select("event_id", N.sample_weight(F.when(F.col("event_type") == "click", 0.5), F.col("value") / 100).alias("weight")), "weight")


#: Frames per token of energies e for n tokens: edges by energy and by place, each at least one further, all frames used.
FALLBACK = """c{0} AS (SELECT *, list_reduce(list_concat([[0.0::DOUBLE]], [[x] for x in e]), lambda a, x: list_append(a, a[-1] + x[1]))[2:] AS upto FROM {0}),
    g{0} AS (SELECT *, [CASE WHEN k = n THEN len(e) ELSE CAST(round_even((least(len([u for u in upto if u < k / n * greatest(list_max(upto), 1e-8)]), len(e)) + k / n * len(e)) / 2, 0) AS INT) END for k in range(1, n + 1)] AS edges FROM c{0}),
    r{0} AS (SELECT *, list_reduce(list_concat([[0]], [[x] for x in edges]), lambda a, x: list_append(a, least(greatest(x[1], a[-1] + 1), greatest(len(e) - (n - len(a)), a[-1])))) AS rising FROM g{0}),
    d{0} AS (SELECT *, [CAST(rising[k + 1] - rising[k] AS INT) for k in range(1, n + 1)] AS durations FROM r{0})"""


@query(f"WITH z AS (SELECT vec_id, [abs(CAST(x AS DOUBLE)) for x in embedding] AS e, 9 AS n FROM embeddings), {FALLBACK.format('z')} SELECT vec_id, durations FROM dz")
def f45_fallback_durations(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("e"))
    return e.select("vec_id", N.fallback_durations(F.col("e"), F.lit(9)).alias("durations"))
