"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, chat, crosstoken, exact_dedup, importance, langid, mixing, ngram_join, simhash, substring_dedup, toxicity, url_filter
from millrace.llm.common import job


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    job(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    past, new = exact_dedup.split_by_age(docs)
    out = exact_dedup.exact_dedup(new, past)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.remainder("doc_id", 4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    read = chat.read_back(chat.format_examples(rows.unionByName(more)))
    loss = F.array_join("losses", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.remainder("doc_id", 3) == 1
    crf = langid.train(docs.where(~held_out))
    return langid.predict(docs, crf).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), similarity=0.85, words=4)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return crosstoken.cross_tokenizer(table(spark, sf_dir, "documents"), a, public_tokenizers.PATTERN, b)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(10, 100), low=1, high=1, buckets=10_000, least=20, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_toxicity,
        op3_mixing,
        op4_substring_dedup,
        op5_ann,
        op6_url_filter,
        op7_chat,
        op8_bpe,
        op9_simhash,
        op10_langid,
        op11_ngram_join,
        op12_cross_tokenizer,
        op13_importance,
    )
}

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op3_mixing": r"""
        WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                          CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
              FROM d GROUP BY source),
        c AS (SELECT *, source_size * 2.0::DOUBLE AS top, source_size * 2.0::DOUBLE / w AS full_at FROM s),
        r AS (SELECT *, row_number() OVER (ORDER BY full_at, source NULLS LAST) AS i,
                     CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
                       - coalesce(sum(top) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                     sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
              FROM c),
        f AS (SELECT * FROM r WHERE rest <= full_at * w_rest ORDER BY i LIMIT 1),
        p AS (SELECT r.source, r.source_size, CASE WHEN f.i IS NULL OR r.i < f.i THEN r.top ELSE r.w * f.rest / f.w_rest END AS target
              FROM r LEFT JOIN f ON true),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p),
        o AS (SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS need,
                     sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (whole + CASE WHEN need > 0 AND (upto <= need OR (upto - size <= need AND upto - need < need - (upto - size)))
                    THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j, len(ws) AS n FROM d),
        i AS (SELECT doc_id, j AS i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS key
              FROM w QUALIFY j <= n - 12),
        k AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS low FROM i),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k WHERE low < doc_id),
        r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        t AS (SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS t FROM w ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_url_filter": rf"""
        WITH p AS (SELECT page_id,
                translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), '{UP}', '{LOW}') AS host,
                coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(h, p, verdict) AS (VALUES {", ".join(map(str, RULES))}),
        m AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
              FROM p JOIN r ON (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op7_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                     length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '(</?s>)', '\1.', 'g'), '(\[/?INST\])', '\1.', 'g'))
                       + length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '(</?s>|\n)', '\1.', 'g'), '(\[/?INST\])', '\1.', 'g'))
                       + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS shown
              FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        s AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op11_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS j, len(ws) AS n FROM d),
        i AS (SELECT doc_id, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS t FROM w QUALIFY j = 0 OR j <= n - 4),
        s AS (SELECT DISTINCT doc_id, hash(t) AS t FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        f AS (SELECT t FROM s GROUP BY 1 HAVING count(*) > 1),
        r AS (SELECT doc_id, t, n FROM s SEMI JOIN f USING (t) JOIN n USING (doc_id)),
        l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        z AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT z.x, u.y FROM z JOIN u ON z.y = u.x)
        SELECT z.x AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(z.y) AS component_id FROM z LEFT JOIN n ON n.doc_id = z.x GROUP BY 1""",
    "op13_importance": rf"""
        WITH k AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        w AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
              UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
        v AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM w),
        c AS (SELECT w, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM v, k),
        f AS (SELECT side, doc_id, bucket FROM w JOIN c USING (w)),
        n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
        z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
        g AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n, z),
        m AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
        a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)::DOUBLE AS h FROM documents LEFT JOIN m USING (doc_id)),
        o AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM a),
        q AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS i, count(*) OVER () AS n FROM o WHERE n_features >= 20)
        SELECT o.doc_id, n_features, weight, score, CASE WHEN i <= 10 * n // 100 THEN i END AS rank FROM o LEFT JOIN q USING (doc_id)""",
}
