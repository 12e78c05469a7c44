import time

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import ann, chat, url_filter

VECS = "vec_id bigint, embedding array<float>, key string, leaves int"


def vectors(spark, pairs):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in pairs], VECS)


def brute(pairs, queries, k):
    ok = {}
    for i, v in pairs:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            ok[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in queries:
        if q in ok:
            out[q] = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k]
    return out


def test_neighbours_with_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(600)]
    pairs += [(1000 + i, pairs[0][1]) for i in range(300)]  # a hot vector
    nan, inf = float("nan"), float("inf")
    pairs += [(2000, None), (2010, []), (2020, [0.0] * 8), (2030, [nan] + [1.0] * 7), (2040, [inf] * 8), (2050, [None] + [1.0] * 7), (2060, [1.0] * 5), (None, [1.0] * 8)]
    got = {}
    for r in ann.search(vectors(spark, pairs), F.col("id") % 10 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(pairs, [i for i, _ in pairs if i is not None and i % 10 == 0], 10)
    assert set(got) == set(want)
    near = 0
    for q, found in got.items():
        found.sort()
        assert [n for n, *_ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(v != q for _, v, _ in found)
        near += len({v for _, v, _ in found} & {v for _, v in want[q]})
    assert near / (10 * len(want)) >= 0.9
    assert [(s, v) for _, v, s in got[1000]] == want[1000]


def test_equally_distant_vectors_go_by_id(spark, monkeypatch):
    """20,000 rows at one distance: the smaller ids win, over tiles as well."""
    monkeypatch.setattr(ann, "TILE", 1000)
    rng = np.random.default_rng(3)
    pairs = [(0, [1.0] * 16)]
    for i in range(1, 20_001):  # signs: each coordinate is 1 off, whichever the sign
        pairs.append((i, [float(x) for x in 1.0 + rng.choice([-0.5, 0.5], 16)]))
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(vectors(spark, pairs), F.col("id") == 0, search_share=100.0).collect())
    assert got == [(i, i, 2.0) for i in range(1, 11)]


def test_nearest_is_exact_where_the_fast_form_cancels():
    rng = np.random.default_rng(4)
    b = 1e6 + rng.normal(size=(3000, 24)) * 1e-3  # far from the origin: a^2 - 2ab + b^2 loses all digits
    a = b[:5] + rng.normal(size=(5, 24)) * 1e-4
    found = ann.nearest(a, b, [[i] for i in range(len(b))], 10)
    for i in range(5):
        exact = np.sqrt(((a[i] - b) ** 2).sum(axis=1))
        assert [(j, d) for q, j, d in found if q == i] == [(int(j), float(exact[j])) for j in np.lexsort((np.arange(len(b)), exact))[:11]]


def test_recall_on_the_given_vectors(spark):
    """64 dimensions, the query's own settings; recall of 0.9 at least, and scores that are the exact distances."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in rows.collect() if r.vec_id is not None and r.embedding and any(r.embedding)}
    ids = np.array(sorted(table))
    every = np.stack([table[i] for i in ids])
    got = {}
    for r in ann.search(rows, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    near = 0
    for q in [int(i) for i in ids if i % 100 == 0]:
        d = np.sqrt(((every - table[q]) ** 2).sum(axis=1))
        want = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        near += len(set(want) & {v for _, v, _ in got[q]})
        assert all(s == float(np.sqrt(((table[v] - table[q]) ** 2).sum())) for _, v, s in got[q])
    assert near / (10 * len(got)) >= 0.9


def test_a_leaf_that_all_queries_reach_is_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(400)]
    monkeypatch.setattr(ann, "PROBES", 7)
    monkeypatch.setattr(ann, "TILE", 50)
    got = {}
    for r in ann.search(vectors(spark, pairs), F.col("id") % 4 == 0, k=5, trees=1, leaf=400, search_share=100.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute(pairs, [i for i, _ in pairs if i % 4 == 0], 5)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want


def test_rows_of_one_id_all_count(spark):
    """One id with two vectors, and one with the same vector twice: the nearest of each row, in every run."""
    pairs = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 3.0]), (2, [1.0, 0.2]), (2, [1.0, 0.2]), (0, [1.0, 0.4])]
    found = {tuple(sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(vectors(spark, pairs).repartition(n), F.col("id") == 0, k=10).collect())) for n in (1, 3)}
    from_first = [(0.1, 1), (0.2, 2), (0.2, 2), (0.4, 0), (3.0, 1)]
    from_last = [(0.2, 2), (0.2, 2), (0.3, 1), (0.4, 0), (2.6, 1)]
    assert found == {tuple(sorted((0, n, v, s) for own in (from_first, from_last) for n, (s, v) in enumerate(own, 1)))}


def test_few_vectors_give_all_candidates(spark):
    got = ann.search(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [1.0, 2.0])]), F.col("id") == 0, k=10).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 2, 0.0), (2, 1, 0.5)]


def test_no_vectors(spark):
    assert ann.search(vectors(spark, []), F.col("id") == 0).collect() == []
    assert ann.search(vectors(spark, [(0, None), (1, [0.0])]), F.col("id") == 0).collect() == []


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("example.net", "/en", "block"),
    ("org", "", "block"), ("ORG", "/ok", "allow"), ("org", "/ok", "block"), ("co.uk", "/", "allow"), ("", "/", "block"), (None, "/", "block"), ("de", None, "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "http://x.net?/en/", "https://a.example.net/en/x/y", "http://b.a.example.net/en/xx#q", "http://notexample.net/en/",
    "http://example.net/EN/", "http://example.org/ok/1", "http://org/o", "x://a.co.uk/://b.net/", "http://co.uk:80/", "http://.net/", "http://net./", "http://a..net/p", "a\nb://de\n/x", "http://exa-mple.net/en/", "http://de" + "/x" * 20_000,
]


def judge_brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        m = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[n:m] if m >= n else ""
    best = None
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            new = (-len(h + p), h + p, v != "block", v)
            best = new if best is None else min(best, new)
    return host, path, best and best[1], best[3] if best else "allow"


def test_url_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(URLS * 3)] + [(0, None, "h", None, 2)], "page_id bigint, url string, host string, rule string, stack int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for each in (2, 7, 250_000):  # 2: almost all labels are dealt over groups
        got = url_filter.judge(pages, rules, each=each).collect()
        want = [(i, *judge_brute(u)) for i, u in enumerate(URLS * 3)] + [(0, *judge_brute(None))]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_many_rules_of_one_label(spark):
    """100,000 hosts of one label, and pages under some of them."""
    rules = spark.range(100_000).selectExpr("concat('h', id, '.com') AS host", "'/' AS path", "if(id % 2 = 0, 'block', 'allow') AS verdict")
    rules = rules.unionByName(spark.createDataFrame([("com", "/", "block")], rules.schema))
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://x.h', id * 40, '.com/p') AS url")
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, each=1000).collect()}
    assert time.time() - began < 60
    assert got == {i: (f"h{i * 40}.com/", "block") if i * 40 < 100_000 else ("com/", "block") for i in range(3000)}
    plan = url_filter.judge(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowPython", "Python")


TURNS = [
    (1, 0, "system", "be <s>kind</s>"), (1, 1, "user", "a\\b [INST] \\[/INST]"), (1, 2, "assistant", "<\\s> \\\\ ok\n</s>"), (1, 3, "user", "tail"),
    (2, 1, "assistant", "second"), (2, 0, "assistant", None), (2, 1, "assistant", "second"), (3, 0, None, None), (4, None, "user", "x"), (4, 0, "assistant", "é🎉"),
    (5, 0, "ro\\le\n<s>x", "t"), (None, 0, "user", "q"), (None, 1, "assistant", "r" * 100_000), (6, 0, "assistant", ""),
]


def test_chat_reads_back_what_went_in(spark):
    rows = spark.createDataFrame([(*t, 1, "z") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, turns int, formatted string")
    examples = chat.format_examples(rows)
    read = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by = {}
    for c, n, role, text in TURNS:
        by.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    assert set(read) == set(by)
    for c, turns in by.items():
        turns = [(role, text) for *_, role, text in sorted(turns)]
        assert [(t.role, t.text) for t in read[c].turns] == turns
        assert "".join(read[c].losses) == "".join(text for role, text in turns if role == "assistant")
    plan = chat.read_back(examples)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowPython", "Python")


def test_chat_of_very_long_roles_and_texts_of_backslashes(spark):
    many = "\\" * 100_000
    turns = [(1, 0, many, "a"), (1, 1, "assistant", many), (2, 0, many + "\n" + "\n\\" * 50_000, many + "</s>" * 1000), (3, 0, "assistant", "<s>" * 30_000)]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    read = {r.conv_id: r for r in chat.read_back(chat.format_examples(rows)).collect()}
    for c in (1, 2, 3):
        assert [(t.role, t.text) for t in read[c].turns] == [(role, text) for i, _, role, text in turns if i == c]
    assert read[1].losses == [many] and read[3].losses == ["<s>" * 30_000]


def test_each_example_trains_on_one_reply(spark):
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(6)], "conv_id bigint, turn bigint, role string, text string")
    got = sorted(map(tuple, chat.format_examples(rows).collect()))
    assert len(got) == 3
    for n, (_, example, text, start, size, last) in enumerate(got):
        assert example == n and text[start : start + size] == f"t{2 * n + 1}" and text.endswith("</s>")
        assert text.count("[INST]user") == n + 1 and last == (n == 2)
    assert chat.format_examples(rows.limit(0)).collect() == []
