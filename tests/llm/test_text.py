import base64
import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from millrace.llm import bpe, common, langid, mixing, toxicity
from millrace.llm.textvec import Words

DOCS = "doc_id bigint, text string, source string, lang string, score int, ids string, size int"
ODD = [None, "", " ", "a", "\n\n x  y", "日本語テキスト🎉🎉 é", "a" * 3000, "ab" * 700, "!?" * 300 + " " * 90, "don't I'll x1y2  z ½²", "<|endoftext|> </s>", "word " * 20_000, "\x1c\x85\xa0 q"]


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, s, g, 1, "x", 2) for i, t, s, g in pairs], DOCS)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_reference_library_and_round_trips(spark, sf, reference):
    path, other = reference
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = rows(spark, [(i, t, "s", "en") for i, t in enumerate(texts)] + [(0, None, None, None)])
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.ids == other.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.encode(docs.limit(0), path, P.PATTERN).collect() == []


def test_long_pieces_merge_as_the_reference_library_does(reference):
    path, other = reference
    encoder, rng = bpe.Bpe(bpe.load_ranks(path)), np.random.default_rng(6)
    letters = lambda n, of: "".join(rng.choice(list(of), n))
    texts = ["a" * 5001, "ab" * 4000, "aab" * 3000, letters(9000, "abcdefghijklmnopqrstuvwxyz"), letters(6000, "ab"), letters(5000, "eéèüßñ"), "the" * 2500 + letters(4000, "etaoin"), letters(2500, "日本語テキスト")]
    for text in texts:
        assert encoder.encode_pieces([text.encode()])[0].tolist() == other.encode_ordinary(text)
    began = time.time()
    encoder.encode_pieces([letters(128_000, "abcdefghijklmnopqrstuvwxyz").encode()])
    assert time.time() - began < 15


def test_decode_takes_null_ids(spark, reference):
    frame = spark.createDataFrame([(1, [65, 66]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(frame, reference[0]).collect()}
    assert got[2] == got[3] == b"" and len(got[1]) > 0


def brute_mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0):
    import hashlib
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for i, t, s, _ in docs:
        by.setdefault(s, []).append((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i, size(t)))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[2] for x in by[s]) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > cap * total[s]]
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
            open_.remove(s)
    return by, total, target


def test_mixing_meets_targets_and_nests(spark, sf):
    docs = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(9000 + i, "w " * (i % 9), None, "en") for i in range(200)] + [(9500, None, "empty", None), (9501, "", "empty", None), (None, "a b c", "src0", None), (9600, "w " * 20_000, "src1", "en")]
    by, total, target = brute_mix(docs)
    got = mixing.mix(rows(spark, docs)).collect()
    assert len(got) == len(docs)
    source = {i: s for i, _, s, _ in docs}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[s] = taken.get(s, 0) + r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(x[2] for x in by[s]) / 2 + 1e-6
    more = {r.doc_id: r.copies for r in mixing.mix(rows(spark, docs), share=1.7).collect()}
    assert all(more[r.doc_id] >= r.copies for r in got)
    assert sorted(map(tuple, mixing.mix(rows(spark, docs).repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_a_source_without_ids_comes_near_its_target(spark):
    """Null and repeated ids, equal texts as well: the words taken miss the target by half of the largest row at most."""
    kinds = {"none": [(None, f"a b c d {i}") for i in range(900)], "alike": [(7, "one two three four")] * 700, "some": [(i, "w " * (1 + i % 9)) for i in range(500)]}
    docs = [(i, t, s) for s, own in kinds.items() for i, t in own]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        x = by.setdefault(r.source_size, [0, r.target, 0])
        x[0] += r.taken
        x[2] = max(x[2], r["size"])
    assert len(by) == 3 and all(abs(taken - target) <= largest / 2 for taken, target, largest in by.values())
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id bigint, text string, source string")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_many_sources_with_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    docs = [(i, "w " * (1 + i % 5), "hot" if i % 2 else f"s{i % 40}") for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    joined = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.undo()
    assert sorted(map(str, mixing.mix(df).collect())) == joined


def test_mixing_of_nothing(spark):
    assert mixing.mix(rows(spark, [])).collect() == []
    assert mixing.mixed(rows(spark, [])).collect() == []


def test_mixed_repeats_rows(spark):
    docs = rows(spark, [(i, "a b c d", "s" if i % 4 else None, "en") for i in range(400)])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == 600


def labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet")
    return docs, spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")


def test_toxicity_on_held_out_rows_and_misspellings(spark, sf):
    docs, labels = labelled(spark, sf)
    held = toxicity.remainder("doc_id", 4) == 2
    model = toxicity.train(docs, labels.where(~held))
    seen = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    pairs = [(seen[r.doc_id] >= 0.3, r.toxic == 1) for r in labels.where(held).collect() if r.doc_id in seen]
    hit = sum(p and y for p, y in pairs)
    assert hit / sum(y for _, y in pairs) > 0.75 and hit / sum(p for p, _ in pairs) > 0.75
    odd = [t or "" for t in ODD]
    p = model.score(odd)
    assert ((p >= 0) & (p <= 1)).all() and p[0] < 0.3
    clean, bad, misspelt = model.score(["the house is of the and it was", "you are a stupid worthless idiot scum", "you are a stupiid worthles idiiot scumm"])
    assert clean < 0.3 < misspelt <= bad


def test_toxicity_edge_rows(spark):
    docs = rows(spark, [(i, t, "s", "en") for i, t in enumerate(ODD)] + [(0, None, None, None), (None, "x", None, None)])
    labels = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (2, None, 5), (3, 7, 5), (None, 1, 5), (99, 1, 5)], "doc_id bigint, toxic int, text int")
    for lab in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.train(docs, lab)
        out = toxicity.score(docs, model).collect()
        assert len(out) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.judged(docs, model, most=1.1).columns == docs.columns
    assert toxicity.judged(docs, model, most=1.1).count() == len(ODD) + 2
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_scores_match_a_plain_version(spark):
    """Passages, averages and the largest logit, word by word."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.4, 0.7, 0.1)
    texts = ["", "a", "Bad BAD bad words  here\tnow", " ".join("".join(rng.choice(list("abcé🎉"), int(rng.integers(1, 9)))) for _ in range(90))]
    for text, got in zip(texts, model.score(texts)):
        words = [w for k, w in enumerate(text.lower().split()) if not k or w != text.lower().split()[k - 1]]
        logits = []
        for k in range(0, len(words), toxicity.PASSAGE):
            bags = [toxicity.Bag([w]) for w in words[k : k + toxicity.PASSAGE]]
            total = max(toxicity.LEAST, sum(int(b.count[0]) for b in bags))
            logits.append(sum(float(model.units[b.unit].astype(float).sum()) for b in bags) / total * toxicity.SCALE + model.bias)
        assert abs(got - float(model.probability(np.array(max(logits, default=model.bias))))) < 1e-6
    docs = rows(spark, [(i, t, "s", "en") for i, t in enumerate(texts)])
    assert [r.score for r in sorted(toxicity.score(docs, model).collect())] == pytest.approx(model.score(texts).tolist())


def test_samples_are_bounded_whatever_repeats(spark):
    """One id on very many rows is one row of the sample, and a label's sample is its smallest hashes."""
    one = spark.range(20_000).select(F.lit(7).cast("bigint").alias("id"), F.lit(1).alias("y"))
    many = spark.range(6000).select((F.col("id") + 100).alias("id"), (F.col("id") % 2).cast("int").alias("y"))
    hashed = one.unionByName(many).select("y", "id", common.hash60(F.col("id").cast("string")).alias("h"))
    got = common.bounded(hashed, "y", "h", 50).collect()
    place = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    for y in (0, 1):
        ids = {i + 100 for i in range(6000) if i % 2 == y} | ({7} if y else set())
        assert sorted(r.id for r in got if r.y == y) == sorted(sorted(ids, key=place)[:50])
    docs = rows(spark, [(7, f"the bad text {i}", "s", "en") for i in range(3000)] + [(i, "good words", "s", "de") for i in range(100, 140)])
    labels = docs.select("doc_id", (F.col("doc_id") == 7).cast("int").alias("toxic"))
    assert len(toxicity.score(docs, toxicity.train(docs, labels)).collect()) == 3040
    assert langid.train(docs, max_chars=11, budget=1).labels == ["de", "en"]  # long texts teach by stretches, each language by one row at least


def test_language_query_matches_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crf = langid.train(docs, max_rows=20)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in langid.predict(docs, crf).collect()[:60]:
        chains = langid.Chains([texts[r.doc_id]])
        total = chain_brute(crf, chains).sum(axis=0) if len(chains.word) else np.zeros(len(crf.labels))
        assert r.lang_pred == (crf.labels[int(total.argmax())] if total.sum() else "und")
        assert abs(r.score - (total.max() / total.sum() if total.sum() else 0)) < 1e-6


def test_remainder_is_crc32_of_the_text(spark):
    got = spark.range(100).select("id", toxicity.remainder("id", 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_words_are_split_at_ascii_blanks_only():
    words = Words(["a b\u00a0c", "", "  d\t\x0be ", "a"])
    assert words.doc.tolist() == [0, 0, 2, 2, 3]
    assert words.which[0] == words.which[4] and len(words.unique) == 4
    assert words.lettered().sum() == 4


def chain_brute(crf, chains):
    e, trans, out = np.exp(chains.emissions(crf.weights))[chains.word], np.exp(crf.trans), []
    for d in np.unique(chains.doc):
        s = e[chains.doc == d]
        a, b = np.zeros_like(s), np.ones_like(s)
        a[0] = np.exp(crf.start) * s[0]
        for t in range(1, len(s)):
            a[t] = a[t - 1] @ trans * s[t]
            a[t] /= a[t].sum()
        for t in range(len(s) - 2, -1, -1):
            b[t] = trans @ (s[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        out.append(a * b / (a * b).sum(axis=1, keepdims=True))
    return np.concatenate(out)


def test_marginals_of_long_chains_are_exact():
    rng = np.random.default_rng(0)
    crf = langid.Crf(["a", "b", "c"], rng.normal(0, 3, (langid.BUCKETS, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    texts = [" ".join(f"w{chr(97 + i)}x" for i in rng.integers(0, 26, n)) for n in (1, 5, 31, 32, 33, 64, 65, 200)]
    chains = langid.Chains(texts)
    assert np.abs(crf.marginals(chains) - chain_brute(crf, chains)).max() < 1e-12


def test_languages_of_held_out_rows_and_switched_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    held = toxicity.remainder("doc_id", 3) == 1
    crf = langid.train(docs.where(~held), max_rows=100)
    got = langid.predict(docs.where(held), crf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    switched = "the of and that is with from was the it for on " * 2 + "der die und das ist nicht von dem zu ein " * 2
    chains = langid.Chains([switched])
    names = [crf.labels[i] for i in crf.marginals(chains).argmax(axis=1)]
    assert names[:6] == ["en"] * 6 and names[-6:] == ["de"] * 6


def test_language_edge_rows(spark):
    docs = rows(spark, [(i, t, "s", "en") for i, t in enumerate(ODD)] + [(50, "12 !!", None, None), (50, "12 !!", None, None)])
    for learn in (docs, docs.limit(0)):
        crf = langid.train(learn)
        got = langid.predict(docs, crf).collect()
        assert len(got) == len(ODD) + 2
        for r in got:
            text = "12 !!" if r.doc_id == 50 else ODD[r.doc_id] or ""
            assert (r.lang_pred == "und") == (not crf.labels or not any(c.isalpha() for c in text))
            assert 0 <= r.score <= 1
    assert langid.predict(docs.limit(0), crf).collect() == []


def test_long_texts_teach_by_stretches_from_all_over(spark):
    text = "".join(f"{i:05d} " for i in range(20_000))  # 120,000 characters
    df = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.p for r in df.select("id", common.passages(F.col("t"), F.col("id"), 12_000).alias("p")).collect()}
    assert got[2] == "short" and got[3] == "" and got[4] is None
    parts = [got[1][k : k + 2_000] for k in range(0, len(got[1]), 2_001)]
    at = [text.index(p) for p in parts]
    assert len(parts) == 6 and all(len(p) == 2_000 and a % 2_000 == 0 for p, a in zip(parts, at)) and at == sorted(at) and at[-1] > 20_000
    rows = spark.createDataFrame([("a", i, "x" * 10) for i in range(9)] + [("b", 0, "y" * 99), ("b", 1, "y")], "l string, o int, t string")
    kept = common.within_budget(rows, "l", "t", ["o"], 45).groupBy("l").count().collect()
    assert {r.l: r["count"] for r in kept} == {"a": 4, "b": 1}


def test_all_languages_are_learned(spark):
    """Ninety languages, more than the feature table is made for: none is left out, and each is found again."""
    rng = np.random.default_rng(1)
    docs = []
    for k in range(90):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        docs += [(len(docs) + j, " ".join(rng.choice(own, 60)), f"l{k:02d}") for j in range(4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    crf = langid.train(df.where("doc_id % 4 < 3"))
    assert len(crf.labels) == 90 and crf.weights.size <= 64 * langid.BUCKETS
    got = {r.doc_id: r.lang_pred for r in langid.predict(df.where("doc_id % 4 = 3"), crf).collect()}
    assert sum(got[i] == lang for i, _, lang in docs if i % 4 == 3) >= 85


def test_labels_without_a_document_take_no_places(spark):
    docs = spark.createDataFrame([(i, "vile foul bad word" if i % 2 else "kind calm good day") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(10_000 + i, 1) for i in range(5000)], "doc_id bigint, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels, max_rows=25)).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def differences(loss, x, at, step=1e-5):
    out = []
    for i in at:
        kept = x[i]
        x[i] = kept + step
        high = loss()
        x[i] = kept - step
        out.append((high - loss()) / (2 * step))
        x[i] = kept
    return np.array(out)


def test_toxicity_gradients_by_finite_differences():
    rng = np.random.default_rng(4)
    bag = toxicity.Bag(["some bad words here " * 9, "all good", "good good bad", "x"])
    order = np.argsort(bag.unit_word, kind="stable")
    used, unit = np.unique(bag.unit[order], return_inverse=True)
    unit_word, starts = bag.unit_word[order], np.cumsum(bag.count) - bag.count
    params = {"e": rng.normal(0, 0.3, (len(used), 4)), "w": rng.normal(0, 0.5, (2, 4)), "b": rng.normal(0, 0.1, 2)}
    toxic = rng.random(len(bag.first)) < 0.5
    balance = rng.random(len(bag.first))

    def loss():
        _, z = toxicity.forward(params, bag, unit, starts)
        return float(((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), toxic.astype(int)]) * balance).sum())

    grads = toxicity.gradients(params, bag, unit, unit_word, starts, toxic, balance)
    for name, at in (("e", [(i, d) for i in range(0, len(used), 7) for d in range(4)]), ("w", list(np.ndindex(2, 4))), ("b", [(0,), (1,)])):
        assert differences(loss, params[name], at) == pytest.approx(np.array([grads[name][i] for i in at]), abs=1e-6)


def test_language_gradients_by_finite_differences():
    rng = np.random.default_rng(5)
    chains = langid.Chains(["one two three four", "uno dos tres " * 14, "solo"])
    first, length = langid.pieces(chains.doc, langid.SPAN)
    params = {"w": rng.normal(0, 0.5, (langid.BUCKETS, 3)), "t": rng.normal(0, 0.5, (3, 3)), "s": rng.normal(0, 0.5, 3)}
    gold = np.array([0, 1, 1, 2][: len(first)])

    def loss():
        """Of each piece, by itself: the log of all paths' scores less that of the path of its label."""
        e, total = chains.emissions(params["w"]), 0.0
        for at, n, y in zip(first, length, gold):
            score = e[chains.word[at : at + n]]
            a = params["s"] + score[0]
            for t in range(1, n):
                a = np.log(np.exp(a[:, None] + params["t"]).sum(axis=0)) + score[t]
            path = params["s"][y] + score[:, y].sum() + (n - 1) * params["t"][y, y]
            total += np.log(np.exp(a).sum()) - path
        return float(total / length.sum())

    gw, seen, grads = langid.gradients(params, chains, first, length, gold)
    at = [(i, j) for i in range(0, len(seen), 11) for j in range(3)]
    assert differences(loss, params["w"], [(seen[i], j) for i, j in at]) == pytest.approx(np.array([gw[i] for i in at]), abs=1e-7)
    for name in ("t", "s"):
        at = list(np.ndindex(params[name].shape))
        assert differences(loss, params[name], at) == pytest.approx(np.array([grads[name][i] for i in at]), abs=1e-7)
