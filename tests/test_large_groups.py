"""Operators that spread one hot group over blocks, against plain versions; blocks hold a few rows here."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import align, neartext, order, signal
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.plans import jobs
from millrace.streaming import streams


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_one_key_value_of_all_rows_is_spread(spark):
    df = frame(spark, [(1, 5, i) for i in range(200)], "g int, k int, t int")
    blocks, parts = order.blocks(df, ("g",), ("k", "t"), 20)
    assert parts == 10 and blocks.groupBy("__block").count().agg(F.max("count")).first()[0] <= 60
    got = {r.t: r.at for r in order.indexed(df, "k", "at", ("g",), ("t",), rows=20).collect()}
    assert got == {i: i for i in range(200)}
    nulls = frame(spark, [(None if i % 2 else 1, i) for i in range(60)], "g int, k int")
    assert sorted(r.at for r in order.indexed(nulls, "k", "at", ("g",), rows=7).collect()) == sorted([*range(30)] * 2)


def test_wide_rows_stay_out_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(order, "LARGE", 0)
    monkeypatch.setattr(order, "WIDE", 0)
    seen, blocks = [], order.blocks
    monkeypatch.setattr(order, "blocks", lambda df, *rest: seen.append(df.columns) or blocks(df, *rest))
    df = frame(spark, [(i * 7 % 50, f"text {i}") for i in range(50)] + [(None, "none")], "k int, text string")
    got = {(r.k, r.text, r.idx) for r in order.indexed(df, "k", rows=8).collect()}
    assert got == {(i * 7 % 50, f"text {i}", i * 7 % 50 + 1) for i in range(50)} | {(None, "none", 0)}
    near = {r.text: r.n for r in order.neighbour(df.where("k IS NOT NULL"), "k", "n", (), ("k",), rows=8).collect()}
    assert near == {f"text {i}": (i * 7 % 50 - 1 if i else None) for i in range(50)}
    assert seen and not any("text" in columns for columns in seen)


@pytest.mark.parametrize("few", [0, 1000])
def test_overlap_of_common_texts(spark, monkeypatch, few):
    monkeypatch.setattr(J, "FEW", few)
    calls, distinct = [], J.join_classes
    monkeypatch.setattr(J, "join_classes", lambda *a: calls.append(1) or distinct(*a))
    own = frame(spark, [(" A",)] * 300 + [("b",), (None,)], "text string")
    held = frame(spark, [(i, "a") for i in range(200)] + [(200, "B "), (201, "c"), (202, None)], "id int, text string")
    out = J.holdout_overlap(own, held)
    assert sorted(r.id for r in out.collect()) == list(range(201)) and out.columns == ["id", "text"]
    assert bool(calls) == (few == 0)
    assert few == 0 or "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [5, 1000])
def test_neighbours_cross_blocks(spark, rows):
    data = [(i % 2, i, f"v{i}" if i % 7 else None) for i in range(80)] + [(9, 1, "alone")]
    df = frame(spark, data, "g int, k int, v string")
    for ahead in (False, True):
        got = {(r.g, r.k): r.n for r in order.neighbour(df, "v", "n", ("g",), ("k",), ahead, rows).collect()}
        for g in (0, 1, 9):
            own = sorted((k, v) for x, k, v in data if x == g)
            for i, (k, _) in enumerate(own):
                j = i + (1 if ahead else -1)
                assert got[g, k] == (own[j][1] if 0 <= j < len(own) else None)


@pytest.mark.parametrize("rows", [10, 10_000])
def test_asof_of_a_hot_key(spark, rows):
    rng = random.Random(3)
    words = [("a", rng.randrange(1000), f"w{i}") for i in range(60)] + [("b", 500, "only"), ("c", 1, "x")]
    points = [("a", rng.randrange(-50, 1100), i) for i in range(150)] + [("b", 1, 900), ("b", 700, 901), ("d", 5, 902)]
    got = {r.id: r.word for r in J.asof_word(frame(spark, points, "k string, pos int, id int"), frame(spark, words, "k string, start int, word string"), "k", rows=rows).collect()}
    for k, at, i in points:
        own = sorted((s, w) for x, s, w in words if x == k)
        before = [w for s, w in own if s <= at]
        first = min((w for s, w in own if s == own[0][0]), default=None) if own else None
        assert got[i] == (before[-1] if before else first)


@pytest.mark.parametrize("rows", [7, 10_000])
def test_order_statistics_of_a_hot_key(spark, rows):
    rng = random.Random(1)
    data = [(1, float(rng.randrange(40))) for _ in range(300)] + [(2, 3.5), (3, None), (None, 1.0), (None, 2.0)]
    places = {"p90": A.nearest_rank(90), "p100": A.nearest_rank(100), "mid": A.upper_median()}
    got = {r.g: r for r in A.order_statistics(frame(spark, data, "g int, v double"), ("g",), F.col("v"), places, rows).collect()}
    assert set(got) == {1, 2, None}
    for g in got:
        s = sorted(v for x, v in data if x == g and v is not None)
        assert (got[g].n, got[g].p90, got[g].p100, got[g].mid) == (len(s), s[min(len(s) - 1, int(0.9 * len(s)))], s[-1], s[len(s) // 2])


def spoken(seed, n, key="r"):
    rng, at, out = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0.05, 0.1, 0.4, 0.8, 3.0, 20.0, 40.0]) if rng.random() < 0.5 else 0.02
        length = rng.choice([0.2, 0.5, 1.5, 17.0]) if rng.random() < 0.1 else 0.3
        out.append((key, round(at, 3), round(at + length, 3), f"w{i}"))
        at += length
    return out


@pytest.mark.parametrize("rows", [9, 100_000])
def test_segments_of_long_recordings_equal_the_plain_fold(spark, rows):
    words = spoken(1, 300, "a") + spoken(2, 50, "b") + spoken(3, 1, "c")
    df = frame(spark, words, "key string, start double, end double, word string")
    by = df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word"))).alias("w"))
    plain = by.select("key", "w", F.posexplode(W.segment_by_words(F.col("w"), 3.0, 15.0, 0.3)).alias("n", "s"))
    want = sorted((r.key, r.n, r.s.start, r.s.end, r.s.text) for r in plain.collect())
    segments = W.segment_recordings(df, "key", rows=rows)
    assert sorted((r.key, r.n, r.start, r.end, r.text) for r in segments.collect()) == want
    cut = plain.select("key", "n", F.posexplode(W.split_long_segment(F.col("s"), F.col("w"), 15.0)).alias("p", "x"))
    want = sorted((r.key, r.n, r.p, r.x.start, r.x.end, r.x.text) for r in cut.collect())
    assert sorted(map(tuple, W.split_recordings(segments, "key", 15.0).collect())) == want
    tokens = W.punctuated(df, "key", ("start", "end"), rows=rows)
    said = {r.key: r.t for r in by.select("key", W.punctuate(F.col("w")).alias("t")).collect()}
    told = defaultdict(list)
    for r in sorted(tokens.collect(), key=lambda r: (r.key, r.start)):
        told[r.key].append(r.token)
    assert {k: " ".join(v) for k, v in told.items()} == said
    assert W.segment_recordings(df.limit(0), "key").collect() == []


def test_segments_by_table_function(spark):
    tables.register(spark)
    words = [*spoken(4, 120, "a"), ("a", None, 1.0, "x"), ("b", 0.0, 1.0, "one")]
    df = frame(spark, words, "key string, start double, end double, word string")
    df.createOrReplaceTempView("spoken_words")
    got = spark.sql("SELECT key, n, start, end, text FROM segment_words(TABLE(spoken_words) PARTITION BY key ORDER BY (start, end, word), 3.0D, 15.0D, 0.3D)")
    want = W.segment_recordings(df.where("start IS NOT NULL"), "key").select("key", "n", "start", "end", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_folded_means(spark):
    df = frame(spark, [("a", i, float(i)) for i in range(20)] + [("b", 0, 1.0)], "k string, at int, v double")
    got = {(r.k, r.fold): r["mean"] for r in W.folded_means(df, "k", ("at",), "v", 8, rows=6).collect()}
    assert got == {("a", 0): 3.5, ("a", 1): 11.5}


# --- near-duplicate texts ----------------------------------------------------------------------------


def brute(pairs, similarity, words=5):
    sets = [frozenset(tuple(p[i : i + words]) for i in range(max(1, len(p) - words + 1))) if p else frozenset() for p in ((t or "").lower().split() for _, t in pairs)]
    where, common, root = defaultdict(list), Counter(), list(range(len(pairs)))
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    for ks in where.values():
        common.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if c >= similarity * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    low = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        low[find(k)].append(i)
    name = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    return sorted(((i, len(s), name[find(k)]) for k, ((i, _), s) in enumerate(zip(pairs, sets))), key=str)


def texts():
    rng = np.random.default_rng(5)
    word = [f"v{i}" for i in range(3000)]
    base = [word[i] for i in rng.integers(0, 3000, 80)]
    pairs = [(i, " ".join([*base, f"tail{i}"])) for i in range(90)]  # a hot group of near copies
    for size in (5, 12, 40, 200):
        for _ in range(5):
            own = [word[i] for i in rng.integers(0, 3000, size)]
            for changes in range(4):
                other = list(own)
                for at in rng.choice(size, min(size, changes * max(1, size // 60)), replace=False):
                    other[at] = f"new{len(pairs)}"
                pairs.append((len(pairs), " ".join(other)))
    half = [word[i] for i in rng.integers(0, 3000, 60)]  # many texts that share two thirds only: candidates that don't link
    pairs += [(len(pairs) + k, " ".join([*half, *[word[i] for i in rng.integers(0, 3000, 25)]])) for k in range(60)]
    return [*pairs, (None, pairs[0][1]), (None, "no one else says this"), (8000, None), (8001, " \n"), (8002, "Two words"), (8003, "two WORDS"), (8003, "two WORDS"), (8004, "w " * 20_000)]


def test_near_duplicates_match_brute_force(spark):
    pairs = texts()
    df = frame(spark, [(i, t, "x", 1) for i, t in pairs], "doc_id bigint, text string, node string, size int")
    got = neartext.near_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(pairs, 0.8)
    kept = neartext.without_near_duplicates(df.where("doc_id < 8000"))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for i, _, c in brute([p for p in pairs if p[0] is not None and p[0] < 8000], 0.8)})
    assert neartext.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("rounds", [0, 1])
def test_candidates_left_by_the_rounds_are_compared_by_tiles(spark, rounds, monkeypatch):
    pairs = texts()
    df = frame(spark, pairs, "doc_id bigint, text string")
    monkeypatch.setattr(neartext.links, "__defaults__", (8, rounds))
    assert sorted(map(tuple, neartext.near_duplicates(df).collect()), key=str) == brute(pairs, 0.8)


def test_texts_around_one_passage_are_not_all_compared(spark, monkeypatch):
    """They share MinHash keys and don't link: pairs that are compared grow with the texts, not with their square."""
    rng, compared, write = np.random.default_rng(8), [], neartext.written
    passage = [f"p{i}" for i in range(90)]
    rows = [(k, " ".join([*passage, *[f"own{k}x{i}" for i in range(int(rng.integers(22, 40)))]])) for k in range(240)]
    rows += [(1000 + k, f"{rows[k][1]} more") for k in range(0, 240, 12)]

    def counted(df, name):
        out = write(df, name)
        if name == "near-pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(neartext, "written", counted)
    got = neartext.near_duplicates(frame(spark, rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 0.8)
    assert sum(compared) < 15 * len(rows)


def test_only_bounded_tables_are_broadcast(spark, monkeypatch):
    """Spark may not choose a broadcast by the size of a file: numbers take a few bits each there. Nor are sets broadcast."""
    auto, wide, write, join = [], [], neartext.written, neartext.join_classes
    monkeypatch.setattr(neartext.links, "__defaults__", (8, 0))  # so that each kind of join has rows

    def looked(df, name):
        plans = df._jdf.queryExecution()
        joins, asked = plans.executedPlan().toString().count("BroadcastHashJoin"), plans.optimizedPlan().toString().count("strategy=broadcast")
        auto.extend([name] * (joins != asked))
        return write(df, name)

    def joined(rows, classes, *rest):
        wide.extend(name for name, kind in classes.dtypes if "array" in kind)
        return join(rows, classes, *rest)

    monkeypatch.setattr(neartext, "written", looked)
    monkeypatch.setattr(neartext, "join_classes", joined)
    pairs = texts()
    got = neartext.near_duplicates(frame(spark, pairs, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(pairs, 0.8)
    assert not auto and not wide


def test_sets_without_a_candidate_are_not_shuffled(spark, monkeypatch):
    plans, write = {}, neartext.written
    monkeypatch.setattr(neartext, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    neartext.near_duplicates(frame(spark, [(i, f"a b c d e f g {i % 5}") for i in range(20)], "doc_id bigint, text string"))
    side = plans["near-sets"].split("Exchange hashpartitioning")[1]  # what comes to the join of the sets
    assert "bits" in side.split("Scan parquet")[0] and "BroadcastHashJoin" in side


def test_buckets_are_broadcast_as_bits(spark):
    sets = spark.range(3000).select(F.col("id").alias("node"), F.array("id").alias("hashes"))
    near = neartext._marked(sets, sets.where("node % 50 = 7").select("node"))
    got = [(r.node, r.hashes) for r in near.collect()]
    assert {i for i in range(3000) if i % 50 == 7} <= {i for i, _ in got} and len(got) < 70 and all(h == [i] for i, h in got)
    assert near.columns == sets.columns and neartext._marked(sets, sets.limit(0)).isEmpty()


def test_a_set_of_many_pairs_is_copied_not_broadcast(spark):
    rng = np.random.default_rng(4)
    hashes = [list(range(40))] + [sorted({*range(int(rng.integers(25, 41))), *rng.integers(100, 10**6, int(rng.integers(1, 6))).tolist()}) for _ in range(2600)]
    sets = frame(spark, [(i, len(h), h) for i, h in enumerate(hashes)], "node bigint, size int, hashes array<bigint>")
    edges = [(0, i) for i in range(1, 2601)] + [(i, 2600) for i in range(1, 2600)]
    found = neartext._verified(frame(spark, edges, "a bigint, b bigint"), sets, 0.8)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "strategy=" in x]
    assert sum("strategy=shuffle_hash" in x for x in joins) == 2
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == sum("strategy=broadcast" in x for x in joins)
    want = [(a, b) for a, b in edges if len({*hashes[a]} & {*hashes[b]}) >= 0.8 * len({*hashes[a]} | {*hashes[b]}) - 1e-9]
    assert sorted(map(tuple, found.collect())) == sorted(want) and 100 < len(want) < len(edges) - 100


def test_shingles_of_bytes_are_those_of_words():
    rng, word = np.random.default_rng(9), ["a", "B", "\u00c9", "\u65e5\u672c", "x\x00y", "\x1c", "\u00a0", "bb", "a" * 300]
    texts = ["", " \n\t", "one two", "A b c D e", "a b c d E "] + ["".join(str(rng.choice(word)) + str(rng.choice([" ", "\x0b", " \r\n"])) for _ in range(rng.integers(0, 30))) for _ in range(200)]
    cut = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, size = neartext._shingles(*neartext._word_hashes(neartext.LOWER[np.frombuffer("".join(texts).encode(), np.uint8)], cut), 5)
    names = {}
    for t, stop, n in zip(texts, np.cumsum(size), size):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert names.setdefault(frozenset(want), frozenset(found[stop - n : stop].tolist())) == frozenset(found[stop - n : stop].tolist()) and len(want) == n
    assert len(set(names.values())) == len(names) and len(set().union(*names)) == len(set().union(*names.values()))


def test_recall_at_the_threshold(spark):
    """Pairs of 100 shingles at a similarity just over 0.8: at least 99 of 100 link (0.9999 expected)."""
    rng, rows = np.random.default_rng(2), []
    for k in range(200):
        own = [f"p{k}x{i}" for i in range(104)]
        other = list(own)
        other[-11:] = [f"q{k}x{i}" for i in rng.integers(0, 10**6, 11)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    want = brute(rows, 0.8)
    linked = sum(i != c for i, _, c in want)
    got = neartext.near_duplicates(frame(spark, rows, "doc_id bigint, text string")).where("doc_id <> component_id").count()
    assert linked == 200 and got >= 198


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.label for r in neartext.components(frame(spark, edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


# --- claims, fingerprints, batches, spectra -----------------------------------------------------------


def test_claims_by_row_sum_and_candidate(spark):
    report = '{"rows": [{"k": "a", "s": 1.5, "on": true}, {"k": "b", "s": 9, "on": false}, {"k": "c", "s": 9}], "lo": 1, "hi": 2.5, "none": null, "odd": {}, "checks": {"x": 1, "y": "", "z": true}}'
    reports = frame(spark, [("second", report), ("third", "{}")], "report string, json string")
    rows = [
        ("max", "rows", "max_s", "k", None, "==", 0.0), ("tie", "rows", "max_s", "s", None, ">=", 9.0), ("by", "rows", "k=b", "s", None, "<=", 9.0), ("flag", "rows", "on=True", "s", None, "<=", 1.0), ("first", "rows", "", "s", None, "==", 1.5),
        ("no row", "rows", "k=zz", "s", None, "<=", 9.0), ("no list", "nope", "", "s", None, "<=", 9.0), ("sum", None, None, None, ["lo", "hi"], "<=", 3.5), ("half", None, None, None, ["lo", "none"], "<=", 3.5), ("null", None, None, "none", None, "<=", 1.0),
        ("checks", None, None, "checks", None, "all_true", None), ("empty", None, None, "odd", None, "all_true", None), ("number", None, None, "lo", None, "all_true", None),
    ]
    claims = frame(spark, rows, "claim string, list_field string, select string, field string, fields array<string>, op string, bound double")
    found = {r.claim: r for r in A.evaluate_claims(claims.withColumn("reports", F.array(F.lit("first"), F.lit("second"), F.lit("third"))), reports).collect()}
    assert {c: r.outcome for c, r in found.items()} == {
        "max": "unmeasured", "tie": "pass", "by": "pass", "flag": "fail", "first": "pass", "no row": "unmeasured", "no list": "unmeasured", "sum": "pass", "half": "unmeasured", "null": "unmeasured",
        "checks": "fail", "empty": "fail", "number": "fail",
    }
    assert found["max"].measured == "b" and found["sum"].missing == ["first"] and found["sum"].report_used == "second"
    assert found["checks"].detail == "2 of 3; failing: y" and found["half"].detail == "missing fields: lo, none" and found["no row"].detail == "no row matched: k=zz"
    lost = A.evaluate_claims(claims.withColumn("reports", F.array(F.lit("first"))), reports).first()
    assert lost.outcome == "unmeasured" and lost.missing == ["first"] and lost.detail == "no report: first"


def test_fingerprints_don_t_depend_on_order(spark):
    df = spark.range(1)
    print_ = lambda sql: df.select(T.config_fingerprint(F.expr(sql)).alias("f")).first().f
    one = print_("named_struct('b', map('y', array(1, 2), 'x', array(3)), 'a', named_struct('q', null, 'p', 'é'))")
    assert one == print_("named_struct('a', named_struct('p', 'é', 'q', null), 'b', map('x', array(3), 'y', array(1, 2)))")
    assert one != print_("named_struct('a', named_struct('p', 'é', 'q', null), 'b', map('x', array(3), 'y', array(2, 1)))")
    assert print_("named_struct('a', null)") != print_("named_struct('b', null)") and len(print_("17")) == 64 and print_("'x'") != print_("'y'")
    parts = [("m", "w2", 0, [1.0, 2.0]), ("m", "w1", 1, [3.0]), ("m", "w1", 0, [4.0]), ("n", "w1", 0, [4.0])]
    ddl = "g string, name string, part int, values array<double>"
    a, b = ({r.g: r.fingerprint for r in align.weight_fingerprint(frame(spark, rows, ddl), "g").collect()} for rows in (parts, parts[::-1]))
    assert a == b and a["m"] != a["n"]


def test_padded_columns(spark):
    rows = [(0, 1, [1, 2, 3], [[1.0, 2.0]], "x"), (0, 0, [4], None, "y"), (1, 0, None, [[5.0], [6.0]], "z"), (1, 1, [], [], None)]
    df = frame(spark, rows, "b int, o int, ids array<int>, v array<array<double>>, s string")
    got = {r.b: r.asDict() for r in W.pad_columns(df, "b", "o", {"text": ["ids"], "ref": ["v"]}, {"ref": 1}, ("s",)).collect()}
    assert got[0] == {"b": 0, "ids": [[4, 0, 0], [1, 2, 3]], "text_mask": [[1, 0, 0], [1, 1, 1]], "text_lengths": [1, 3], "text_width": 3, "v": [[[0.0, 0.0]], [[1.0, 2.0]]], "ref_mask": [[0], [1]], "ref_lengths": [0, 1], "ref_width": 1, "s": ["y", "x"]}
    assert got[1] == {"b": 1, "ids": [[], []], "text_mask": [[], []], "text_lengths": [0, 0], "text_width": 0, "v": [[[5.0]], [[0.0]]], "ref_mask": [[1], [0]], "ref_lengths": [1, 0], "ref_width": 1, "s": ["z", None]}


def test_crops_keep_tokens_and_frames_together(spark):
    items = [(i, "ab"[i % 2], [float(x) for x in range(40)], [10, 10, 10, 10], [1, 2, 3, 4]) for i in range(8)] + [(8, "a", [1.0] * 10, [5, 5], [7, 8])]
    df = frame(spark, items, "id bigint, voice string, x array<double>, durations array<int>, ids array<int>")
    got = {r.id: r for r in jobs.cropped(df, "id", ["x"], ["ids", "durations"], 16, 0, 3).collect()}
    for i in range(8):
        start = int(got[i].x[0])
        assert got[i].x == [float(v) for v in range(start, start + 16)]
        assert got[i].ids[0] in {start // 10 + 1, -(-start // 10)} and got[i].ids[-1] == -(-(start + 15) // 10) and len(got[i].durations) == len(got[i].ids)
    assert got[8].crop is None and len(got[8].x) == 10


def test_stft_loss_of_equal_and_short_signals(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000).tolist()
    df = frame(spark, [(0, x, x), (1, x, [2 * v for v in x]), (2, x, None), (3, [], x), (4, x[:50], x)], "id int, a array<double>, b array<double>")
    got = {r.id: r for r in signal.with_stft_loss(df, "a", "b").collect()}
    assert got[0].stft_loss == 0 and got[2].stft_loss is None and got[3].stft_loss is None and got[4].stft_loss == 0
    assert got[1].stft_convergence == pytest.approx(0.5, abs=1e-6) and got[1].stft_log_mag == pytest.approx(np.log(2), abs=1e-3)
    flat = {r.id: r.flatness for r in signal.with_flatness(df.select("id", "a"), "a").collect()}
    assert 0.7 < flat[0] < 1 and flat[3] is None and flat[4] is None
    assert align.speech_of_signals(df.select(F.col("a").alias("wav")).limit(0)).first().voiced is None


# --- streams -----------------------------------------------------------------------------------------


def test_capped_segments_close_in_silence(spark, tmp_path):
    """Words out of order within the watermark; a key that falls silent is given out by its timer."""
    schema = "key string, ts timestamp, start double, end double, word string"
    batches = [[("a", 5.0), ("a", 1.0), ("b", 2.0)], [("a", 3.0), ("a", 9.0)], [("z", 500.0)], [("z", 900.0)]]
    found = []
    for k, batch in enumerate(batches):
        rows = [(key, at, at + 1, f"{key}{at:.0f}") for key, at in batch]
        frame(spark, rows, "key string, start double, end double, word string").select("key", F.timestamp_seconds("start").alias("ts"), "start", "end", "word").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = streams.capped_segments(stream, late="6 seconds", min_s=3, max_s=15, gap_s=1.5, hold_s=30)
        with streams.rocksdb(spark):
            streams.append_manifest(out, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        found.append({(r.key, r.start, r.end, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()})
    assert found[1] == set()
    assert found[-1] >= {("a", 1.0, 10.0, "a1 a3 a5 a9"), ("b", 2.0, 3.0, "b2")}


def test_capped_segments_in_tables(spark, tmp_path):
    """Words out of order within the watermark, late ones, silence and an end marker; no call a key."""
    batches = [[("a", 5.0, "w"), ("a", 1.0, "w"), ("b", 2.0, "w")], [("a", 3.0, "w"), ("a", 9.0, "w")], [("z", 500.0, "w"), ("a", 2.0, "late")], [("z", 503.0, "w")], [("z", 503.5, None)]]
    found = []
    for batch in batches:
        rows = [(key, at, at + 1, w and f"{key}{at:.0f}") for key, at, w in batch]
        frame(spark, rows, "key string, start double, end double, word string").select("key", F.timestamp_micros((F.col("start") * 1e6).cast("bigint")).alias("ts"), "start", "end", "word").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, ts timestamp, start double, end double, word string").parquet(f"{tmp_path}/in")
        streams.capped_segments_tables(stream, f"{tmp_path}/out", f"{tmp_path}/state", late_s=6, gap_s=1.5, hold_s=30).awaitTermination()
        found.append({(r.key, r.start, r.end, r.n, r.text) for r in spark.read.parquet(f"{tmp_path}/out/done").collect()})
    silent = {("a", 1.0, 10.0, 4, "a1 a3 a5 a9"), ("b", 2.0, 3.0, 1, "b2")}
    assert found[:4] == [set(), set(), silent, silent]
    assert found[4] == silent | {("z", 500.0, 504.0, 2, "z500 z503")}


def test_running_norm_in_tables(spark, tmp_path):
    batches = [[(1, 1.0), (1, 3.0), (2, None), (None, 4.0)], [(1, 10.0), (2, 5.0), (2, float("nan"))], [(2, 7.0)]]
    for batch in batches:
        frame(spark, batch, "user_id int, value double").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("user_id int, value double").parquet(f"{tmp_path}/in")
        streams.ema_norm_tables(stream, f"{tmp_path}/out", f"{tmp_path}/state", momentum=0.5).awaitTermination()
    got = {r.user_id: (r["mean"], r["var"]) for r in spark.read.parquet(f"{tmp_path}/out/batch=2").collect()}
    assert got == {1: (6.0, 0.5), 2: (6.0, 0.0), None: (4.0, 0.0)}


def test_process_until_sees_the_marker(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen, calls = [], []

    def stream():
        calls.append(1)
        if len(calls) == 2:
            spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/in")
            spark.range(1).write.parquet(f"{tmp_path}/over")
        return spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")

    runs = streams.process_until(spark, stream, lambda df, i: seen.extend(r.id for r in df.collect()), f"{tmp_path}/ledger", f"{tmp_path}/over", 0.0)
    assert runs == 3 and sorted(seen) == [0, 1, 2, 10, 11]


def test_batches_resume_from_the_saved_position(spark, tmp_path):
    rows = spark.range(50).select("id", F.floor(F.col("id") / 10).alias("batch"))
    assert streams.position(spark, str(tmp_path)) == 0 and streams.run_batches(rows, str(tmp_path), stop=2) == 2
    streams.resume(rows, 2).where("batch < 3").write.mode("append").partitionBy("batch").parquet(f"{tmp_path}/batches")  # a run that failed before it saved its position
    assert streams.run_batches(rows, str(tmp_path)) == 5 and streams.run_batches(rows, str(tmp_path)) == 5
    got = spark.read.parquet(f"{tmp_path}/batches")
    assert got.count() == 50 and got.select("id").distinct().count() == 50


def test_files_do_not_grow_with_the_batches(spark, tmp_path):
    rows = spark.range(600).select("id", F.floor(F.col("id") / 2).alias("batch"))
    folder = str(tmp_path)
    assert streams.run_batches(rows, folder, stop=100) == 100
    rows.where("batch BETWEEN 100 AND 120").write.parquet(f"{folder}/batches/first=100")  # a run that failed before it saved its position
    assert streams.run_batches(rows, folder) == 300
    assert len(list(tmp_path.glob("batches/*/*.parquet"))) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.id, r.batch) for r in spark.read.schema("id bigint, batch bigint").parquet(f"{folder}/batches").collect()}
    assert got == {(i, i // 2) for i in range(600)} and spark.read.parquet(f"{folder}/batches").count() == 600
