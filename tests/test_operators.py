import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import filters as P
from millrace.operators import joins as J
from millrace.operators import order, picks, sets, signal
from millrace.operators import windows as W


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_running_sums_cross_blocks(spark):
    rows = [(i, i % 3, i * 2) for i in range(500)] + [(7, 1, 5)]
    got = order.running(frame(spark, rows, "id bigint, g int, v int"), "id", "s", F.col("v"), ("g",), ("v",), rows=16).collect()
    sums = {}
    for i, g, v in sorted(rows, key=lambda r: (r[0], r[2])):
        sums[g] = sums.get(g, 0) + v
        assert (i, g, v, sums[g]) in {tuple(r) for r in got}
    index = order.indexed(frame(spark, rows, "id bigint, g int, v int"), "id", ties=("v",), rows=16).select("idx").collect()
    assert sorted(r.idx for r in index) == list(range(501))


def test_running_sums_of_skewed_keys(spark):
    """Keys far apart and one group that holds all rows: blocks follow the rows, not the keys' range."""
    keys = [i for i in range(300)] + [10**15 + 10**9 * i for i in range(300)]
    df = frame(spark, [(k, 1) for k in keys], "id bigint, g int")
    assert order.blocks(df, ("g",), ("id",), 50)[1] >= 8
    got = {r.id: r.at for r in order.indexed(df, "id", "at", ("g",), rows=50).collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_exact_quantiles_by_refinement(spark):
    rng = np.random.default_rng(1)
    values = [*map(float, rng.lognormal(0, 6, 3000)), *[2.5] * 700, None]
    df = frame(spark, [(v,) for v in values], "v double")
    known = np.array([v for v in values if v is not None])
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 0.95, 1.0]
    for most in (100, 10**6):
        assert order.quantiles(df, F.col("v"), shares, most, cells=16) == pytest.approx(np.quantile(known, shares).tolist())
    assert order.quantiles(df.limit(0), F.col("v"), [0.5]) == [None]


def test_agreement_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    items = [(i, i % 3 == 0, [float(x) for x in rng.normal(size=6)]) for i in range(40)] + [(99, True, [1.0] * 6)]
    df = frame(spark, items, "id int, g boolean, v array<double>")
    want = [np.corrcoef(a[2], b[2])[0, 1] for i, a in enumerate(items) for b in items[:i] if a[1] == b[1] and 99 not in (a[0], b[0])]
    for tile in (4, 2048):
        r = A.pair_agreement(df, "g", "id", "v", tile).first()
        assert r.n == len(want) and (r["mean"], r["min"], r["max"]) == pytest.approx((np.mean(want), min(want), max(want)))
    assert A.pair_agreement(df.limit(0), "g", "id", "v").first().n == 0


def test_bootstrap_covers_the_mean_and_agrees_between_runs(spark):
    df = spark.range(400).select("id", (F.col("id") % 7 * 1.5).alias("v"), (F.col("id") % 2).alias("g"))
    ci = lambda d: {r.g: (r["mean"], r.low, r.high) for r in A.bootstrap_ci(d, "v", "id", 500, by=("g",)).collect()}
    got = ci(df)
    for g in (0, 1):
        v = np.array([i % 7 * 1.5 for i in range(400) if i % 2 == g])
        mean, low, high = got[g]
        assert mean == pytest.approx(v.mean()) and low < mean < high
        assert high - low == pytest.approx(2 * 1.96 * v.std() / np.sqrt(200), rel=0.25)
    again = ci(df.repartition(9))
    assert all(again[g] == pytest.approx(got[g]) for g in got)
    assert A.bootstrap_ci(df.limit(0), "v", "id", 10).first().low is None


def test_pairs_of_one_hot_key(spark):
    df = spark.range(900).select("id", F.when(F.col("id") < 880, 1).otherwise(F.col("id")).alias("k"))
    key = {i: 1 if i < 880 else i for i in range(900)}
    pos = {r.id: r.partner for r in J.positive_pair(df, "k", "id").collect()}
    assert len(pos) == 900 and all(key[p] == key[i] and (p != i or i >= 880) for i, p in pos.items())
    assert sorted(p for i, p in pos.items() if i < 880) == list(range(880))
    neg = {r.id: r.partner for r in J.negative_pair(df, "k", "id").collect()}
    assert len(neg) == 900 and all(key[p] != key[i] for i, p in neg.items())
    other = {r.id: r.other_text for r in J.shuffled_control(df.withColumn("b", F.lit(0)).withColumn("text", F.col("id")), "b", "id").collect()}
    assert other == {i: (i - 1) % 900 for i in range(900)}


def test_gates_collect_all_reasons(spark):
    df = frame(spark, [("a", 0.5, -60.0, 0.2, 0.9, 3.0, 100.0, 1.0), ("b", 5.0, -20.0, 0.0, 0.1, None, 9000.0, None)], "id string, duration_s double, rms_db double, clipping_ratio double, silence_ratio double, snr_db double, bandwidth99_hz double, mos double")
    got = {r.id: r for r in P.apply_gates(df).collect()}
    assert [x.split("(")[0] for x in got["a"].reasons] == ["too_short", "low_level", "clipping", "mostly_silent", "low_snr", "narrowband", "low_mos"]
    assert got["b"].keep and got["b"].notes == ["snr_unevaluable", "mos_unavailable"]
    asr = P.asr_gate(P.apply_gates(df).withColumn("transcripts", F.array(F.lit("x y"), F.lit("x z"))))
    assert {r.id: r.keep for r in asr.collect()} == {"a": False, "b": False}
    assert A.curation_report(P.apply_gates(df)).first().asDict() == {"n_total": 2, "n_kept": 1, "n_rejected": 1, "hours_kept": 5 / 3600}


def test_play_turns(spark):
    play = "Front matter\nACT I\nALGERNON.\nDid you hear\nwhat I was playing?\n[Exit]\n\nLANE.\nI didn't think it polite.\nhttp://x\nEMPTY.\n\nLANE.\nYes, sir."
    got = P.turns_from_play(frame(spark, [("p", play)], "play string, text string")).orderBy("turn").collect()
    assert [(r.speaker, r.said) for r in got] == [("ALGERNON", "Did you hear what I was playing?"), ("LANE", "I didn't think it polite."), ("LANE", "Yes, sir.")]


def test_licence_gate(spark):
    reg = frame(spark, [("a", False), ("b", True)], "name string, restricted boolean")
    df = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, teacher string")
    assert [r.id for r in P.licence_gate(df, reg).collect()] == [1]
    assert sorted(r.id for r in P.licence_gate(df, reg, acknowledged=True).collect()) == [1, 2]
    with pytest.raises(Exception, match="refused teacher"):
        P.licence_gate(df, reg, strict=True).collect()


def words(pairs):
    return F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"), F.lit(w).alias("word")) for a, b, w in pairs])


def test_segments_keep_every_word(spark):
    spoken, t = [], 0.0
    for g in range(10):
        for k in range(4):
            spoken.append((t, t + 0.7, f"w{g}_{k}"))
            t += 0.75
        t += 0.45
    got = spark.range(1).select(W.segment_by_words(words(spoken), 3.0, 14.0, 0.3).alias("s")).first().s
    assert " ".join(s.text for s in got).split() == [w for *_, w in spoken]
    assert all(s.end - s.start >= 3 for s in got)
    flat = [(i * 0.5, i * 0.5 + 0.45, f"v{i}") for i in range(80)]
    got = spark.range(1).select(W.segment_by_words(words(flat), 3.0, 15.0, 0.3).alias("s")).first().s
    assert max(s.end - s.start for s in got) <= 15 and len(" ".join(s.text for s in got).split()) == 80
    one = F.struct(F.lit(0.0).alias("start"), F.lit(40.0).alias("end"), F.lit("x").alias("text"))
    got = spark.range(1).select(W.split_long_segment(one, words(flat), 10.0).alias("s")).first().s
    assert len(got) >= 4 and len(" ".join(s.text for s in got).split()) == 80


def test_punctuation(spark):
    w = words([(0, 0.5, "a,"), (1.0, 1.5, "b"), (1.51, 2, "c,")])
    assert spark.range(1).select(W.punctuate(w).alias("t")).first().t == "a, b c"


def test_budgets_differ_at_the_edge(spark):
    df = frame(spark, [("s", i, "x" * n) for i, n in enumerate([4, 4, 4, 1])] + [("t", 0, "xx")], "g string, k bigint, t string")
    within = W.prefix_within(df, "g", "k", F.length("t"), 10).where("g = 's'")
    until = W.prefix_until(df, "g", "k", F.length("t"), 10, 1000).where("g = 's'")
    assert sorted(r.k for r in within.collect()) == [0, 1] and sorted(r.k for r in until.collect()) == [0, 1, 2]
    assert {r.g for r in W.prefix_until(df, "g", "k", F.length("t"), 10, 12).collect()} == {"s"}


def test_pairs(spark):
    df = frame(spark, [(i, i % 3) for i in range(30)] + [(99, 7)], "id int, k int")
    pos = {r.id: r.partner for r in J.positive_pair(df, "k", "id").collect()}
    assert all(p % 3 == i % 3 and p != i for i, p in pos.items() if i != 99) and pos[99] == 99
    assert sorted(pos.values()) == sorted(pos)
    neg = {r.id: r for r in J.negative_pair(df, "k", "id").collect()}
    assert len(neg) == 31 and all(r.other_key != r.k for r in neg.values())
    assert J.negative_pair(df.where("k = 7"), "k", "id").first().partner is None
    pairs = J.pairs_within(df, "k", "id").count()
    assert pairs == 3 * 45 and J.pairs_within(df, "k", "id", 2).count() == 3 * (9 + 8)
    shift = J.best_shift(*[frame(spark, [("u", f, math.sin((f + s) ** 1.5)) for f in range(60)], "u string, frame int, value double") for s in (0, 3)], "u", 5).first()
    assert abs(shift["shift"]) == 3 and shift.rho == pytest.approx(1)


def test_remap(spark):
    df = frame(spark, [(i, v) for i, v in enumerate([0, 1, 2, 9])], "id int, voice int")
    extra = frame(spark, [(0, "x"), (1, "a"), (2, "y")], "voice int, name string")
    merged = frame(spark, [(0, "a"), (1, "b")], "voice int, name string")
    assert {r.name: r.merged_voice for r in J.remap_keys(df, extra, merged).collect()} == {"a": 0, "x": 2, "y": 3, "voice_9": 4}


def test_merge_is_refused_before_writing(spark):
    items = lambda w: frame(spark, [("i", 0, w, "")], "id string, voice int, width int, tag string")
    names = frame(spark, [(0, "a")], "voice int, name string")
    with pytest.raises(ValueError, match="fingerprints"):
        sets.merge_caches(items(72), items(72), names, names, "f", "g")
    with pytest.raises(ValueError, match="widths"):
        sets.merge_caches(items(72), items(48), names, names, "f", "f")
    assert sorted(r.tag for r in sets.merge_caches(items(72), items(72), names, names, "f", "f").collect()) == ["0", "1"]


def test_disjoint(spark):
    a, b = frame(spark, [("x",), ("y",)], "t string"), frame(spark, [("y",)], "t string")
    assert sets.assert_disjoint(a.where("t = 'x'"), b, "t").count() == 1
    with pytest.raises(Exception, match="held-out"):
        sets.assert_disjoint(a, b, "t").collect()


def test_statistics(spark):
    df = frame(spark, [("v", "s", d, float(d * i % 5)) for d in range(3) for i in range(20)], "voice string, source string, dim int, value double")
    assert A.group_stats(df, ["voice", "dim"]).where("dim = 0").first()["std"] == 1e-6
    assert A.voice_source_stats(df).where("source IS NOT NULL").count() == 0
    empty = A.spread_summary(df.limit(0), []).first()
    assert math.isnan(empty["mean"]) and empty.straddles_zero and empty.n == 0
    ema = A.ema_norm(frame(spark, [(0, 1, 1.0, 1.0), (0, 2, 3.0, 1.0)], "dim int, batch int, mean double, var double")).first()
    assert ema["mean"] == pytest.approx(1.02)
    ci = A.bootstrap_ci(frame(spark, [(i, float(i % 10)) for i in range(300)], "id int, value double"), "value", "id", 300).first()
    assert ci.low < 4.5 < ci.high and ci.high - ci.low == pytest.approx(2 * 1.96 * 2.88 / math.sqrt(300), rel=0.3)
    gated = {r.k: (r.value, r.reason) for r in A.control_gated(frame(spark, [("a", 0.1), ("b", 0.2), ("c", 0.3)], "k string, value double"), frame(spark, [("a", 0.1), ("b", 0.9)], "k string, value double"), "k").collect()}
    assert gated == {"a": (0.1, None), "b": (None, "control failed (0.900)"), "c": (None, "no control")}


def test_claims(spark):
    reports = frame(spark, [("r", '{"a": {"x": 2.5}, "b": [1, 7], "checks": {"p": true, "q": false}, "ok": {"p": true}}')], "report string, json string")
    rows = [("1", "r", "a.x", ">=", 2.0, None), ("2", "r", "a.x", "<=", 2.0, None), ("3", "r", "b.1", "==", 7.0, None), ("4", "r", "a.x", "lt_field", None, "b.1"), ("5", "r", "checks", "all_true", None, None), ("6", "r", "ok", "all_true", None, None), ("7", "none", "a", ">=", 1.0, None)]
    got = {r.claim: r.outcome for r in A.evaluate_claims(frame(spark, rows, "claim string, report string, field string, op string, bound double, other_field string"), reports).collect()}
    assert got == {"1": "pass", "2": "fail", "3": "pass", "4": "pass", "5": "fail", "6": "pass", "7": "unmeasured"}


def test_splits_don_t_leak(spark):
    df = frame(spark, [(i, f"t{i % 20}") for i in range(100)], "id int, t string")
    for out in (W.split_by_text(df, "t", 4), W.split_by_group(df, F.col("t"), 12)):
        by = {r.t: r.s for r in out.groupBy("t").agg(F.collect_set("split").alias("s")).collect()}
        assert all(len(s) == 1 for s in by.values()) and {s[0] for s in by.values()} == {"val", "train"}
    batches = W.epoch_batches(df, "id", 32, 0, 0)
    assert batches.count() == 96 and batches.groupBy("batch").count().where("count <> 32").isEmpty()
    assert batches.select("id").distinct().count() == 96
    late = W.epoch_batches(df, "id", 32, 0, 0, position=2)
    assert {r.id for r in late.collect()} == {r.id for r in batches.where("batch = 2").collect()}


def test_picks(spark):
    df = frame(spark, [(1, "step_5", 0.5), (2, "step_12", None), (3, "none", 0.7)], "id int, name string, m double")
    assert [r.step for r in picks.order_by_step(df, "name", 5).collect()] == [5, 12]
    assert picks.select_row(df, "m", order="id").first().id == 3
    assert picks.select_row(df, where=F.col("id") > 1).first().id == 2
    best = picks.best_row(df.withColumn("k", F.lit(1)), "k", "m", largest=False).first()
    assert best.id == 1
    assert picks.sample_n(df, "id", 2).count() == 2


def test_signal_features(spark):
    sr, t = 24000, np.arange(24000) / 24000
    wave = lambda f: (0.5 * np.sin(2 * np.pi * f * t)).astype(np.float32)
    df = frame(spark, [(f, wave(f).tolist()) for f in (110, 220, 440)] + [(0, [0.0] * 4000), (-1, None)], "f int, wav array<float>")
    got = {r.f: r.f0 for r in signal.with_f0(df).collect()}
    for f in (110, 220, 440):
        assert np.median(got[f]) == pytest.approx(f, rel=0.01)
    assert not any(got[0]) and got[-1] is None
    auto = {r.f: r.f0 for r in signal.with_f0(df, method="autocorr").collect()}
    assert np.median(auto[220]) == pytest.approx(220, rel=0.01) and not any(auto[0])
    spec = {r.f: r.bandwidth99_hz for r in signal.with_spectral(df).collect()}
    assert spec[440] == pytest.approx(440, abs=120)
    mel = {r.f: r.log_mel for r in signal.with_log_mel(df).collect()}
    assert len(mel[440][0]) == 80 and len(mel[440]) == 24000 // 256 + 1
    pitch = A.pitch_summary(signal.with_f0(df.where("f > 0"))).first()
    assert pitch.voiced == 1 and not pitch.plausible and pitch.median_f0 == pytest.approx(220, rel=0.01)
