import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import text as T
from millrace.operators import align


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


X = None


@pytest.fixture(autouse=True)
def column(spark):
    """X is the column x; columns need a running session."""
    globals()["X"] = F.col("x")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The quick brown fox ran home.", True), ("Too few words.", False), ("CHAPTER one is where it all began", False), ("And then SHOUTING was heard all over", False),
        ("A Caucus-Race and a Long Tale IV.", False), ("Most Words Are Capital Here now", False), ("", False), ("and I went to the shop", True),
    ],
)
def test_prose(spark, text, want):
    assert bool(one(spark, text, T.is_prose_like(X))) is want


@pytest.mark.parametrize(("text", "want"), [("she read the whole of book vi.", False), ("she read the whole of book vi!?", False), ("she read the whole of book six.", True)])
def test_prose_ends_in_a_numeral_with_marks(spark, text, want):
    assert one(spark, text, T.is_prose_like(X)) is want


@pytest.mark.parametrize(("text", "want"), [("Part, she said, of the old house is gone.", False), ("Parts, she said, of the old house are gone.", True)])
def test_prompt_begins_with_a_heading_and_marks(spark, text, want):
    assert one(spark, text, T.is_usable_prompt(X)) is want


def test_normalize(spark):
    assert one(spark, "Hello — “World” 42 & x9 dr. Who’s <b>!", T.normalize_text(X)) == "hello - world four two and x9 doctor who's <b> !"
    assert one(spark, "The best. Mr. X", T.normalize_text(X)) == "the best. mister x"
    assert one(spark, "The best. Mr. X", T.normalize_text(X, compat=True)) == "the besaint mr. x"
    assert one(spark, None, T.normalize_text(X)) is None


def test_nfkc(spark):
    rows = spark.createDataFrame([("ﬁne ①",), ("plain",), (None,)], "x string")
    assert {r.y for r in rows.select(T.nfkc(X).alias("y")).collect()} == {"fine 1", "plain", None}


def test_normalize_folds_and_keeps_tags(spark):
    text = "ﬁne Ｎｏ １２ x② <Laugh>Mr. Y <big_sigh>  7 <x9> ﹤b﹥<B>"
    assert one(spark, text, T.normalize_text(X, keep_tags=True)) == "fine no one two x2 <laugh> mister y <big_sigh> seven x9 <b> <b>"
    assert one(spark, text, T.normalize_text(X, keep_tags=False)) == "fine no one two x2 laugh mister y big sigh seven x9 b b"
    assert one(spark, None, T.normalize_text(X, keep_tags=True)) is None


def test_split_tags(spark):
    text = "<LAUGH> Say <odd>42 <sigh>é5 <Laugh>"
    plain, tags = T.split_tags(X)
    assert one(spark, text, plain) == "say four two 5" and one(spark, text, tags) == ["<laugh>", "<sigh>", "<laugh>"]
    assert one(spark, None, plain) is None and one(spark, "", tags) == []


def test_normalize_searches_only_for_what_is_there(spark):
    for text in ("MR. Dr.x no. 7 St. 9a best. mrs.", "a – b—c & 5% 1+2=3 x_no. é no.\t\n z", " «q»  <calm>  <a  b>MR.", "", "éno. ßst. No.No. dr.st."):
        whole = T._spoken(F.translate(X, "’“”", "'\"\""), F.lit(" ".join(T.ABBREVIATIONS)), False)  # as if each abbreviation were there
        assert one(spark, text, T._plain(X, False)) == one(spark, text, whole)
    plan = spark.range(1).select(T.normalize_text(F.lit("x")))._jdf.queryExecution().toString()
    assert "(?=m)" in plan and "contains" in plan.lower()


def test_char_ids_by_table(spark):
    symbols = T.CHARS + T.IPA
    text = symbols + "\t\n\x0b\f\r\xa0\u2028é😀\x7f\x00"
    for phonemes in (False, True):
        known = symbols if phonemes else T.CHARS
        want = [known.index(c) + 28 if c in known else 1 for c in text if c not in "\t\n\x0b\f\r"]
        assert one(spark, text, T.char_ids(X, add_special=False, phonemes=phonemes)) == want
        assert one(spark, text, T.char_ids(X, 5, phonemes=phonemes)) == [2, *want[:4]]
    assert one(spark, None, T.char_ids(X)) is None and one(spark, "", T.char_ids(X)) == [2, 3]
    assert "transform" not in spark.range(1).select(T.char_ids(F.lit("x")))._jdf.queryExecution().toString()


def test_fallback_durations_by_hand(spark):
    def plain(energy, tokens):
        n, upto, at = len(energy), [], 0.0
        for e in energy:
            at += e
            upto.append(at)
        every, edges = max([1e-8, *upto]), [0]
        for k in range(1, tokens + 1):
            e = n if k == tokens else round((sum(u < k / tokens * every for u in upto) + k / tokens * n) / 2)
            edges.append(min(max(e, edges[-1] + 1), max(n - (tokens - k), edges[-1])))
        return [b - a for a, b in zip(edges, edges[1:])]

    rows = [([(i * 37 % 11) / 7 for i in range(n)], t) for n in (0, 1, 5, 64) for t in (1, 2, 9, 64)] + [([0.0] * 6, 3), ([3.0, -1.0, 2.0, -4.0, 1.0], 3)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, (None, 2)])], "i int, e array<double>, t int").select("i", N.fallback_durations(F.col("e"), F.col("t")).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: plain(*r) for i, r in enumerate(rows)} | {len(rows): None}


def test_phoneme_frames_of_a_text(spark):
    words = ["ˈhəloʊ", "", "ː", "a", "bbb", "ˈhəloʊ", " x", None, "é\u2028ə"]
    frames = [20, 4, 0, 0, 7, 3, 5, 2, 9]
    rows = spark.createDataFrame([(0, words, frames), (1, [], []), (2, None, None), (3, words[::-1], frames[::-1])], "i int, w array<string>, f array<int>")
    each = {r.i: r.d for r in rows.select("i", align.phoneme_frames_each(F.col("f"), F.col("w")).alias("d")).collect()}
    alone = rows.select("i", F.zip_with("w", "f", lambda w, f: F.when(w.isNotNull(), align.phoneme_frames(f, w))).alias("d"))
    assert each == {r.i: r.d for r in alone.collect()}
    assert each[0][7] is None and each[1] == [] and each[2] is None


def test_phoneme_ids(spark):
    ids = one(spark, "a ˈəʊ̩", T.char_ids(X, phonemes=True))
    assert 1 not in ids and one(spark, ids, T.from_char_ids(X, phonemes=True), "array<int>") == "a ˈəʊ̩"
    assert one(spark, "ˈə", T.char_ids(X)) == [2, 1, 1, 3]
    assert one(spark, [29, 10_000], T.from_char_ids(X), "array<int>") == "a"


def test_stretches(spark):
    assert one(spark, "It is 3.5 now.. Go!\nOn? tail", T.stretches(X)) == ["It is 3.", "5 now.", " Go!", " On?"]
    assert one(spark, "", T.stretches(X)) == [] and one(spark, None, T.stretches(X)) is None


def test_ids_round_trip(spark):
    ids = one(spark, "ab é\t.", T.char_ids(X))
    assert ids[0] == 2 and ids[-1] == 3 and ids.count(1) == 1 and len(ids) == 7
    assert one(spark, ids, T.from_char_ids(X), "array<int>") == "ab <unk>."
    assert one(spark, "abcdef", T.char_ids(X, 3)) == ids[:3]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("the cat sat on it", "the dog sat it"), ("", ""), ("", "x"), ("x", ""), ("A, b c!", "a b c"), (" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i * 7 % 400}" for i in range(300)))])
def test_word_error_rate(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.word_error_rate(F.col("a"), F.col("b")).alias("w")).first()["w"]
    x, y = ([w for w in "".join(c if c.isalnum() or c == "'" else " " for c in s.lower()).split()] for s in (a, b))
    assert got == pytest.approx(levenshtein(x, y) / len(x) if x else float(bool(y)))


def test_pairwise(spark):
    assert one(spark, ["a b", "a b", "a c"], T.average_pairwise_wer(X), "array<string>") == pytest.approx(1 / 3)
    assert one(spark, ["a b", None], T.average_pairwise_wer(X), "array<string>") == 0


def test_variants_tags_mix_and_lines(spark):
    assert one(spark, "We went home.", T.variants(X)) == ["We went home!", "We went home?"]
    long = "It was a long and winding road to the sea, everyone said so and left."
    assert one(spark, long, T.variants(X))[-1] == "It was a long and winding road to the sea, everyone said so,and left."
    assert one(spark, "", T.variants(X)) == []
    clean, tags = T.split_tags(X)
    assert one(spark, "a <laugh> b <x>", clean) == "a b" and one(spark, "a <laugh> b <x>", tags) == ["<laugh>"]
    assert one(spark, "a=.6, b", T.parse_mix(X)) == {"a": 0.6, "b": 1.0}
    line = one(spark, "[gate] step 12: FLOW-TERM text dependence -3.5%", T.parse_gate_line(X))
    assert (line.step, line.percent) == (12, -3.5) and one(spark, "none", T.parse_gate_line(X)) is None
    assert one(spark, '{"a": {"b": [1, {"c": 5}]}}', T.dig(X, "a.b.1.c")) == "5"
    book = "head\n*** START OF X ***\nbody\n*** END OF X"
    assert one(spark, book, T.strip_markers(X, "*** START OF", "*** END OF")) == "body\n"
    assert one(spark, "plain", T.strip_markers(X, "*** START OF", "*** END OF")) == "plain"


A = "array<double>"


def test_levels_and_silence(spark):
    l = one(spark, [0.5, -1.0, 0.0, 0.0], N.levels(X), A)
    assert l.peak_db == 0 and l.clipping_ratio == 0.25 and l.rms_db == pytest.approx(20 * math.log10(math.sqrt(1.25 / 4)))
    assert one(spark, [], N.levels(X), A).clipping_ratio == 1
    assert one(spark, [0.0] * 2048, N.silence_ratio(X), A) == 1
    assert one(spark, [1.0] * 1024 + [0.0] * 1024, N.silence_ratio(X), A) == 0.5
    assert one(spark, [0.1] * 100, N.estimate_snr_db(X, 24000), A) is None
    tone = [(0.001 if i // 480 % 2 else 0.5) * (-1) ** i for i in range(480 * 20)]
    assert one(spark, tone, N.estimate_snr_db(X, 24000), A) == pytest.approx(20 * math.log10(500), abs=0.1)


def test_arrays(spark):
    assert one(spark, [1.0, 2.0, 3.0, 4.0, 5.0], N.fold(X, 2), A) == [[1, 2], [3, 4]]
    assert one(spark, [1.0], N.fold(X, 2), A) == []
    assert one(spark, [[1.0, 2.0]], N.unfold(X, 4), "array<array<double>>") == [1, 2, 0, 0]
    assert one(spark, [0.0, 5.0, 0.0, 0.0, 7.0], N.fill_nearest(X), A) == [5, 5, 5, 7, 7]
    assert one(spark, [0.0, 0.0], N.fill_nearest(X), A) == [0, 0]
    assert one(spark, [0.0, 1.0], N.resample(X, 2, 4), A) == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert one(spark, [0.5, -0.25], N.normalize_peak(X), A) == pytest.approx([0.6, -0.3])
    assert one(spark, [4.0, 1.0, 3.0, 2.0], N.upper_median(X), A) == 3
    assert one(spark, [4.0, 1.0, 3.0, 2.0], N.nearest_rank(X, 100), A) == 4
    assert one(spark, [], N.upper_median(X), A) is None
    assert math.isnan(one(spark, [1.0], N.segmental_snr(X, X), A))
    assert one(spark, [3.0, 4.0], N.cosine(X, X), A) == pytest.approx(1)
    assert one(spark, [[1.0, 2.0, 3.0]] * 2, N.mcd(X, X, 3), "array<array<double>>") == 0


def test_spans(spark):
    spans = one(spark, [2, 0, 3], N.token_spans(X, F.lit(5)), "array<int>")
    assert [(s.start, s.stop) for s in spans] == [(0, 2), (2, 3), (2, 5)]
    means = one(spark, [1.0, 3.0, 5.0, 5.0, 8.0], N.span_means(X, N.token_spans(F.array(F.lit(2), F.lit(0), F.lit(3)), F.lit(5))), A)
    assert means == [2, 5, 6]
    sub = spark.range(1).select(N.subtoken_spans(F.struct(F.lit(3).alias("start"), F.lit(5).alias("stop")), 4).alias("s")).first().s
    assert len(sub) == 4 and all(3 <= s.start < s.stop <= 6 for s in sub)
    for n in (1, 3, 10):
        d = one(spark, [0.1 * (i % 7) for i in range(10)], N.fallback_durations(X, F.lit(n)), A)
        assert len(d) == n and sum(d) == 10 and min(d) >= 1
    assert one(spark, [7, 8], N.expand_to_frames(X, F.array(F.lit(2), F.lit(1))), "array<int>") == [7, 7, 8]


@pytest.mark.parametrize("f0", [0.0, 60.0, 123.0, 440.0, 500.0])
def test_pitch_scales(spark, f0):
    back = one(spark, f0, N.bins_to_f0(N.f0_to_bins(X)), "double")
    assert back == pytest.approx(f0, rel=0.01)
    assert one(spark, 17, N.normalized_to_duration(N.duration_to_normalized(X)), "int") == 17
    assert one(spark, -40.0, N.normalized_to_energy(N.energy_to_normalized(X)), "double") == pytest.approx(-40)
