import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import crosstoken, importance, ngram_join
from millrace.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, node int, size string, digest string, entry int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x", None, 2) for i, t in pairs], DOCS)


# --- n-gram join -------------------------------------------------------------------------------------


def shingles(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def brute_components(pairs, num, den, words):
    sets = [shingles(t, words) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    common = Counter()
    for ks in where.values():
        common.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    low = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        low[find(k)].append(i)
    name = {r: min([i for i in ids if i is not None], default=None) for r, ids in low.items()}
    return sorted(((i, len(s), name[find(k)]) for k, ((i, _), s) in enumerate(zip(pairs, sets))), key=str)


def planted():
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(4000)]
    passage = [words[i] for i in rng.integers(0, 4000, 60)]
    pairs, n = [], 0

    def add(parts):
        nonlocal n
        pairs.append((n, " ".join(parts)))
        n += 1

    for size in (7, 9, 12, 30, 120, 600):
        for _ in range(4):
            base = [words[i] for i in rng.integers(0, 4000, size)]
            add(base)
            for changes in range(1, 4):  # near copies on both sides of the threshold
                other = list(base)
                for at in rng.choice(size, min(size, max(1, changes * size // 90)), replace=False):
                    other[at] = "new" + str(n)
                add(other)
            add(base[: size - 1])
    for k in range(60):  # a hot group of near copies, and texts that share one passage only
        add([*passage, f"tail{k}"])
        add([*passage, *[words[i] for i in rng.integers(0, 4000, 40)]])
    pairs += [(None, pairs[0][1]), (n, None), (n + 1, " \n"), (n + 2, "One two"), (n + 3, "one TWO"), (n + 3, "one TWO"), (None, "nobody else says this"), (n + 5, LONG), (n + 6, LONG + " end")]
    return pairs


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80)])
def test_ngram_join_matches_brute_force(spark, words, num):
    pairs = planted()
    got = ngram_join.jaccard_components(rows(spark, pairs), num / 100, words).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(pairs, num, 100, words)


def test_ngram_join_with_combinations_matches_brute_force(spark):
    """Almost all shingles count as frequent, so that pairs and triples of them carry the join."""
    pairs = planted()
    want = brute_components(pairs, 85, 100, 4)
    for rare, together in ((1, 2), (1, 3)):
        got = ngram_join.jaccard_components(rows(spark, pairs), 0.85, 4, rare, together).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_query_ngram_join_matches_brute_force(spark, sf):
    got = QUERIES["op11_ngram_join"](spark, sf).collect()
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == brute_components(pairs, 85, 100, 4)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(rows(spark, [])).collect() == []
    assert {tuple(r) for r in ngram_join.jaccard_components(rows(spark, [(None, None), (4, "")])).collect()} == {(None, 0, None), (4, 0, 4)}


def test_similar_sets_share_an_entry():
    """The guarantee of the prefixes, over random sets and counts, with one by one, pairs and triples."""
    rng, share = np.random.default_rng(8), Fraction(85, 100)
    bounds = ngram_join.size_classes(5000, share)
    for _ in range(150):
        n = int(rng.integers(6, 400))
        a = np.sort(rng.choice(2**40, n, replace=False)).astype(np.uint64)
        lose = int(rng.integers(0, 3 + n // 6))
        b = np.sort(np.concatenate([a[rng.permutation(n)[lose:]], (2**41 + rng.integers(0, 2**40, int(rng.integers(0, 3)))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if same * 100 < 85 * (len(a) + len(b) - same):
            continue
        counts = {int(x): int(rng.integers(2, 100)) for x in np.union1d(a, b)}
        for together in (2, 3):
            entries = []
            for s in (a, b):
                held = s[: int(ngram_join.lacking(np.int64(len(s)), share) + ngram_join.extension(np.int64(len(s)), together))]
                shared = np.array([x for x in held if (x in a) and (x in b) or counts[int(x)] > 5], np.uint64)
                entries.append(ngram_join.entries_of(shared, np.array([counts[int(x)] for x in shared]), len(s), len(held), bounds, share, 30, together))
            assert np.intersect1d(*entries).size


def test_a_hot_entry_costs_a_row_a_batch():
    entry, node = np.full(100_000, 7, np.int64), np.arange(100_000)
    a, b, e, head = ngram_join._stars(entry, node)
    assert len(a) == 99_999 and set(b.tolist()) == {0} and list(e) == [7] and list(head) == [0]


# --- cross-tokenizer alignment -----------------------------------------------------------------------

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(pairs):
    one = Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    chars = {v: k for k, v in {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}.items()}
    spare = iter(range(256, 400))
    chars |= {chr(next(spare)): b for b in range(256) if b not in chars.values()}
    out, count = [], Counter()
    for i, text in pairs:
        text = text or ""
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        spell_a = [bytes(chars[c] for c in one.id_to_token(x)) for x in a]
        spell_b = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        want = (" " + text).encode()
        if not text or b"".join(spell_a) != want or b"".join(spell_b) != want:
            out.append((i, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in spell_a]).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()
        groups, s, t = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[s:p], b[t:q]))
            s, t = p, q
        count.update((x[-1], y[-1]) for x, y in groups)
        out.append((i, a, b, groups))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    for i, a, b, groups in out:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield (i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha)


ODD = ["", None, " two  blanks", "tab\tand\nline", "<|endoftext|></s>", "‑ “quoted” ▁ mark", "日本語とemoji 🙂🙂", "x" * 5000, "a b" * 3000, "éé", "\x00\x01", "same", "same", " " * 3000, "ａ full width"]


def test_alignment_matches_brute_force(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:80]
    pairs += [(10_000 + k // 2 if k % 5 else None, t) for k, t in enumerate(ODD)] + [pairs[3]] * 5
    want = sorted(brute_alignment(pairs), key=str)
    got = crosstoken.cross_tokenizer(rows(spark, pairs), *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    texts = crosstoken.keep(crosstoken.aligned_texts(rows(spark, pairs), *PATHS), "t")
    assert texts.count() == len({t or "" for _, t in pairs})
    counts = crosstoken.pair_counts(texts)
    few = crosstoken.measured(texts, counts, spread=50)  # most pairs meet their count in the shuffled join
    many = crosstoken.measured(texts, counts)
    key = lambda df: sorted((r.digest, r.n_best, r.count_sum) for r in df.collect())
    assert key(few) == key(many)
    spelled = crosstoken.lexicon(counts, *PATHS)
    assert spelled.count() == counts.count()


def test_query_alignment_matches_brute_force(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_cross_tokenizer"](spark, sf).collect())) == sorted(brute_alignment(pairs))


def test_alignment_of_nothing(spark):
    assert crosstoken.cross_tokenizer(rows(spark, []), *PATHS).collect() == []
    only = crosstoken.cross_tokenizer(rows(spark, [(1, None)]), *PATHS).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_pairs_pack_and_unpack():
    pairs, times = np.array([3, 5, 5 << 24, 2**39], np.int64), np.array([1, 300, 2, 7], np.int64)
    back = crosstoken.unpack(crosstoken.pack(pairs, times))
    assert (back[0] == pairs).all() and (back[1] == times).all()


# --- importance resampling ---------------------------------------------------------------------------


def brute_resample(pairs, target, share, low, high, buckets, least, seed):
    def features(text):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    docs = [(i, *features(t)) for i, t in pairs]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in set(s)}
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: share[0] * len(able) // share[1]]
    left, result = Counter(out), []
    for k, r in enumerate(drawn, 1):
        left[r] -= 1
        result.append((*r, k))
    return sorted([*result, *[(*r, None) for r in left.elements()]], key=str)


@pytest.mark.parametrize("low,high,share", [(1, 1, (10, 100)), (1, 2, (50, 100)), (2, 3, (1, 1))])
def test_resample_matches_brute_force(spark, sf, low, high, share):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pairs += [(None, None), (None, pairs[0][1]), (None, pairs[1][1]), (7_000, ""), (7_001, "é ÀB\x7fc-9 _"), (7_002, LONG), pairs[2], pairs[2], pairs[2]]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bench = spark.createDataFrame([(t, 1) for t in [*target, None]], "text string, doc_id int")
    want = brute_resample(pairs, target, share, low, high, 1000, 20, 7)
    got = importance.resample(rows(spark, pairs), bench, share, low, high, 1000, 20, 7)
    assert got.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_resample_of_nothing(spark):
    empty, some = rows(spark, []), rows(spark, [(1, "a b c"), (2, None)])
    assert importance.resample(empty, empty).collect() == []
    got = importance.resample(some, empty, least=1, share=(1, 1)).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got if r["rank"]) == [(1, 5, 1)] and len(got) == 2


def test_features_follow_the_words():
    bucket, doc, sizes = importance.feature_buckets(pa.array(["One two one", None, "..", "two"]), 1, 2, 2**32)
    assert sizes.tolist() == [3, 0, 0, 1]
    want = [*map(zlib.crc32, (b"one", b"two", b"one", b"two", b"one two", b"two one"))]
    assert bucket.tolist() == want and doc.tolist() == [0, 0, 0, 3, 0, 0]
