import hashlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import exact_dedup, simhash, substring_dedup

DOCS = "doc_id bigint, text string, kept string, digest int, fp string"
LONG = "word " * 30_000


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in pairs], DOCS)


def test_exact_dedup_matches_grouping_in_python(spark):
    pairs = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "abc "), (8, LONG), (9, LONG.upper()), (9, LONG), (None, "abc"), (None, "only")]
    docs = rows(spark, pairs)
    for history in (None, docs.where("doc_id < 5")):
        incoming = docs if history is None else docs.where("doc_id >= 5 OR doc_id IS NULL")
        got = exact_dedup.exact_dedup(incoming, history).collect()
        groups = defaultdict(list)
        norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for i, t in pairs:
            groups[norm(t)].append(i)
        want = []
        for i, t in pairs:
            own = groups[norm(t)]
            top = max([x for x in own if x is not None], default=None)
            want.append((i, top, len(own), i == top, hashlib.sha256(norm(t).encode()).hexdigest()))
        key = lambda r: str(r)
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)


def test_exact_dedup_says_what_history_had(spark):
    docs = rows(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "c")])
    got = {r.doc_id: r.seen_before for r in exact_dedup.exact_dedup(docs.where("doc_id > 2"), docs.where("doc_id <= 2")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(rows(spark, [])).collect() == []
    assert exact_dedup.deduplicated(rows(spark, [])).collect() == []


def test_deduplicated_keeps_columns(spark):
    out = exact_dedup.deduplicated(rows(spark, [(1, "a"), (2, "A"), (3, "b")]))
    assert out.columns == ["doc_id", "text", "kept", "digest", "fp"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 2**63, (n, 4)).astype(np.uint64)
    slots, levels = exact_dedup.build_mph(keys)
    assert sorted(slots) == list(range(n))
    assert (exact_dedup.find_slots(keys, levels) == slots).all()
    other = exact_dedup.find_slots(keys + np.uint64(1), levels)
    assert ((other >= -1) & (other < max(n, 1))).all()


def brute_simhash(text, words):
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    texts += [(10_000, None), (10_001, " \n"), (10_002, "One two"), (10_003, "one TWO"), (10_003, "one TWO"), (10_004, texts[5][1] + " tail")]
    fps = [brute_simhash(t, 4) for _, t in texts]
    root = closure(fps, 4)
    got = simhash.near_classes(rows(spark, texts)).collect()
    want = [(i, f"{f:016x}", texts[r][0]) for (i, _), f, r in zip(texts, fps, root)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_simhash_links_over_chains_and_hot_shards(spark):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**63, 300)}
    for _ in range(400):  # chains: each a few bits from one before
        base = int(rng.choice(list(fps)))
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            base ^= 1 << int(b)
        fps.add(base)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "node bigint, w0 bigint")
    root = closure(fps, 4)
    for tile in (20_000, 3):  # 3: almost all shards are cut into tiles
        label = simhash.components(simhash.links(frame, 4, simhash.blocks_for(len(fps), 4), tile=tile))
        got = {r.node: r.label for r in label.collect()}
        assert [got.get(i, i) for i in range(len(fps))] == root


def test_a_hot_group_of_near_copies_gives_links_in_proportion(spark):
    """5,000 fingerprints around one: a star each shard, not a link a pair; cut into tiles as well."""
    rng = np.random.default_rng(9)
    base, fps = int(rng.integers(0, 2**62)), set()
    while len(fps) < 5000:
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 4)), replace=False)))
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sorted(fps))], "node bigint, w0 bigint")
    keys = simhash.blocks_for(5000, 4)
    for tile in (20_000, 700):
        edges = simhash.links(frame, 4, keys, tile=tile)
        assert edges.count() <= 5000
        assert simhash.components(edges).select("label").distinct().count() == 1


def test_components_with_hubs_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", 100)
    star = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5400)] + [(9000, 9001)]
    label = {r.node: r.label for r in simhash.components(spark.createDataFrame(star, "a bigint, b bigint")).collect()}
    assert label == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(5000, 5401), 5000), 9000: 9000, 9001: 9000}


def test_blocks_cover_the_radius():
    for n in (10, 10**6, 10**9, 10**12):
        keys = simhash.blocks_for(n, 4)
        rng = np.random.default_rng(n % 97)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flip & (m % 2**64) == 0 for _, m in keys)


def test_near_duplicates_take_edits_and_leave_others(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    docs, want = [], {}
    for i in range(40):
        own = [word() for _ in range(300)]
        docs.append((i, " ".join(own)))
        if i % 2:
            own[100], own[200] = word(), word()
            docs.append((1000 + i, " ".join(own)))
            want[1000 + i] = i
        else:
            docs.append((1000 + i, " ".join(own[:150] + [word() for _ in range(150)])))
            want[1000 + i] = 1000 + i
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows(spark, docs)).collect()}
    assert got == {i: want.get(i, i) for i, _ in docs}
    left = simhash.deduplicated(rows(spark, docs))
    assert left.count() == 60 and left.columns == ["doc_id", "text", "kept", "digest", "fp"]


def jaccard_closure(texts):
    parts = [(t or "").lower().split() for t in texts]
    sets = [{tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} if p else set() for p in parts]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(sets[i], sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("part", [2_000, 5])
def test_near_duplicates_are_exactly_those_of_the_similarity(spark, monkeypatch, part):
    """Pairs from 0.70 to 0.95, half of them below 0.8, and a cloud whose members differ from each other by too much."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = []
    for i in range(60):
        own = [word() for _ in range(204)]
        texts.append(" ".join(own))
        new = 18 + i % 14  # fresh words at the end: 200 - new of 200 + new shingles stay
        texts.append(" ".join(own[:-new] + [word() for _ in range(new)]))
    base = [word() for _ in range(204)]
    for i in range(30):
        texts.append(" ".join(base[:-24] + [word() for _ in range(24)]))
        texts.append(" ".join(base[:-10] + [word() for _ in range(10)]))
    texts += ["", None, "one two", "One  TWO", "three"]
    root = jaccard_closure(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert 20 < sum(root[k] == root[k + 1] for k in range(0, 120, 2)) < 40


def test_near_duplicate_recall_at_the_threshold(spark):
    """150 pairs of 200 shingles each at a similarity of 0.802, 0.852, 0.905 and 0.794, at the settings used."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts, kind = [], []
    for shared in (178, 184, 190, 177):
        for _ in range(150):
            own = [word() for _ in range(204)]
            texts += [" ".join(own), " ".join(own[: shared + 4] + [word() for _ in range(200 - shared)])]
            kind.append(shared)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows(spark, list(enumerate(texts)))).collect()}
    linked = [got[2 * k] == got[2 * k + 1] for k in range(len(kind))]
    found = {s: sum(x for x, k in zip(linked, kind) if k == s) for s in set(kind)}
    assert found[178] >= 0.95 * 150 and found[184] >= 0.97 * 150 and found[190] == 150 and found[177] == 0
    assert len(set(got.values())) == len(texts) - sum(linked)  # nothing else links


def test_simhash_of_nothing(spark):
    assert simhash.near_classes(rows(spark, [])).collect() == []
    assert simhash.near_duplicates(rows(spark, [])).collect() == []


def brute_substrings(pairs):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in pairs]
    rank = lambda i: 2**63 - 1 if i is None else i
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 2**64), rank(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < rank(i):
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


def test_substrings_match_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    passage = " ".join(f"p{i}" for i in range(40))
    line = " ".join(f"l{i}" for i in range(9))
    docs += [(5000 + i, f"start{i} {passage} mid{i} {line} end{i} x{i} y{i} z{i} u{i} v{i}") for i in range(60)]
    docs += [(6000, None), (6001, ""), (6002, " \t\n"), (6003, "a " * 500), (6004, "a " * 500), (None, passage), (6005, passage), (6005, passage), (6006, LONG), (6007, "x" * 50_000 + " " + LONG)]
    got = substring_dedup.dedup_substrings(rows(spark, docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=key) == sorted(brute_substrings(docs), key=key)


def test_substrings_with_hot_minimisers_and_many_chunks(spark, monkeypatch):
    for name, value in (("CHUNK", 3000), ("HOT", 10_000_000), ("BUCKET", 5000)):
        monkeypatch.setattr(substring_dedup, name, value)
    line = " ".join(f"l{i}" for i in range(9))
    docs = [(i, f"a{i} b{i} c{i} d{i} e{i} {line} f{i % 7} g{i % 7} h{i % 7} i{i % 7} j{i % 3} k m n o") for i in range(2000)]
    got = substring_dedup.dedup_substrings(rows(spark, docs)).collect()
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in got) == sorted(brute_substrings(docs))


def test_substrings_of_nothing(spark):
    assert substring_dedup.dedup_substrings(rows(spark, [])).collect() == []


def test_very_short_near_copies_all_link(spark):
    """Four shingles against five of them, 0.8 exactly: a fingerprint of so few would miss one in five."""
    docs = []
    for k in range(150):
        own = [f"a{k}x{j}" for j in range(9)]
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:-1]))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows(spark, docs)).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_settings_follow_the_number_of_texts():
    """Shards stay as large, and a pair at 0.8 is as likely to share a run."""
    import math

    same = 1 - math.acos(1.6 / 1.8) / math.pi
    assert simhash.settings_for(0, 0.8) == simhash.settings_for(80_000_000, 0.8) == (6, 12)
    for n in (10**8, 10**9, 10**10, 10**11, 10**12):
        width, bits = simhash.settings_for(n, 0.8)
        runs = width * len(range(0, 65 - bits, simhash.STEP))
        assert n / 2**bits <= 80_000_000 / 2**12 and 1 - (1 - same**bits) ** runs >= 0.99 and width <= 100
