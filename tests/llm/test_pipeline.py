"""The pipeline's stages against plain versions of what each must do."""

import base64
import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers as P
from millrace.llm import common, mixing, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BAD = ["stupid", "idiot", "worthless", "scum", "moron"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Clean, toxic, copied and edited documents with labels."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioustnrl"), int(rng.integers(3, 8))))
    vocabulary = [word() for _ in range(400)]
    docs, labels, toxic, copies, edits = [], [], set(), {}, {}
    for i in range(300):
        words = [vocabulary[k] for k in rng.integers(0, 400, 120)]
        if i % 5 == 0:
            words[60] = BAD[i // 5 % 5]
            words[62] = BAD[(i // 5 + 1) % 5]
            toxic.add(i)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
        if i % 7 == 1 and i % 5:
            docs.append((1000 + i, " ".join(words).upper()))
            copies[i] = 1000 + i
        if i % 7 == 2 and i % 5:
            words[100] = "changed"
            docs.append((2000 + i, " ".join(words)))
            edits[2000 + i] = i
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in docs] + [(9000, None, None, None, None), (9001, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, toxic, copies, edits


def test_stages(spark, made):
    path, toxic, copies, edits = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    every = {r.doc_id for r in docs.collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, path)
    assert clean.columns == COLUMNS
    left = {r.doc_id for r in clean.collect()}
    assert len(toxic & left) <= 2 and len((every - toxic) - left) <= 2
    clean = docs.where(~docs["doc_id"].isin(sorted(toxic)))
    single = corpus_pipeline.drop_copies(spark, clean, path)
    assert single.columns == COLUMNS
    # The null text and the empty one are equal: the larger id stays.
    assert {r.doc_id for r in single.collect()} == every - toxic - set(copies) - {9000}
    apart = corpus_pipeline.drop_near_copies(spark, single, path)
    assert apart.columns == COLUMNS
    assert {r.doc_id for r in apart.collect()} == every - toxic - set(copies) - {9000} - set(edits)
    mixed = corpus_pipeline.mix_sources(spark, apart, path)
    assert mixed.columns == COLUMNS
    want = {r.doc_id: r.copies for r in mixing.mix(apart).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == want
    tokens = corpus_pipeline.tokenize(spark, mixed, path).collect()
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(tokens) == sum(want.values())
    assert all(r.round_trip and r.ids == other.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in tokens)


def test_run_is_the_stages_in_order(spark, made):
    path, toxic, copies, edits = made
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert not got & (set(copies) | set(edits)) and len(got & toxic) <= 2 and len(got) > 150


def test_null_and_repeated_ids(spark, made):
    rng = np.random.default_rng(8)
    text = lambda: " ".join("".join(rng.choice(list("aeioustnrl"), 6)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    texts = [(None, a), (None, a), (None, a.upper()), (None, near(a)), (1, b), (1, b), (2, b), (2, b), (1, c), (3, d), (3, near(d)), (3, e), (None, e), (None, f)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    single = corpus_pipeline.drop_copies(spark, docs, made[0])
    assert single.columns == COLUMNS
    got = Counter((r.doc_id, r.text.lower()) for r in single.collect())
    assert got == Counter([(None, a), (None, near(a)), (2, b), (1, c), (3, d), (3, near(d)), (3, e), (None, f)])
    for found in (single, docs):
        apart = [(r.doc_id, r.text.lower()) for r in corpus_pipeline.drop_near_copies(spark, found, made[0]).collect()]
        assert len(apart) == 6 and all(sum(t in (x, near(x)) for _, t in apart) == 1 for x in (a, b, c, d, e, f))
    mixed = corpus_pipeline.mix_sources(spark, docs, made[0])
    assert mixed.columns == COLUMNS
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want and sum(want.values()) <= 2 * len(texts)


def test_kept_tables_can_be_released(spark):
    kept = common.keep(spark.range(3), "some")
    path = common._KEPT[-1]
    assert os.path.exists(path) and kept.count() == 3
    common.release(spark)
    assert not os.path.exists(path) and not common._KEPT


def test_a_run_leaves_the_shared_folder_empty(spark, made, tmp_path):
    shared, before = common.shared_dir(spark), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    common.release(spark)
    corpus_pipeline.run(spark, made[0]).write.parquet(str(tmp_path / "out"))
    tables = lambda: [n for n in os.listdir(shared) if re.search(r"-[0-9a-f]{32}$", n)]
    assert len(tables()) == 1  # the last stage's input
    common.release(spark)
    assert tables() == []
    simhash.near_duplicates(spark.read.parquet(f"{made[0]}/documents.parquet")).count()
    common.release(spark)
    assert tables() == [] and before in ("10000", "1000")


def test_empty_documents(spark, made, tmp_path):
    path = str(tmp_path)
    docs = spark.read.parquet(f"{made[0]}/documents.parquet").limit(0)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{made[0]}/labels.parquet").limit(0).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert toxicity.PASSAGE == 16
