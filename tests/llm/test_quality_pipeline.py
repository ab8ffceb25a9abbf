"""The compression classifier, the stage that keeps one of each near copy, and the whole pipeline."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gridlens.llm import jaccard, quality

ROWS = "doc_id bigint, text string, lang string, source string, score double, quality int"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(400)]


@pytest.fixture(scope="module")
def corpus(spark, words):
    """Plain prose (label 1) and prose of upper-case words with marks (label 0); null, empty and
    one long text; columns whose names clash with the operator's."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(30, 200))) + "."
        if i % 3 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", f"s{i % 2}", 0.5, 9))
        labels.append((i, 0 if i % 3 == 0 else 1))
    rows += [(300, None, None, None, None, None), (301, "", "en", "s0", 0.0, 0), (None, "abc", "en", "s1", 0.0, 0)]
    rows.append((302, " ".join(rng.choices(words, k=40_000)), "en", "s1", 0.0, 1))
    labels += [(300, None), (999, 1)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    found = {r.doc_id: r.score for r in quality.quality_scores(docs, quality.fit(docs, labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((found[i] >= quality.THRESHOLD) == (i % 3 != 0) for i in held)
    assert right / len(held) >= 0.95
    assert len(found) == 304 and all(0 <= s <= 1 for s in found.values())
    assert found[300] == found[301]


def test_sample_does_not_set_the_odds(spark, words):
    """Classes that overlap, five good texts to a bad one: a sample that holds as many of each class
    scores as the whole does."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(600):
        good = i % 6 != 0
        some = rng.choices(words[:260] if good else words[140:], k=rng.randint(5, 12))
        rows.append((i, " ".join(some), "en", "s", 0.0, 0))
        labels.append((i, int(good)))
    rows.append((600, "", "en", "s", 0.0, 0))
    docs = spark.createDataFrame(rows, ROWS)
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    known = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2]
    share = sum(i % 6 != 0 for i in known) / len(known)
    for sample in (quality.SAMPLE, 60):
        model = quality.fit(docs, labels, sample=sample)
        scores = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
        assert model.share == scores[600] == pytest.approx(share)
        assert sum(scores[i] for i in known) / len(known) == pytest.approx(share, abs=0.06)


def test_weights_are_repeated_rows():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 2)), np.arange(40) % 2.0
    times = np.where(y == 1, 5, 1)
    repeated = quality._logistic(np.repeat(x, times, 0), np.repeat(y, times), np.ones(times.sum()))
    assert quality._logistic(x, y, times.astype(float)) == pytest.approx(repeated)


def test_scores_without_labels(spark, corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.quality_scores(docs, model).collect()} == {0.5}
    one_class = quality.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in quality.quality_scores(docs, one_class).collect()} == {1.0}
    assert quality.quality_scores(docs.limit(0), model).count() == 0


def test_keep_good_keeps_all_columns(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels)
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
    expected = {i for i, s in scores.items() if s >= quality.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == expected


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(50).select("id", quality.fold(F.col("id")).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_one_of_each(spark, words):
    rng = random.Random(11)
    base = rng.choices(words, k=120)
    near = [*base[:-1], "changed"]
    other = rng.choices(words, k=90)
    texts = [(5, base), (2, near), (9, base), (4, other), (None, other), (4, other)]
    rows = [(i, " ".join(t), "en", "s", 0.0, 0) for i, t in texts]
    rows += [(20, None, "en", "s", 0.0, 0), (20, " \n", "en", "s", 0.0, 0), (21, "", "en", "s", 0.0, 0), (22, "one", "en", "s", 0.0, 0)]
    docs = spark.createDataFrame(rows, ROWS)
    kept = jaccard.one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 20, 20, 21, 22]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_text_key_is_the_hash_of_the_session(spark):
    row = spark.sql("select xxhash64('aé') as key").first()
    assert row.key % (1 << 64) == xxhash.xxh64_intdigest("aé".encode(), 42)


def test_pipeline_stages(spark, corpus, tmp_path_factory):
    docs, labels = corpus
    sf_dir = str(tmp_path_factory.mktemp("pipeline"))
    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{sf_dir}/documents.parquet")
    labels.write.parquet(f"{sf_dir}/labels.parquet")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, counts = kept.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == names
        counts.append(kept.count())
    assert counts[0] < 304 and counts[1] <= counts[0] and counts[2] == counts[1]
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert found.count() == counts[3]
