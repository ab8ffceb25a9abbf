"""Empty tables, repeated rows, clashing columns and other awkward input, one operator after another."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from gridlens.llm import byte_pairs, mixing, nearest, quality, secrets, token_files
from gridlens.llm.common import fresh_path

TEXT = 'some words, password = "hunter22x" and 0af30af30af30af30af30af3'


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(1, TEXT, "a", "en", 1)] * 3 + [(1, "other text of one id", "a", "en", 1), (None, TEXT, None, None, None), (2, None, "b", "en", 2)]
    return spark.createDataFrame(rows * 2, "doc_id bigint, text string, source string, lang string, ids int").repartition(3)


def test_token_files_of_repeated_rows(spark, repeated):
    path = fresh_path(spark, "test-tokens")
    token_files.write_tokens(repeated, path, public_tokenizers.path("word_bpe_49k.json"))
    found = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.start)
    assert len(found) == 12
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(12)]
    assert [r.doc_id for r in found] == [None] * 2 + [1] * 8 + [2] * 2
    assert len({(r.n_tokens, r.ids_crc32) for r in found if r.doc_id == 1}) == 2


def test_chosen_documents_skip_row_groups(spark, monkeypatch):
    """A scan for one id hands on the rows of its own row groups, not those of the file."""
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 1 << 16)
    docs = spark.range(0, 40000, 2).selectExpr("id as doc_id", "concat('text number ', id, ' of many words') as text")
    path = fresh_path(spark, "test-tokens")
    token_files.write_tokens(docs.coalesce(1), path, public_tokenizers.path("word_bpe_49k.json"))

    def scanned(ids):
        rows = token_files.read_tokens(spark, path, ids)
        assert sorted(r.doc_id for r in rows.collect()) == [i for i in ids if i % 2 == 0]
        leaf = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return leaf.metrics().apply("numOutputRows").value()

    stride = token_files.INDEX_STRIDE
    assert 0 < scanned([20000]) <= 2 * stride
    # An odd id lies inside the range of some row group; only its Bloom filter can tell that it is not there.
    assert sum(scanned([i]) for i in (20001, 20003, 20005, 20007)) <= 2 * stride


def test_byte_pairs_of_repeated_rows_and_none(repeated):
    file = public_tokenizers.path("byte_bpe_50k.json")
    found = byte_pairs.token_digests(repeated, file).collect()
    assert len(found) == 12 and len({tuple(r)[1:] for r in found if r.doc_id == 1}) == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in found if r.doc_id == 2} == {(2, 0, empty, empty)}
    assert byte_pairs.token_digests(repeated.limit(0), file).count() == 0


def test_secrets_of_repeated_rows(repeated):
    found = secrets.find_secrets(repeated).collect()
    assert len(found) == 12
    assert {(r.n_assign, r.n_access, r.n_hex) for r in found if r.spans} == {(1, 0, 1)}
    assert sum(bool(r.spans) for r in found) == 8


def test_mixing_of_repeated_rows(repeated):
    found = mixing.mix_sources(repeated).collect()
    assert len(found) == 12
    assert len({(r.doc_id, r.size, r.taken) for r in found}) == len({(r.doc_id, r.size) for r in found})


def test_nearest_of_awkward_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, -float(i)], "v", 5) for i in range(120)]
    rows += rows[:10] + [(0, [1.0, 2.0], "v", 5), (7, [3.0, 4.0], "v", 5), (9, [], "v", 5), (None, [1.0, 1.0, 1.0], "v", 5), (50, None, "v", 5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, vector string, shard int")
    some = nearest.quantized(frame, "vec_id", "embedding")
    found = nearest.top_k(some, some.filter("vec_id % 50 = 0")).collect()
    kept = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, *_ in rows if i is not None and v]
    want = []
    for q in sorted({(i, tuple(v)) for i, v in kept if i % 50 == 0}):
        scores = sorted((-int(np.dot(v, q[1])), i) for i, v in kept if i != q[0] and len(v) == len(q[1]))[:5]
        want += [(q[0], rank + 1, i, -score) for rank, (score, i) in enumerate(scores)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert nearest.top_k(some.limit(0), some.limit(0)).count() == 0


def test_labels_of_one_id_that_disagree(spark):
    docs = spark.createDataFrame([(i, f"{'good words' if i % 2 else 'BAD!! STUFF!!'} {i}" * 8) for i in range(60)] * 2, "doc_id bigint, text string")
    labels = [(i, i % 2) for i in range(60)]
    same = quality.fit(docs, spark.createDataFrame(labels + [(0, 1), (2, 1)], "doc_id bigint, quality int"))
    once = quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert (same.share, same.weights) == (once.share, once.weights)
    scores: dict = {}
    for r in quality.quality_scores(docs, once).collect():
        assert scores.setdefault(r.doc_id, r.score) == r.score


def test_pipeline_of_empty_and_repeated_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts = [" ".join(f"w{i}x{j % 17}" for j in range(40 + i)) for i in range(30)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows = rows * 2 + [(None, "", "en", "s0", 0), (None, None, None, None, None)]
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels = [(i, 1) for i in range(20)] if some else []
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int".replace(", toxic int", "")).write.parquet(
            str(tmp_path / name / "labels.parquet")
        )
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    found = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    counts: dict = {}
    for r in found:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts) <= {*range(30), None}
    assert all(n <= 2 for i, n in counts.items() if i is not None) and len(counts) > 15
