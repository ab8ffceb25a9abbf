"""Cross-tokenizer alignment against a plain version, with rare pairs on both ways."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridlens.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    "The quick brown fox", "The quick brown fox", "a  b   c\n\n  d\te", " lead", "trail ", "trail   ", " ", "  ", "\n", "x",
    "", None, "blank ▁ sign", "nul \x00 byte", "<|endoftext|> <s> </s> <unk> <0x41>", "ünïcödé 日本語のテキスト 🙂👩‍👩‍👧 ﬁ ２",
    "don't we'll  they've 12345 1,234.5 !!??", " non breaking em \x1c sep\x85next", "aa" * 400, "word " * 3000 + "end",
]


def plain(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    symbols = alignment.byte_symbols()
    out, counts, links = [], Counter(), []
    for doc, text in rows:
        ids_a = ids_b = []
        if text:
            ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [
                bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                for i in ids_b
            ]
            if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
                ids_a = ids_b = []
        if not ids_a:
            out.append((doc, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a = [sum(map(len, bytes_a[: i + 1])) for i in range(len(ids_a))]
        ends_b = [sum(map(len, bytes_b[: i + 1])) for i in range(len(ids_b))]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, start = [], 0
        for cut in cuts:
            ga = [x for x, e in zip(ids_a, ends_a) if start < e <= cut]
            gb = [x for x, e in zip(ids_b, ends_b) if start < e <= cut]
            groups.append((ga, gb))
            start = cut
        pairs = [(ga[-1], gb[-1]) for ga, gb in groups]
        counts.update(pairs)
        links.append(pairs)
        whole = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, len(ids_a), len(ids_b), len(groups), hashlib.sha256(whole.encode()).hexdigest()))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [
        (doc, n_a, n_b, g, len(p), sum(counts[x] == highest[x[1]] for x in p), sum(counts[x] for x in p), sha)
        for (doc, n_a, n_b, g, sha), p in zip(out, links)
    ]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeéñ", k=rng.randint(2, 8))) for _ in range(200)]
    rows = TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(rows + rows[20:30])]
    schema = "doc_id bigint, text string, row string, pairs string, n_a int"
    return spark.createDataFrame([(*r, "z", "y", 1) for r in rows], schema).repartition(3), rows


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 10, 0])
def test_links_equal_plain_version(corpus, frequent):
    docs, rows = corpus
    aligned = alignment.align(docs, A, B)
    found = alignment.document_links(aligned, alignment.link_counts(aligned, A, B), A, B, frequent).collect()
    assert ordered(found) == ordered(plain(rows))


def test_stretches_are_whole_texts_cut_where_both_tokenizers_end(corpus):
    _, rows = corpus
    both = alignment.Vocabularies(A, B)
    for _, text in rows:
        if text:
            cut = both.cut(f" {text}")
            assert "".join(cut) == f" {text}"
            whole = both.tokens([f" {text}"])[0]
            ids_a, ids_b, good = both.encode(cut)
            assert all(good) == (whole is not None)
            if whole:
                assert (list(ids_a), list(ids_b)) == (list(whole[0]), list(whole[1]))


def test_a_small_table_gives_the_same_links(corpus, monkeypatch):
    _, rows = corpus
    texts = [t or "" for _, t in rows]
    large, small = alignment.Vocabularies(A, B), alignment.Vocabularies(A, B)
    want, vector = large.align(texts)
    monkeypatch.setattr(alignment, "KEPT_STRETCHES", 3)
    monkeypatch.setattr(alignment, "JOINED_CHARS", 20)
    found = [small.align([t]) for t in texts]
    assert len(small.place) < len(large.place)
    for name in ("n_a", "n_b", "n_groups", "groups_sha256", "same", "same_n", "pairs", "pairs_n"):
        assert [x for c, _ in found for x in c[name].to_pylist()] == want[name].to_pylist()
    assert sum(v for _, v in found).tolist() == vector.tolist()


def test_vectors_hold_the_one_to_one_links(corpus):
    docs, _ = corpus
    counts = alignment.link_counts(alignment.align(docs, A, B), A, B).collect()
    both = alignment.loaded(A, B)
    assert any(r.same for r in counts) and any(not r.same for r in counts)
    assert all(both.a_text[r.a] == both.b_text[r.b] for r in counts if r.same)


def test_empty_table(spark):
    aligned = alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), A, B)
    assert alignment.document_links(aligned, alignment.link_counts(aligned, A, B), A, B).count() == 0
