import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from shared import make
from tokenizers import Tokenizer

from marlstone.llm import alignment as A

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", " ", "  ", "a", "a▁b", "▁", "<|endoftext|>", "x <|endoftext|> y", "<s> </s> <unk> <0x41>", "漢字かな", "\U0001f600\U0001f601 ok", "a\x00b", "\n\n\t x", "é é", "don't", "1234 567", "a" * 300, " lead", "trail ", "\xa0　", "<pad>"]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = A.byte_letters()
    return t, sp, {i: bytes(letters[c] for c in w) for w, i in t.get_vocab().items() if all(c in letters for c in w)}


def aligned(text, libraries):
    """Groups of (ids of A, ids of B), from the libraries, byte by byte."""
    t, sp, spelt = libraries
    if not text:
        return []
    raw = (" " + text).encode()
    a = [(i, spelt[i]) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return []
    out, left, right, x, y = [], [], [], 0, 0
    while a or b:
        if x <= y and a:
            i, w = a.pop(0)
            left.append(i)
            x += len(w)
        else:
            i, w = b.pop(0)
            right.append(i)
            y += len(w)
        if x == y:
            out.append((left, right))
            left, right = [], []
    return out


def brute(rows, libraries):
    groups = [aligned(t, libraries) for _, t in rows]
    links = [Counter((a, b) for left, right in g for a in left for b in right) for g in groups]
    count = Counter(p for one in links for p in one)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for (d, _), g, one in zip(rows, groups, links, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d if d is not None else -1, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(one.values()), written, sum(k for p, k in one.items() if count[p] == best[p[0]]), sum(k * count[p] for p, k in one.items())))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in df.collect())


@pytest.fixture(scope="module")
def rows(corpus):
    return [(d, t) for d, t in corpus if not t or len(t) < 50_000] + [(100 + k, t) for k, t in enumerate(TRICKY * 2)]


@pytest.mark.parametrize("held", [1 << 18, 40, 0])
def test_against_brute_force(spark, rows, libraries, held):
    """Whether all, some or no pairs' counts are broadcast."""
    assert rows_of(A.cross_align(make(spark, rows), BYTES, PIECES, held=held)) == brute(rows, libraries)


def test_whole_table_and_digest(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {r[0]: (*r[1:5], hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "", *r[6:]) for r in brute(rows, libraries)}
    got = {r.doc_id: tuple(r)[1:] for r in A.query(spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()}
    assert got == want


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(BYTES, PIECES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_groups_of_any_text(aligner, libraries, texts):
    got = aligner.align(texts).written()
    assert got == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in aligned(t, libraries)) for t in texts]


def test_links_a_few_at_a_time(aligner, monkeypatch):
    texts = ["one two three " * 40, "漢字" * 50, "", "zzzzqqqq" * 30]
    whole = [x.tolist() for x in aligner.align(texts).links()]
    monkeypatch.setattr(A, "TOGETHER", 3)
    assert [x.tolist() for x in aligner.align(texts).links()] == whole


def test_labels_and_spans():
    import numpy as np

    label = A.labels(np.array([1, 3, 5, 9]), np.array([2, 3, 9]), 9)
    assert label == b"AB*.A...*"
    assert [x.tolist() for x in A.groups(label)] == [[3, 6], [2, 2], [2, 1]]


def test_empty_table_and_clashing_names(spark, empty, clashing, corpus, libraries):
    assert A.cross_align(empty, BYTES, PIECES).collect() == []
    assert rows_of(A.cross_align(clashing, BYTES, PIECES)) == brute(corpus, libraries)
