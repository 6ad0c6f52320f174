import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shared import make
from tokenizers import Tokenizer

from marlstone.llm import binary_output as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", " ", "  ", "a", " a ", "a  b", "a \n b", "\n\n", "x\t y", "don't we'll", "a'b 's", "1234 567", "漢 字", "\U0001f600 \U0001f601", "<|endoftext|>", "a <|endoftext|> b", "\xa0 x\xa0", "  y", "a\x85 b", "été  ", "é x", "!!! ???", " !", "a ! b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_256), st.integers(0, 2**32 - 1), st.just(7)), max_size=3000), st.sampled_from([1, 8, 128, 1024]), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_round_trip(ids, block, percentile):
    a = np.array(ids, np.uint32)
    p = B.pack(a, block, percentile)
    assert (B.unpack(p) == a).all()
    n = -(-len(a) // block)
    assert (B.unpack(p, n // 2, n // 2 + 1) == a[n // 2 * block : (n // 2 + 1) * block]).all()


def test_exceptions_do_not_widen_a_block():
    a = np.concatenate([np.arange(1000) % 16, np.full(24, 50_000)]).astype(np.uint32)
    assert len(B.pack(a)) < 1024 * 4 // 8 + 24 * 6 + 40


def test_encoder_equals_library(library, corpus):
    texts = TRICKY + [t for _, t in corpus if t]
    for t, got in zip(texts, B.Encoder(PATH).batch(texts), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t


def expected(rows, library):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""), r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [1_000_000, 500])
def test_files(spark, corpus, library, monkeypatch, segment, tmp_path):
    monkeypatch.setattr(B, "SEGMENT_IDS", segment)
    path = B.write_ids(make(spark, corpus), PATH, str(tmp_path / "ids"))
    got = sorted((tuple(r) for r in B.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(corpus, library)
    ids = {r.doc_id: r.ids for r in B.read_ids(spark, path).where("doc_id in (5, 14)").collect()}
    assert ids[5] == [*library.encode("One two three", add_special_tokens=False).ids, 0]


def test_edges(spark, empty, clashing, corpus, library):
    assert B.read_documents(spark, B.write_ids(empty, PATH)).count() == 0
    assert sorted(map(tuple, B.read_documents(spark, B.write_ids(clashing, PATH)).collect()), key=lambda r: r[1]) == expected(corpus, library)


def test_whole_table(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, B.query(spark, sf).collect()), key=lambda r: r[1]) == expected(rows, library)
