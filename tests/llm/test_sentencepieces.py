import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from shared import make

from marlstone.llm import sentencepieces
from marlstone.llm.wordtable import WordTable, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "\n", "a\nb", "\t x", "▁", "a▁b", "▁▁x", " ▁ ", "漢字", "\U0001f600\U0001f601", "x\x00y", "\x85\xa0 z", "é" * 50, "ab" * 300, "a" * 1000, "<s>", "</s> <unk>", "<0x41>", "İstanbul ǅ", "aaaa bbbb  aaaa"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_agenda_equals_library(library, corpus):
    texts = TRICKY + [t for _, t in corpus if t]
    model = sentencepieces.Model(PATH)
    ids, n = model.encode(texts)
    for t, ids in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True), t
        assert model.decode(ids) == library.decode(ids.tolist())


def test_words_alone_equal_library(library):
    model = sentencepieces.Model(PATH)
    words = ["▁the", "▁▁x", "▁", "▁aaaa", "▁漢字", "▁é\U0001f600", "▁" + "ab" * 100, "▁incomprehensibilities", "▁x\x00y"]
    ids, n = model.word_ids(words)
    for w, own in zip(words, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == model._symbols(model.merge(w)), w
        if w != "▁":
            assert own.tolist() == library.encode(w[1:]), w


def test_a_full_table_changes_nothing(library):
    model, table = sentencepieces.Model(PATH), WordTable(64)
    for seed in range(30):
        words = ["".join(random.Random(k).choices("abcdeé ", k=k % 40)) for k in range(seed, seed + 90, 3)]
        ids, n = model.encode([" ".join(words), *words], table)
        assert ids.tolist() == [i for t in (" ".join(words), *words) for i in library.encode(t, add_bos=True, add_eos=True)]
        assert table.n <= 64


def test_texts_in_pieces(library):
    texts = ["ab cd  e " * 3000, "", "x" * 9000 + " y", "漢 字 " * 2000]
    raw = [t.encode() for t in texts]
    held = [x for some in pieces(raw, 1000) for x in some]
    assert [b"".join(p for k, p, _ in held if k == i) for i in range(4)] == raw and [k for k, _, first in held if first] == [0, 1, 2, 3]
    assert max(len(p) for k, p, _ in held if k == 0) < 1100


def test_difference_from_the_library_is_an_error(library):
    model = sentencepieces.Model(PATH)
    model.agenda.result[model.agenda.result == model.ids["▁the"]] = 5
    with pytest.raises(ValueError, match="differ"):
        model.encode(["the thing that is in there"])


def test_operator(spark, corpus, clashing, empty, library):
    got = sentencepieces.encode_documents(clashing, PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(d, library.encode(t or "", add_bos=True, add_eos=True)) for d, t in corpus]
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids) for r in got)
    assert sentencepieces.encode_documents(empty, PATH).count() == 0
    one = {r.doc_id: r for r in sentencepieces.encode_documents(make(spark, [(1, "a b"), (2, None)]), PATH, digest=True).collect()}
    ids = library.encode("a b", add_bos=True, add_eos=True)
    assert one[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and one[2].n_tokens == 2


def test_whole_table(spark, sf, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in sentencepieces.query(spark, sf).collect():
        ids = library.encode(rows[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
