import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shared import make

from marlstone.llm import infill as I


def brute(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TRICKY = ["", None, "<", "<P", "<P>", "<<P>", "a<M>b", "<S", "<PP>", "<P >", "<É>", "é", "aéb", "漢字 <S>", "\U0001f600\U0001f601", "a\x00b", "\r\n", "don't", "<X>", "P>", "A" * 255 + "<P>", "x" * 256 + "é" * 300, "<p>"]


@pytest.fixture(scope="module")
def rows(corpus):
    return corpus + [(100 + k, t) for k, t in enumerate(TRICKY * 3)] + [(1000, "<P> " + "word " * 30_000), (1001, "漢 ab\n" * 40_000)]


def test_against_brute_force(spark, rows):
    got = sorted((r.doc_id or -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in I.fill_in_middle(make(spark, rows)).withColumn("back", I.restored()).collect())
    want = sorted((d or -1, *brute(d, t), t or "") for d, t in rows)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from([*"aZ<>PSM \n0é漢\U0001f600"]), max_size=700), max_size=6), st.data())
def test_scan_and_cuts(texts, data):
    blocks = I.Blocks(*I._texts(pa.array(texts, pa.string())))
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.DOTALL) for t in texts]
    assert blocks.n_units.tolist() == [len(u) for u in units]
    assert blocks.n_characters.tolist() == [len(t) for t in texts]
    assert (blocks.n_sentinels > 0).tolist() == [bool(re.search("<[PSM]>", t)) for t in texts]
    cut = np.array([data.draw(st.integers(0, len(u))) for u in units], np.int64)
    byte, chars = blocks.cuts(np.arange(len(texts)), cut)
    before = ["".join(u[:k]) for u, k in zip(units, cut, strict=True)]
    assert byte.tolist() == [len(b.encode()) for b in before] and chars.tolist() == [len(b) for b in before]


def test_automaton_forgets_its_start():
    assert I.settles() <= I.LOOKBACK
    stays = np.repeat(np.arange(2), 256)
    with pytest.raises(ValueError):
        I.settles(stays)


def test_seed_rate_and_order_of_forms(spark, corpus):
    got = {(r.doc_id, r.output) for r in I.fill_in_middle(make(spark, corpus), seed=7, rate=100, spm=100).collect()}
    assert got == {(d, brute(d, t, 7, 100, 100)[4]) for d, t in corpus}
    assert {r.form for r in I.fill_in_middle(make(spark, corpus), rate=0).collect()} == {"plain"}


def test_bytes_that_are_no_characters(spark):
    """Each is a character and a unit of its own."""
    docs = spark.sql("SELECT 1L AS doc_id, decode(encode('ab', 'UTF-8'), 'UTF-8') AS text")
    assert I.fill_in_middle(docs).first().n == 1
    data = np.frombuffer(b"a\x80\xe6b\xff", np.uint8)
    blocks = I.Blocks(data, np.array([0, 5]))
    assert blocks.n_units.tolist() == [5] and blocks.n_characters.tolist() == [5]


def test_empty_table_and_clashing_names(spark, empty, clashing, corpus):
    assert I.fill_in_middle(empty).collect() == []
    assert sorted((r.doc_id or -1, r.output) for r in I.fill_in_middle(clashing).collect()) == sorted((d or -1, brute(d, t)[4]) for d, t in corpus)
