import collections
import hashlib

import pytest
from shared import make, prose

from marlstone.llm import suffixes, windows_of_bytes


def brute(rows, n=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(x[i : i + n] for _, x in data for i in range(len(x) - n + 1))
    out = []
    for d, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d is None, d or 0, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def run(df, **kw):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffixes.remove_repeats(df, digest=True, **kw).collect())


@pytest.mark.parametrize("crowd", [2000, 1])
def test_equals_brute_force(spark, corpus, crowd):
    assert run(make(spark, corpus), crowd=crowd) == brute(corpus)


def test_texts_longer_than_a_block(spark, corpus, monkeypatch):
    monkeypatch.setattr(windows_of_bytes, "BLOCK", 700)
    rows = [(d, t) for d, t in corpus if len(t or "") < 20_000]
    assert run(make(spark, rows)) == brute(rows)


def test_passages_that_meet_at_every_offset(spark):
    """Contexts that share a part of their windows only, on the left, on the right and with several others."""
    import random

    rng = random.Random(2)
    p = prose(rng, 90)
    rows = [(k, prose(rng, 20) + p[a:z] + prose(rng, 20)) for k, (a, z) in enumerate((a, z) for a in range(0, 200, 23) for z in range(220, len(p), 37))]
    assert run(make(spark, rows), crowd=5) == brute(rows)


def test_spans_and_bytes(spark):
    text = "x" * 10 + "".join(chr(97 + i % 26) + str(i) for i in range(100))
    got = suffixes.remove_repeats(make(spark, [(1, text), (2, text[5:]), (3, "short")])).collect()
    for r in got:
        raw = {1: text, 2: text[5:], 3: "short"}[r.doc_id].encode()
        assert b"".join(raw[a:z] for a, z in zip([0, *(s[1] for s in r.spans)], [*(s[0] for s in r.spans), len(raw)], strict=True)) == bytes(r.kept)
        assert sum(z - a for a, z in r.spans) == r.n_removed


def test_edges(spark, empty, clashing, corpus):
    assert suffixes.remove_repeats(empty).count() == 0
    assert run(clashing) == brute(corpus)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((False, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.query(spark, sf).collect()) == brute(rows)
