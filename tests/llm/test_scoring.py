import collections
import math
import zlib

import numpy as np
import pytest
from shared import make

from marlstone.llm import recurrent, scoring


def brute(rows):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    toks = [(t or "").encode().lower().split() + ["END"] for _, t in rows]
    c = collections.Counter(w for h, ws in zip(held, toks, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for ws in toks]
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, round(b, 5)) for (d, _), h, ws, b in zip(rows, held, toks, base, strict=True)]


def key(r):
    return (r[0] is None, r[0] or 0, r[2:])


@pytest.mark.parametrize("frequent", [1 << 19, 40])
def test_counts_and_base_equal_brute_force(spark, corpus, monkeypatch, frequent):
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    monkeypatch.setattr(scoring, "HELD", 500)
    got = scoring.score_documents(make(spark, corpus)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=key) == sorted(brute(corpus), key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_rare_words_score_the_same_by_either_way(spark, corpus, monkeypatch):
    texts = [(i, t) for i, (_, t) in enumerate(corpus)]
    monkeypatch.setattr(scoring, "UPDATES", 0)
    monkeypatch.setattr(scoring, "RATES", (0.0, 0.0, 0.0))
    whole = {r.doc_id: r.score for r in scoring.score_documents(make(spark, texts)).collect()}
    monkeypatch.setattr(scoring, "FREQUENT", 1 << 12)
    for r in scoring.score_documents(make(spark, texts)).collect():
        assert math.isclose(r.score, whole[r.doc_id], rel_tol=1e-4, abs_tol=1e-4)


def test_model_beats_base_on_held_out_text(spark, sf):
    got = scoring.query(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_network_probabilities_sum_to_one():
    p = recurrent.start(np.arange(recurrent.HEAD + recurrent.SHAPES))
    net = recurrent.Network(p)
    h = np.random.default_rng(1).normal(size=(1, recurrent.HIDDEN)).astype(np.float32)
    for k in ("C", "W"):
        p[k][:] = np.random.default_rng(2).normal(size=p[k].shape)
    n = recurrent.HEAD + recurrent.SHAPES
    lp, _, _ = net._output(np.repeat(h, n, axis=0), np.arange(n), False)
    assert np.exp(lp.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    p = recurrent.start(rng.integers(1, 50, recurrent.HEAD + recurrent.SHAPES))
    for k in ("C", "W"):
        p[k] += rng.normal(0, 0.3, p[k].shape).astype(np.float32)
    lengths = np.array([9, 4, 6])
    ids = rng.integers(1, recurrent.HEAD + recurrent.SHAPES, 19)
    ids[np.cumsum(lengths) - 1] = 0
    seen = {}

    class Watched(recurrent.Network):
        def _update(self, grads, n):
            seen.update(grads)

    def loss(q):
        return -sum(lp.sum(dtype=float) for _, lp in recurrent.Network(q).run(ids, lengths, False))

    list(Watched(p).run(ids, lengths, True))
    for k in ("U", "C", "X", "W", "c"):
        at = np.unravel_index(np.argmax(np.abs(seen[k])), seen[k].shape)
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(seen[k][at], rel=0.03)


def test_state_is_carried_over_windows_and_lanes_do_not_mix(monkeypatch):
    rng = np.random.default_rng(4)
    p = recurrent.start(rng.integers(1, 50, recurrent.HEAD + recurrent.SHAPES))
    p["C"] += rng.normal(0, 0.5, p["C"].shape).astype(np.float32)
    lengths = np.array([70, 3, 41, 1, 100])
    ids = rng.integers(1, recurrent.HEAD, lengths.sum())
    ids[np.cumsum(lengths) - 1] = 0

    def scores(ids, lengths):
        lp = np.empty(len(ids))
        for at, x in recurrent.Network(p).run(ids, lengths, False):
            lp[at] = x
        return lp

    whole = scores(ids, lengths)
    monkeypatch.setattr(recurrent, "LANES", 2)
    monkeypatch.setattr(recurrent, "WINDOW", 7)
    np.testing.assert_allclose(scores(ids, lengths), whole, atol=1e-4)
    alone = np.concatenate([scores(x, np.array([len(x)])) for x in np.split(ids, np.cumsum(lengths)[:-1])])
    np.testing.assert_allclose(alone, whole, atol=1e-4)


def test_empty_table_and_clashing_columns(spark, empty, clashing):
    assert scoring.score_documents(empty).count() == 0
    assert scoring.score_documents(clashing).count() == clashing.count()
