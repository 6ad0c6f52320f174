import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from shared import make, prose

from marlstone.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    at = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at), len(w) < 20 or 100 * len(at) > 30 * len(w)


def test_base_equals_brute_force(spark, corpus):
    more = [(100, "a b c d e f g h " * 5), (101, "x\n\ny\nx\n y\nx"), (102, "# * $ % & | < > " * 3), (103, "w " * 40), (104, "\x0b\x0c\r\x85\xa0")]
    rows = corpus + more
    got = quality.base_statistics(make(spark, rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((d, *brute(t)) for d, t in rows), key=key)


@pytest.fixture(scope="module")
def mixed():
    import random

    rng = random.Random(2)
    rows = [(i, prose(rng, 150), "en", f"s{i % 2}", 0) for i in range(300)]
    odd = [(1000 + i, " ".join(w + "###" * 5 for w in prose(rng, 100).split()), "en", f"s{i % 2}", 0) for i in range(40)]
    return rows + odd + [(2000, prose(rng, 100), "xx", "lone", 0), (2001, prose(rng, 100), None, None, 0)]


def test_outliers_go_even_where_many(spark, mixed):
    """An eighth of a group that would pull a plain mean and covariance towards itself."""
    got = {r.doc_id: r.kept for r in quality.quality(make(spark, mixed)).collect()}
    assert not any(got[1000 + i] for i in range(40))
    assert np.mean([got[i] for i in range(300)]) > 0.98 and got[2000] and got[2001]


def test_concentration_steps_lower_the_determinant(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (800, 4)), rng.normal(9, 0.5, (150, 4))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list(quality.FEATURES)).assign(g_lang="a", g_source="=b"))
    dets = []
    for steps in (1, 2, 4):
        e = quality.robust_estimates(df, steps).first()
        dets.append(np.prod([e[f"l_{i}{i}"] for i in range(4)]))
        assert max(abs(e[f"m_{i}"]) for i in range(4)) < 0.25
    assert dets[0] >= dets[1] * 0.999 and dets[1] >= dets[2] * 0.999


def test_distance_equals_numpy(spark, mixed):
    stats = quality.with_features(quality.base_statistics(make(spark, mixed))).where("not base_failed").where("source in ('s0', 's1')")
    rows = stats.selectExpr("doc_id", "lang g_lang", "concat('=', source) g_source", *quality.FEATURES)
    est = quality.robust_estimates(rows.drop("doc_id"))
    per = {r.g_source: r for r in est.collect()}
    for r in quality._distance(rows, est).collect():
        e = per[r.g_source]
        L = np.array([[e[f"l_{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        y = np.array([r[f] for f in quality.FEATURES]) - [e[f"m_{i}"] for i in range(4)]
        assert r.d2 == pytest.approx(y @ np.linalg.inv(L @ L.T) @ y, rel=1e-6, abs=1e-9)


def test_edges(spark, empty, clashing):
    assert quality.quality(empty).count() == 0
    assert quality.quality(clashing).count() == clashing.count()


def test_whole_table_in_dataframe_operations(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = quality.query(spark, sf)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(rows[r.doc_id])
        assert not (r.base_failed and r.kept)
