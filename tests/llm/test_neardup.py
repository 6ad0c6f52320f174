import collections
import random

import numpy as np
from shared import make, prose

from marlstone.llm import neardup


def shingle_set(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n=4, percent=80):
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return sorted((d is None, d or 0, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


def run(df, **kw):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, **{"shingle": 4} | kw).collect())


def test_equals_brute_force(spark, corpus):
    assert run(make(spark, corpus)) == brute(corpus)


def test_group_of_near_copies_around_an_original_and_bordering_ones(spark):
    """Copies linked with the original alone, chains, and texts just under the bound in the same buckets."""
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        w = list(base)
        for i in rng.sample(range(len(w)), rng.choice([1, 2, 3, 4, 5])):
            w[i] = f"new{k}x{i}"
        rows.append((k, " ".join(w)))
    chain = list(base[:60])
    for k in range(60, 80):
        chain = [*chain[1:], f"c{k}"]
        rows.append((k, " ".join(chain)))
    rng.shuffle(rows)
    assert run(make(spark, rows)) == brute(rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    x, y = (np.concatenate(neardup.min_max(v)) for v in (a, b))
    assert abs(np.mean(x == y) - 0.8) < 0.1


def test_edges(spark, empty, clashing, corpus):
    assert neardup.near_duplicates(empty).count() == 0
    assert run(clashing) == brute(corpus)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((False, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.query(spark, sf).collect())
    inverted = collections.Counter(r[3] for r in got)
    assert got == brute(rows) and max(inverted.values()) > 1


def test_more_wanted_texts_than_are_broadcast(spark, corpus, monkeypatch):
    want = sorted(map(tuple, neardup.near_duplicates(make(spark, corpus)).collect()), key=str)
    monkeypatch.setattr(neardup, "WANTED", 1)
    assert sorted(map(tuple, neardup.near_duplicates(make(spark, corpus)).collect()), key=str) == want
