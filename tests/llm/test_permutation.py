import numpy as np
import pytest

from marlstone.llm import permutation as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], schema).repartition(3)


def brute(rows, queries, k):
    """Exact answers, over the rows that take part."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:k]
            out.setdefault(q, []).append([(n + 1, i, d) for n, (d, i) in enumerate(found)])
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 16))
    return [(k, (centre[k % 20] + rng.normal(scale=0.4, size=16)).astype(np.float32).tolist()) for k in range(3000)]


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(120)]
    rows += [(500 + k, [1.0] * 8) for k in range(30)]  # ties
    d = frame(spark, rows)
    got = answers(N.search(d, d.where("vec_id % 10 = 0"), k=10))
    want = brute(rows, {i for i, _ in rows if i % 10 == 0}, 10)
    assert set(got) == set(want)
    for q, (w,) in want.items():
        assert [x[:2] for x in got[q]] == [x[:2] for x in w] and np.allclose([x[2] for x in got[q]], [x[2] for x in w], rtol=1e-12)
    assert [i for _, i, _ in got[500]] == [501, 502, 503, 504, 505, 506, 507, 508, 509, 510] and {s for _, _, s in got[500]} == {0.0}


@pytest.mark.parametrize("layout", [1, 7])
def test_recall_against_brute_force(spark, rows, layout):
    d = frame(spark, rows).repartition(layout)
    got = answers(N.search(d, d.where("vec_id % 100 = 0"), k=10, least=32))
    want = brute(rows, set(range(0, 3000, 100)), 10)
    hits = [len({i for _, i, _ in got[q]} & {i for _, i, _ in w}) for q, (w,) in want.items()]
    assert set(got) == set(want) and sum(hits) >= 0.9 * 10 * len(want)
    exact = dict(rows)
    for q, found in got.items():
        scores = [x[2] for x in found]
        assert scores == sorted(scores) and [x[0] for x in found] == list(range(1, 11))
        assert np.allclose(scores, [np.sqrt(((np.float64(exact[i]) - np.float64(exact[q])) ** 2).sum()) for _, i, _ in found], rtol=1e-12)


def test_recall_over_the_whole_table(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    got, want = answers(N.query(spark, sf)), brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    assert set(got) == set(want)
    assert sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in w}) for q, (w,) in want.items()) >= 0.9 * 10 * len(want)


def test_footrule_from_inverted_files(rows):
    """What the inverted files say is the footrule distance of the representations, pivots that are missing in the last place."""
    v = np.array([x for _, x in rows[:400]])
    p = N.Pivots(v[:60].astype(float), 12)
    orders = p.orders(v)
    batch = next(N._segments(p, 1024)(iter([_batch(rows[:400])])))
    s = N._Segment(p, np.dtype(np.float32), *(batch.column(c)[0] for c in ("ids", "vectors", "posted", "starts")))
    place = np.full((400, 60), 12)
    np.put_along_axis(place, orders, np.arange(12)[None], 1)
    for q in range(0, 400, 37):
        footrule = np.abs(place - place[q]).sum(axis=1)
        assert (12 * 13 - s.shared(orders[q]) == footrule).all()


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["id", "v"])


def test_blocks_of_queries_and_segments(spark, rows):
    d = frame(spark, rows).repartition(2)
    one = answers(N.search(d, d.where("vec_id % 50 = 0"), k=5, segment=1024))
    many = answers(N.search(d, d.where("vec_id % 50 = 0"), k=5, segment=1024, block=16))
    assert set(one) == set(many) == set(range(0, 3000, 50))
    assert sum(len({i for _, i, _ in one[q]} & {i for _, i, _ in many[q]}) for q in one) >= 0.9 * 5 * 60


def test_a_vector_that_most_rows_repeat(spark, rows):
    hot = rows[:300] + [(5000 + k, rows[0][1]) for k in range(3000)]
    d = frame(spark, hot)
    got = answers(N.search(d, d.where("vec_id in (0, 100, 5100)"), k=10, least=32))
    assert [x[1] for x in got[0]] == list(range(5000, 5010)) and [x[1] for x in got[5100]] == [0, *range(5000, 5009)]
    assert len(got[100]) == 10


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.1]), (7, [1.0]), (8, []), (1, [1.0, 0.5]), (0, [3.0, 0.0])]
    d = frame(spark, rows)
    got = answers(N.search(d, d))
    assert {q: sorted(i for _, i, _ in found) for q, found in got.items()} == {0: [1, 1, 1, 1], 1: [0, 0, 0, 0]}
    more = d.selectExpr("vec_id", "cast(embedding as array<double>) embedding", "1 id", "2 v", "3 number", "'x' `query`")
    assert answers(N.search(more, more)) == got


def test_no_vectors(spark):
    for rows in ([], [(0, None), (1, [0.0])], [(0, [1.0])]):
        d = frame(spark, rows)
        out = N.search(d, d)
        assert out.collect() == [] and out.columns == ["query_id", "rank", "vec_id", "score"]
