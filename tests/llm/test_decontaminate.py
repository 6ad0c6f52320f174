import hashlib
import random
import re
from pathlib import Path

import pytest
from shared import make, prose

from marlstone.llm import decontaminate
from marlstone.llm.common import last

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(UP))


def brute(rows, items):
    out = []
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= g
        out.append((d is None, d or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out)


def run(spark, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = decontaminate.find(docs, bench, **kw)
    f = [(r["doc_id"], r[d.columns[-1]]) for r in d.collect()]
    return sorted((i is None, i or 0, x.n_words, sum(z - a for a, z in x.spans), len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest()) for i, x in f)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(7)
    out = [(i, prose(rng, rng.choice([3, 9, 10, 11, 25, 40]))) for i in range(30)]
    return [*out, (30, None), (31, ""), (32, "..."), (33, out[4][1]), (34, out[4][1] + " tail of it"), (35, "été ñandú 漢字")]


@pytest.fixture(scope="module")
def planted(items):
    rng = random.Random(8)
    rows = []
    for d in range(60):
        t = items[rng.randrange(30)][1].split()
        a = rng.randrange(len(t))
        rows.append((d, " ".join([prose(rng, rng.randint(0, 20)), " ".join(t[a:]).upper(), prose(rng, 5), " ".join(t[: a + 1]), items[rng.randrange(30)][1]])))
    return rows


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_equals_brute_force(spark, corpus, items, planted, block_words):
    rows = planted + [(r[0], r[1]) for r in corpus if r[0] != 14]
    assert run(spark, make(spark, rows), items, block_words=block_words) == brute(rows, items)


def test_longest_match_and_limits(spark, items):
    item = next(t for _, t in items if t and len(words(t)) == 40)
    w = item.split()
    docs = make(spark, [(1, item), (2, "a b c " * 40 + item + " d e f"), (3, " ".join(w[:9])), (4, None), (5, "")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(got) == {2, 3, 4, 5}
    assert words(got[2].text) == words("a b c " * 40 + "d e f") and got[2].removed_words == 40
    assert got[3].text == " ".join(w[:9]) and got[4].text is None and got[5].text == ""
    longest = {r.doc_id: r["found"].longest for r in decontaminate.find(docs, bench).collect()}
    assert longest == {1: 40, 2: 40, 3: 9, 4: 0, 5: 0}


def test_cut_takes_upper_case_words_whole(spark):
    item = "Alpha BETA Gamma delta EPSILON zeta Eta THETA iota Kappa"
    docs = make(spark, [(1, f"Keep THIS Étude ÉCOLE {item.upper()}, and This Tail OF ÉA it. " + "More Words HERE. " * 9)])
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert got.text == "Keep THIS Étude ÉCOLE , and This Tail OF ÉA it. " + "More Words HERE. " * 9 and got.removed_words == 10


def test_edges(spark, empty, clashing, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    none = bench.where("item_id < 0")
    assert decontaminate.find(empty, bench).count() == 0
    d = decontaminate.find(clashing, none)
    assert d.columns[:-1] == clashing.columns and d.where(last(d).longest > 0).count() == 0
    kept = decontaminate.decontaminate(clashing, bench.where("item_id <> 35"))
    assert kept.columns[:-1] == clashing.columns and kept.count() == clashing.count()


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((False, r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.query(spark, sf).collect())
    assert got == brute(rows, items) and any(r[3] for r in got)


def test_items_without_an_id_are_hit_but_not_named(spark):
    docs = make(spark, [(1, "a b c d e f g h i j k l"), (2, "x y")])
    assert [r[2:5] for r in run(spark, docs, [(None, "c d e f g h i j k l"), (4, "x y"), (None, "y")])] == [(12, 10, 0), (2, 2, 1)]


def test_benchmark_with_clashing_columns_and_blocks_one_at_a_time(spark, items):
    from pyspark.sql import functions as F

    bench = spark.createDataFrame(items, "item_id long, text string")
    more = bench.withColumns({c: F.lit(c) for c in ("item", "doc_id", "h", "n", "bucket", "before", "block")})
    docs = make(spark, [(1, items[4][1])])
    got = [decontaminate.find(docs, b, block_words=50).collect() for b in (bench, more)]
    assert got[0] == got[1] and len(list(decontaminate.benchmark_blocks(more, 50))) > 3


def _size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_ten_blocks_write_no_documents(spark, tmp_path, monkeypatch):
    """As many hits as with one block, and under half of the documents' bytes written."""
    rng = random.Random(9)
    items = [(f"i{k}", prose(rng, 100)) for k in range(40)]
    rows = [(k, prose(rng, 500) + (" " + rng.choice(items)[1] if k % 3 == 0 else "")) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(50)] + [(2000, None), (None, rows[3][1])]
    make(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    written, real = [], decontaminate.materialize

    def kept(df, name, **kw):
        out = real(df, name, **kw)
        written.append(out._marlstone_path)
        return out

    monkeypatch.setattr(decontaminate, "materialize", kept)
    rows_of = lambda d: sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"], r["found"].n_words, [list(x) for x in r["found"].spans], list(r["found"]["items"]), r["found"].longest) for r in d.collect())
    many = rows_of(decontaminate.find(docs, bench, block_words=400))
    assert len(written) >= 10 and sum(_size(p.removeprefix("file:")) for p in written) < 0.5 * _size(tmp_path / "docs")
    one = rows_of(decontaminate.find(docs, bench))
    assert [r[:5] for r in many] == [r[:5] for r in one] and sum(bool(r[3]) for r in one) > 100
    assert {k.text for k in decontaminate.decontaminate(docs, bench).collect()} >= {None}
