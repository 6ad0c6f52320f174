import random

from shared import make, prose

from marlstone.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, near=4):
    """rows in order of their id, null ids first: equal lines count at any length, an edit between lines of `near` words or more."""
    equal, seen, out = set(), [], []
    for d, t in rows:
        kept, gone = [], 0
        split = t.split("\n") if t is not None else []
        for x in split:
            w = x.encode().lower().split()
            again = tuple(w) in equal or (len(w) >= near and any(abs(len(w) - len(v)) <= 1 and distance(w, v) <= 1 for v in seen))
            gone += again
            if not again:
                kept.append(x)
            if w and tuple(w) not in equal:
                equal.add(tuple(w))
                if len(w) >= near:
                    seen.append(w)
        out.append((d is None, d or 0, len(split), gone, "\n".join(kept) if t is not None else None))
    return out


def run(df, **kw):
    d = lines.dedup_lines(df, **kw)
    c = d.columns[-1]
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r[c].n_lines, r[c].n_removed, r["text"]) for r in d.collect())


def edited(rng, line):
    w = line.split()
    i = rng.randrange(len(w))
    return " ".join(rng.choice([w[:i] + w[i + 1 :], w[:i] + ["new"] + w[i:], w[:i] + ["other"] + w[i + 1 :], w, w[:i] + w[i + 2 :]]))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(rng, rng.randint(5, 14)) for _ in range(25)]
    rows = []
    for d in range(40):
        ls = [rng.choice([edited(rng, rng.choice(pool)), rng.choice(pool), edited(rng, edited(rng, rng.choice(pool))), "", "short line", prose(rng, 9)]) for _ in range(rng.randint(0, 8))]
        rows.append((d, rng.choice(["\n", "\n", "\n\n"]).join(ls)))
    rows += [(40, None), (41, ""), (42, "\n"), (43, pool[20].upper()), (44, "\r\n".join(pool))]
    assert run(make(spark, rows)) == brute(rows)


def test_words_end_at_ascii_white_space_alone(spark):
    """Characters that Unicode counts as white space are parts of words, also where witnesses are verified."""
    rng = random.Random(8)
    odd = ["\u00a0", "\u3000", "\u2003", "\u0085", "\x1c", "\x1d", "\x1e", "\x1f", "\u2028"]
    rows = [(0, "one two three four five d e"), (1, "one two three four five f g"), (2, "one two three four five\u00a0d e"), (3, "one two three four five\u00a0f g")]
    for k, c in enumerate(odd):
        base = f"w{k}a w{k}b w{k}c w{k}d"
        rows += [(10 * k + 10, f"{base} x{c}y z"), (10 * k + 11, f"{base} x{c}q z"), (10 * k + 12, f"{base} x{c}y z{c}more"), (10 * k + 13, f"{base} x y z")]
    rows += [(200 + k, "\n".join(edited(rng, f"p q{c}r s{c}t u v w{c}") for _ in range(4))) for k, c in enumerate(odd)]
    want = brute(rows)
    assert run(make(spark, rows)) == want and sum(r[3] for r in want) > 10


def test_a_witness_that_fails_gives_way_to_the_next(spark, monkeypatch):
    """Where keys meet though lines are apart, the earliest of the other witnesses counts."""
    rows = [(0, "one two three four"), (1, "one two three five"), (2, "one two three six"), (3, "one two three six seven")]
    want = brute(rows)
    assert run(make(spark, rows)) == want
    real = lines._verified

    def wary(batches):
        for b in real(batches):
            yield b.assign(good=b["good"] & (b["w"] != first))

    d = make(spark, rows[:1])
    first = next(iter(lines._describe(4)(iter(d.selectExpr("doc_id id", "struct(true) rest", "text").toArrow().to_batches())))).column("h")[0].as_py()[0]
    monkeypatch.setattr(lines, "_verified", wary)
    got = {r[1]: r[3] for r in run(make(spark, rows))}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_repeated_rows_null_ids_and_long_lines(spark, corpus):
    """Of each text one row stays."""
    d = lines.dedup_lines(make(spark, corpus))
    c = d.columns[-1]
    got = d.collect()
    assert len(got) == len(corpus)
    assert sum(r[c].n_removed == 0 and bool(r["text"]) for r in got if r["doc_id"] in (None, 6, 7, 9)) == 1
    assert next(r for r in got if r["doc_id"] == 14)["text"] == corpus[13][1]
    fifteen = next(r for r in got if r["doc_id"] == 15)
    assert fifteen[c].n_removed == 6


def test_within_one():
    rng = random.Random(8)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert lines.within_one(a, b) == (distance(a, b) <= 1)


def test_edges(spark, empty, clashing):
    assert lines.dedup_lines(empty).count() == 0
    d = lines.dedup_lines(clashing)
    assert d.columns[:-1] == clashing.columns and d.count() == clashing.count()
    assert [f.dataType for f in d.schema][:-1] == [f.dataType for f in clashing.schema]
    assert {r["line_counts"] for r in d.collect()} == {"line_counts"}


def test_stage_drops_what_it_has_emptied(spark):
    line = "one two three four five six seven eight nine"
    docs = make(spark, [(1, line), (2, line + "\n"), (3, ""), (4, line + "\nmore")])
    got = {r.doc_id: r.text for r in lines.stage(spark, docs, "").collect()}
    assert got == {1: line, 3: "", 4: "more"}


def test_whole_table(spark, sf):
    import hashlib

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for _, d, n, g, t in brute(rows)]
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in lines.query(spark, sf).collect()) == want


def test_short_lines_equal_brute_force(spark):
    """Lines of 0 to 9 words, repeated and edited, among them edits between 8 and 7 words and between 4 and 3."""
    rng = random.Random(21)
    pool = [prose(rng, n) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 7, 8, 8, 9)]
    rows = [(d, "\n".join(rng.choice([edited(rng, x := rng.choice(pool)), x, x.upper(), "", " \t"]) for _ in range(rng.randint(0, 5)))) for d in range(60)]
    assert run(make(spark, rows)) == brute(rows)


def test_short_repeats_go(spark):
    got = run(make(spark, [(1, "Terms\nRead more here"), (2, "terms\n\nread  More here\nRead less here")]))
    assert [r[2:] for r in got] == [(2, 0, "Terms\nRead more here"), (4, 2, "\nRead less here")]


def test_rows_of_one_id_are_ordered_by_their_content(spark):
    """However the rows are dealt."""
    rows = [(5, "\n".join(["the same line in all of them", f"own{k} words{k} here{k}"])) for k in range(12)]
    results = [run(make(spark, rows).repartition(n)) for n in (1, 3, 5)]
    assert results[0] == results[1] == results[2] and sum(r[3] for r in results[0]) == 11
