import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from shared import make, prose

from marlstone.llm import language

WORDS = {"en": "the and of with that this from they have which".split(), "de": "und der die nicht sich auch werden über für daß".split(), "fr": "les des que est dans pour être français où déjà".split()}


def text(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, text(rng, l := rng.choice(list(WORDS))), l, f"{l}.example.org" if i % 3 else "mixed.example.com", 0) for i in range(300)]
    return [*out, (300, text(rng, "de"), "en", "de.example.org", 0), (301, "und", "", "de.example.org", 0), (302, None, None, None, 0), (303, "123 !!", "en", "en.example.org", 0), (304, "漢字仮名交じり文" * 40, None, "x", 0)]


def test_text_wins_over_a_wrong_declaration_and_rejects_what_is_no_language(spark, rows):
    d = language.identify(make(spark, rows), F.col("lang"), F.col("source"))
    got = {r["doc_id"]: r["identified"] for r in d.collect()}
    assert all(got[r[0]].language == r[2] and got[r[0]].accepted for r in rows[:300])
    assert got[300].language == "de" and got[301].language == "de"
    assert not got[302].accepted and not got[303].accepted and got[303].language == "und"
    assert not got[304].accepted


def test_priors_equal_a_plain_computation(spark):
    rng = random.Random(6)
    hosts = ["a.x.org", "b.x.org", "y.org", "z.com", "local"]
    rows = [(rng.choice(hosts), rng.randrange(3)) for _ in range(400)]
    d = spark.createDataFrame(rows, "host string, best int").withColumns(dict(zip(("domain", "suffix"), language.host_parts(F.col("host")), strict=True))).withColumn("n", F.lit(1).cast("long"))
    got = {r.host: np.array(r.prior) for r in language.host_priors(d, 3, 20.0).collect()}
    level = lambda h: (h.split(".")[-1] if "." in h else "", ".".join(h.split(".")[-2:]), h)
    whole = np.bincount([b for _, b in rows], minlength=3)
    top = np.append((1 - language.UNKNOWN_PRIOR) * (whole[:2] + 1) / (whole[:2].sum() + 2), language.UNKNOWN_PRIOR)
    for h in hosts:
        p = top
        for k in range(3):
            c = np.bincount([b for x, b in rows if level(x)[: k + 1] == level(h)[: k + 1]], minlength=3)
            p = np.append((c + 20 * p)[:2] / (c[:2].sum() + 20), language.UNKNOWN_PRIOR)
        np.testing.assert_allclose(got[h], p)


def test_short_text_with_numbers_is_kept(spark, sf):
    """A clean text of a few words whose digits and address say little."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    short = make(spark, [(-1, "Eredon inahfi 4045650754681188 whst er onlyrent. ldlooirp.70@mail5.example.com +1 (227) 555-6608", "en", "src0", 96)])
    got = language.identify(d.unionByName(short), F.col("lang"), F.col("source")).where("doc_id = -1").first()
    assert got["identified"].accepted and got["identified"].language == "en"


def test_blocks_count_each_trigram_once(monkeypatch):
    t = prose(random.Random(1), 500) + " été 漢字"
    whole = np.sort(np.concatenate([b for b, _ in language.trigrams(t)]))
    monkeypatch.setattr(language, "BLOCK", 97)
    assert (np.sort(np.concatenate([b for b, _ in language.trigrams(t)])) == whole).all()


def test_held_out_accuracy(spark, sf):
    """Models fitted without a fifth of the rows tell that fifth's declared languages."""
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("test", F.col("doc_id") % 5 == 0)
    got = language.identify(d.withColumn("says", F.when(~F.col("test"), F.col("lang"))), F.col("says"), F.lit("")).where("test and n_chars > 100").collect()
    assert np.mean([r["lang"] == r["identified"].language for r in got]) > 0.98


def test_pages(spark, sf):
    got = language.pages_query(spark, sf).toPandas()
    assert (got["declared"] == got["language"]).mean() > 0.95
    row = spark.createDataFrame([("https://u@www.Shop.example.co.uk:80/a?b",)], "u string").select(language.page_host(F.col("u")).alias("h")).first()
    assert row.h == "www.Shop.example.co.uk"
    assert spark.createDataFrame([("<HTML class=x LANG='de-AT'><body>",)], "h string").select(language.page_language(F.col("h"))).first()[0] == "de"


def test_edges(spark, empty, clashing):
    assert language.identify(empty, F.col("lang"), F.col("source")).count() == 0
    d = language.identify(clashing, F.col("lang"), F.col("source"))
    assert d.columns[:-1] == clashing.columns and d.count() == clashing.count() and d.columns[-1] == "identified_"


def own_words(rng, k):
    """Words of an invented language: its own few letters."""
    letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(60)]


def invented(rng, words, n=400):
    return " ".join(rng.choice(words) for _ in range(n))


def test_languages_of_small_share_and_many_languages_are_kept(spark):
    """250 languages of equal size, none with 0.5 % of the rows, and junk of no language."""
    rng = random.Random(12)
    vocabulary = {f"l{k:03}": own_words(rng, k) for k in range(250)}
    rows = [(4 * k + j, invented(rng, w), x, f"src{k % 3}", 0) for k, (x, w) in enumerate(vocabulary.items()) for j in range(4)]
    rows += [(5000, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600)), None, "src0", 0), (5001, invented(rng, own_words(rng, 0), 20), "l999", "src0", 0)]
    got = {r["doc_id"]: r["identified"] for r in language.identify(make(spark, rows), F.col("lang"), F.col("source")).collect()}
    assert all(got[d].accepted and got[d].language == x for d, _, x, _, _ in rows[:1000])
    assert not got[5000].accepted and got[5000].language == "und"


def test_rare_language_beside_a_common_one(spark):
    """2 of 1,202 rows, under 0.2 %."""
    rng = random.Random(13)
    rare, common = own_words(rng, 0), own_words(rng, 1)
    rows = [(i, invented(rng, common, 40), "big", "src0", 0) for i in range(1200)] + [(2000 + i, invented(rng, rare, 800), "rare", "src0", 0) for i in range(2)]
    got = {r["doc_id"]: r["identified"] for r in language.identify(make(spark, rows), F.col("lang"), F.col("source")).where("doc_id >= 2000").collect()}
    assert len(got) == 2 and all(x.accepted and x.language == "rare" for x in got.values())


def test_sparse_model_equals_a_dense_one(monkeypatch):
    rng = np.random.default_rng(3)
    found = [(b := np.sort(rng.choice(language.BUCKETS, 900, replace=False)).astype(np.int32), rng.integers(1, 50, len(b))) for _ in range(5)]
    dense = np.full((5, language.BUCKETS), 0.5)
    for k, (b, n) in enumerate(found):
        dense[k, b] += n
    text = rng.integers(0, language.BUCKETS, 3000)
    want = np.log(dense / dense.sum(axis=1, keepdims=True))[:, text].sum(axis=1)
    monkeypatch.setattr(language, "TERMS", 64)
    np.testing.assert_allclose(language.Model(found).loglik(text), want, rtol=1e-6)


GREEK = "και το η να του των με για από που είναι στην αυτό δεν ως κατά θα τους".split()


def test_small_languages_are_kept_by_their_declaration(spark):
    """A few documents of a language, far under LABELLED trigrams, beside a common one; junk, and text that isn't declared, are still rejected."""
    rng = random.Random(21)
    rows = [(i, text(rng, "en"), "en", "src0", 0) for i in range(20)]
    rows += [(100 + i, " ".join(rng.choice(GREEK) for _ in range(25)), "el", "src0", 0) for i in range(5)]
    rows += [(200, " ".join(rng.choice(GREEK) for _ in range(25)), None, "src0", 0), (201, " ".join(rng.choice(GREEK) for _ in range(25)), "en", "src0", 0)]
    rows += [(202, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)), None, "src0", 0), (203, "qzx wvk " * 40, "", "src0", 0), (204, text(rng, "en"), "a junk declaration", "src0", 0)]
    got = {r["doc_id"]: r["identified"] for r in language.identify(make(spark, rows), F.col("lang"), F.col("source")).collect()}
    assert all(got[k].accepted and (got[k].language, got[k].pooled) == ("en", False) for k in range(20))
    assert all(got[100 + k].accepted and (got[100 + k].language, got[100 + k].pooled) == ("el", True) for k in range(5))
    assert all(not got[k].accepted and got[k].language == "und" for k in (200, 202, 203)) and got[204].accepted
    assert not got[201].pooled
    kept = {r.doc_id for r in language.stage(spark, make(spark, rows), "").collect()}
    assert set(range(100, 105)) <= kept


def test_declarations_beyond_the_models_are_pooled(spark, monkeypatch):
    """However much is declared, so many models are broadcast; the others' texts are kept by their pool."""
    rng = random.Random(22)
    vocabulary = {f"l{k:03}": own_words(rng, k) for k in range(12)}
    rows = [(4 * k + j, invented(rng, w), x, "src0", 0) for k, (x, w) in enumerate(vocabulary.items()) for j in range(4 + (k < 3))]
    d = make(spark, [(n, *r[1:]) for n, r in enumerate(rows)])
    classes, model = language.fit(d.select("text", F.col("lang").alias("declared")), most=3)
    assert classes == ["l000", "l001", "l002", "~0", "und"] and len(model.floor) == 5
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda labelled: fit(labelled, most=3))
    got = language.identify(d, F.col("lang"), F.col("source")).collect()
    assert all(r["identified"].accepted and r["identified"].language == r["lang"] for r in got) and sum(r["identified"].pooled for r in got) == 36


def posterior_by_hand(rows):
    """Every step of the fusion over lists and dicts: (text language, language, posterior, accepted) of (id, text, declared, host)."""
    from collections import Counter, defaultdict
    from math import exp, log

    size, half = language.BUCKETS, language.LABELLED
    letter = lambda b: b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32

    def grams(t):
        d = [32, *(letter(b) for b in t.encode()), 32]
        found = [(d[i], d[i + 1], d[i + 2]) for i in range(len(d) - 2)]
        return [(((a | b << 8 | c << 16) * 0x9E3779B1) & 0xFFFFFFFF) >> 19 for a, b, c in found if (a, b, c) != (32, 32, 32)], sum(x != 32 for x in d[1:-1])

    def written(t):
        leads = Counter(b >> 1 for b in t.encode() if b >= 0xC2)
        return 0 if sum(65 <= b < 91 or 97 <= b < 123 for b in t.encode()) >= sum(leads.values()) else max(leads, key=lambda k: (leads[k], -k))

    rows = [(i, t or "", (d or "").strip().lower(), (h or "").strip().lower()) for i, t, d, h in rows]
    seen = defaultdict(Counter)
    for _, t, d, _ in rows:
        if d:
            seen[d, written(t)].update(grams(t)[0])
    total = Counter()
    for (d, _), n in seen.items():
        total[d] += sum(n.values())
    own = {d for d, n in total.items() if n >= half}
    models = defaultdict(Counter)
    for (d, k), n in seen.items():
        models[d if d in own else f"~{k}"].update(n)
    classes = [*sorted(own), *sorted(set(models) - own), "und"]

    def said(t):
        g, letters = grams(t)
        out = []
        for c in classes:
            n = models.get(c, {})
            whole = sum(n.values())
            add = 0.5 * min(1.0, whole / half) if whole else 0.5
            out.append(sum(log((n.get(b, 0) + add) / (whole + add * size)) for b in g) * min(1.0, language.EVIDENCE / max(len(g), 1)))
        return out, letters

    best = lambda x, letters: max(range(len(classes)), key=lambda k: (x[k], -k)) if letters else len(classes) - 1
    shown = lambda d: d if d in own or not d else "?"
    level = lambda h: (h.split(".")[-1] if "." in h else "", ".".join(h.split(".")[-2:]), h)
    texts = [said(t) for _, t, _, _ in rows]
    alone = [best(*x) for x in texts]
    k, smooth, rare = len(classes), language.SMOOTH, language.UNKNOWN_PRIOR
    whole = [alone.count(c) for c in range(k)]

    def prior(h):
        p = [(1 - rare) * (n + 1) / (sum(whole[:-1]) + k - 1) for n in whole[:-1]] + [rare]
        for depth in range(1, 4):
            c = Counter(a for a, r in zip(alone, rows, strict=True) if level(r[3])[:depth] == level(h)[:depth])
            p = [(c[j] + smooth * p[j]) / (sum(c[i] for i in range(k - 1)) + smooth) for j in range(k - 1)] + [rare]
        return p

    said_so = Counter(shown(d) for _, _, d, _ in rows)

    def says(d):
        usual = (said_so[d] + 1) / (len(rows) + len(said_so))
        return [log((sum(a == c and shown(r[2]) == d for a, r in zip(alone, rows, strict=True)) + smooth * usual) / (whole[c] + smooth)) for c in range(k)]

    priors, declared, out = {h: prior(h) for h in {r[3] for r in rows}}, {d: says(d) for d in said_so}, {}
    name = lambda c, d: classes[c] if not classes[c].startswith("~") else d if shown(d) == "?" else "und"
    for (i, _, d, h), (x, letters) in zip(rows, texts, strict=True):
        joint = [a + log(b) + c for a, b, c in zip(x, priors[h], declared[shown(d)], strict=True)]
        at = best(joint, letters)
        p = exp(joint[at] - max(joint)) / sum(exp(j - max(joint)) for j in joint)
        out[i] = (name(best(x, letters), d), name(at, d), p, name(at, d) != "und" and p >= language.LEAST)
    return out


def test_posterior_by_hand_over_a_whole_table(spark, sf):
    """Every row of documents, with some of a small language, of a junk declaration and of none added."""
    rng = random.Random(23)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    more = [(-1 - k, " ".join(rng.choice(GREEK) for _ in range(20)), "el", "a.b.org") for k in range(4)] + [(-10, "漢字 " * 30, None, "c.b.org"), (-11, None, None, None), (-12, "the and of", "zz-top", "a.b.org"), (-13, "12 34", "en", "b.org")]
    want = posterior_by_hand(rows + more)
    docs = make(spark, [(i, t, d, h, 0) for i, t, d, h in rows + more])
    got = {r["doc_id"]: r["identified"] for r in language.identify(docs, F.col("lang"), F.col("source")).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        g = got[i]
        assert (g.text_language, g.language, g.accepted) == (w[0], w[1], w[3]) and abs(g.posterior - w[2]) < 1e-5, (i, g, w)
