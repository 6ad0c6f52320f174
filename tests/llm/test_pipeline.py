import hashlib

import public_tokenizers
import pytest
import sentencepiece
import test_decontaminate
import test_lines
import test_neardup
from shared import make

import corpus_pipeline
from marlstone.llm import decontaminate, neardup


def cut(text, windows):
    """Words under any occurrence of a window go, with what stands between two of them."""
    w = test_decontaminate.words(text)
    hit = {j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
    if not hit:
        return text, False
    low = text.translate(test_decontaminate.UP)
    at = [m.span() for m in test_decontaminate.WORD.finditer(low)]
    out, last, k = "", 0, 0
    while k < len(at):
        if k in hit:
            out += text[last : at[k][0]]
            while k in hit:
                last = at[k][1]
                k += 1
        else:
            k += 1
    return out + text[last:], 2 * len(hit) > len(w)


def test_run_equals_brute_force_stage_by_stage(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # language identification keeps all of these; see test_language for what it rejects
    rows = [(d, t) for _, d, _, gone, t in test_lines.brute(rows) if not gone or t.split()]
    stays = {d: kept for _, d, _, _, kept in test_neardup.brute(rows, n=5)}
    rows = [(d, t) for d, t in rows if stays[d]]
    windows = set()
    for _, t in items:
        w = test_decontaminate.words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in rows:
        text, gone = cut(t, windows)
        if not gone:
            ids = library.encode(text, add_bos=True, add_eos=True)
            want.append((d, len(ids), ids, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want and len(want) > 100


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_stand_nulls_and_empty_tables(spark, sf, corpus, empty, name, stage):
    assert stage(spark, empty, sf).count() == 0
    docs = make(spark, corpus)
    out = stage(spark, docs, sf)
    assert out.count() <= docs.count()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert corpus_pipeline.STAGES[2][1] is neardup.stage and corpus_pipeline.STAGES[3][1] is decontaminate.stage


def test_exact_copy_with_short_lines_goes(spark, sf, tmp_path):
    """The copy's short lines don't stay behind as a document of their own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").limit(40)
    long = "the anther honest onthere restore instant thereon hations store another erstone reason\n"
    planted = "Onthere\n" + long + "restore hations onthere\n\n" + long.replace("honest", "onanin").replace("store", "erhat")
    more = make(spark, [(d, planted, "en", "src0", len(planted)) for d in (1_000_001, 1_000_002)])
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1_000_001 in got and 1_000_002 not in got


def test_a_repeated_row_stays_once(spark, sf, corpus):
    import random

    from shared import prose

    rng = random.Random(12)
    own = prose(rng, 80)
    docs = make(spark, [(1, own), (1, own), (2, prose(rng, 80)), (None, prose(rng, 70)), (None, None), (3, own + " x")])
    assert sorted(r.doc_id or 0 for r in neardup.stage(spark, docs, sf).collect()) == [0, 0, 1, 2]
