"""Ids beside a null one, beyond 2 ** 53, and as text, through every operator and stage."""

import public_tokenizers
import pytest
from shared import make, prose

import corpus_pipeline
from marlstone.llm import alignment, binary_output, decontaminate, infill, language, lines, neardup, quality, scoring, secrets, sentencepieces, suffixes

BIG = 2**53 + 1
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def _language(d):
    from pyspark.sql import functions as F

    return language.identify(d, F.col("lang"), F.col("source"))


OPERATORS = {
    "op1": scoring.score_documents, "op2": neardup.near_duplicates, "op3": lambda d: decontaminate.find(d, d.selectExpr("doc_id item_id", "text").limit(1)), "op4": suffixes.remove_repeats, "op5": lines.dedup_lines,
    "op6": _language, "op7": secrets.scan_secrets, "op8": quality.quality, "op9": lambda d: sentencepieces.encode_documents(d, PIECES), "op10": lambda d: binary_output.read_documents(d.sparkSession, binary_output.write_ids(d, BYTES)),
    "op12": lambda d: alignment.cross_align(d, BYTES, PIECES), "op13": infill.fill_in_middle,
}


@pytest.fixture(scope="module")
def texts():
    import random

    rng = random.Random(4)
    return [prose(rng, 60), None, prose(rng, 30), prose(rng, 60)]


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_come_back_as_they_were(spark, texts, name):
    ids = [BIG, None, BIG + 1, 7]
    assert sorted(r["doc_id"] or 0 for r in OPERATORS[name](make(spark, list(zip(ids, texts, strict=True)))).select("doc_id").collect()) == sorted(i or 0 for i in ids)
    words = ["a", None, "b7", "9007199254740993"]
    rows = [(i, t, "en", "src0", 1) for i, t in zip(words, texts, strict=True)]
    docs = make(spark, rows, "doc_id string, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] or "" for r in OPERATORS[name](docs).select("doc_id").collect()) == sorted(i or "" for i in words)


def test_components_of_large_ids(spark, texts):
    docs = make(spark, [(BIG + 1, texts[0]), (BIG, texts[0]), (None, texts[0]), (3, texts[3])])
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {BIG + 1: (BIG, False), BIG: (BIG, True), None: (None, True), 3: (3, True)}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_ids(spark, sf, texts, name, stage):
    ids = [BIG, None, BIG + 1, 7]
    got = [r["doc_id"] for r in stage(spark, make(spark, list(zip(ids, texts, strict=True))), sf).select("doc_id").collect()]
    assert set(got) <= set(ids) and len(got) == len(set(got)) and (name == "language_id" or {BIG, BIG + 1, 7} <= set(got))
