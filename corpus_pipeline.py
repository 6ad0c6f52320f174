"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Null and empty texts have no letters, so language identification rejects them. Rows without an id pass every stage and are never joined by it; of rows that are
repeated one stays, after line dedup or near-dedup. Ids of any type that Spark orders, very long texts and further columns of any name pass as they are; ties go to the
smallest id. Empty tables, at any stage, give no rows of the right columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, language, lines, neardup, sentencepieces
from marlstone.llm.common import free, materialize, owned

STAGES = [
    ("language_id", language.stage),
    ("line_dedup", lines.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("sentencepiece", sentencepieces.stage),
]

#: No stage's whole result can be put in SQL (neural and automaton methods, a tokenizer library); tests hold it against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. What a stage wrote for itself is deleted once its output is written, and that output once the
    next stage's is; the last stage's input stays, as its rows are read from it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with owned(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", outlives=True)
        free(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
