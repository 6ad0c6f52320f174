"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, named by its SHA-256. The ledger holds which rules, in which version, have scanned which blob and what
they found. A scan reads only blobs and rules that the ledger lacks, once per blob however many paths hold it, appends to the ledger, and
joins its findings back to all rows. Null and empty texts are the empty blob and find nothing. Rows with one id are versions; each gets its
own findings. Ties, repeated rows and null ids give one result row each. Very long texts are scanned whole, in time that grows with their length.
An empty table adds nothing and gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import documents, new_path, released, sha256_hex


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    flags: int
    group: int
    least: int
    hints: tuple[str, ...]


#: The base rules come first, in the order of their kinds; a match counts if `group` has at least `least` characters.
#: hints: a text without any of these (in lower case) can't match.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 0, 24, ()),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0, 1, ("private key",)),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = "struct<kind: string, rule: string, start: int, end: int>"


def rule_key(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def scan(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, str, int, int]]:
    """(kind, rule, start, end) in code points. A run of hex digits shorter than 24 can't hold a match, so the pattern asks for 24 at once."""
    low = text.lower()
    found = []
    for r in rules:
        if r.hints and not any(h in low for h in r.hints):
            continue
        found += [(r.kind, rule_key(r), m.start(), m.end()) for m in re.compile(r.pattern, r.flags).finditer(text) if len(m[r.group]) >= r.least]
    return found


def _scan_batches(rules: tuple[Rule, ...]):
    by_key = {rule_key(r): r for r in rules}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [[dict(zip(("kind", "rule", "start", "end"), s, strict=True)) for s in scan(t, tuple(by_key[k] for k in todo))] for t, todo in zip(b["text"], b["todo"], strict=True)]
            yield pd.DataFrame({"blob": b["blob"], "rules": b["todo"], "spans": spans})

    return released(run)


def update_ledger(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Scans what the ledger (a folder; None: a new one in the shared folder) lacks; returns the ledger's folder."""
    spark = docs.sparkSession
    fresh = ledger is None
    ledger = ledger or new_path(spark, "blob-ledger")
    keys = F.array(*(F.lit(rule_key(r)) for r in rules))
    blobs = documents(docs, id_col, text_col).select(sha256_hex(F.col("text")).alias("blob"), "text")
    old = None if fresh else read_ledger(docs, ledger)
    if old is None:
        todo = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", keys)
    else:
        seen = old.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left")
        todo = todo.withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("seen")
    todo.mapInPandas(_scan_batches(rules), f"blob string, rules array<string>, spans array<{SPAN}>").write.mode("append").parquet(ledger)
    return ledger


def read_ledger(docs: DataFrame, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where nothing has been written yet."""
    try:
        return docs.sparkSession.read.schema(f"blob string, rules array<string>, spans array<{SPAN}>").parquet(ledger)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans) for every row; spans are in order of start, then of the rules. Findings of other rule versions don't show."""
    ledger = update_ledger(docs, ledger, rules, id_col, text_col)
    order = {rule_key(r): k for k, r in enumerate(rules)}
    ours = F.array(*(F.lit(k) for k in order))
    found = read_ledger(docs, ledger).where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).where(F.array_contains(ours, F.col("s.rule")))
    placed = F.struct(F.col("s.start").alias("start"), (F.array_position(ours, F.col("s.rule"))).alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    per_blob = found.groupBy("blob").agg(F.array_sort(F.collect_set(placed)).alias("spans"))
    rows = documents(docs, id_col, text_col).select("doc_id", sha256_hex(F.col("text")).alias("blob"))
    return rows.join(per_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(per_blob.schema["spans"].dataType)).alias("spans"))


def query(spark, sf: str) -> DataFrame:
    s = scan_secrets(spark.read.parquet(f"{sf}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE_KINDS]
    return s.select("doc_id", *counts, sha256_hex(text(base)).alias("base_sha256"), text(F.col("spans")).alias("spans"))
