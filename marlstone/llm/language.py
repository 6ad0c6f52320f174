"""Language identification by Bayesian evidence fusion.

For each document the posterior of a language is the product of
  - the likelihood of the whole text under a smoothed byte-trigram model of the language, tempered to that of at most EVIDENCE trigrams (those of
    a text aren't independent),
  - the probability that text of the language is declared as it is (markup: the `lang` of a page or document), and
  - the prior of the document's host, smoothed towards that of its domain, this towards that of its address suffix, and this towards that of
    all documents.
One more class, UNKNOWN, has uniform trigrams and a small prior: text in none of the languages. A document is rejected where its class is
UNKNOWN, its posterior is under LEAST, or its text has no letters.

The trigram models are counted over all labelled rows. A language has a model of its own if its declaration has at least LABELLED trigrams, for the MODELS
declarations with the most: that bounds the model, which is broadcast, whatever is declared. The text of all other declarations is pooled by script (the lead byte
that its text holds most), a model per script. A text whose class is a pool is in the language that it's declared to be in, if that is one of those
without a model; if it is declared otherwise or not at all it is UNKNOWN. So texts of small languages are kept, and `pooled` tells them. For the evidence of
declarations all those without a model are one.

At least half of a model is text: half a trigram is added to each bucket, and less where there are fewer than LABELLED, so that what is added is as much as the
text. Trigrams that a model hasn't seen are thus less likely under it than under UNKNOWN, by enough for UNKNOWN's prior. Models are sparse:
a number per class and bucket seen. The declarations' and hosts' tables are counts of what the text alone says, taken over all documents by
grouped aggregation.

Null text, url, host and declaration count as empty; an empty declaration is one of its own. Texts without letters are UNKNOWN and rejected.
Repeated rows and ties give a row each; a tie goes to the language first in the alphabet. Very long texts are taken in blocks, and an empty
table gives no rows. Other columns, whatever their names, are handed on as they are. Sources without a full stop, as those of `documents`,
have no suffix and are their own domain; pages have all three levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import beside, last, materialize, put_back, released, ship, slices

BUCKETS, EVIDENCE, LEAST = 1 << 13, 60, 0.5
LABELLED, MODELS = BUCKETS // 2, 1024
#: Languages whose counts a task holds at once, and terms of a likelihood that are added up at once.
HELD, TERMS = 256, 1 << 18
UNKNOWN, UNKNOWN_PRIOR, SMOOTH = "und", 1e-9, 20.0
BLOCK = 1 << 18
RESULT = ("text_language", "language", "posterior", "letters", "pooled", "accepted")
#: What declarations without a model count as in the evidence, and how the classes of pools are named.
OTHER, POOL = "?", "~"
#: Letters are a-z and all bytes from 128 on; other bytes are one blank.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """(buckets of the trigrams that hold a letter, letters) of each block of a text."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    for at in range(0, len(data) - 2, BLOCK):
        x = _LETTER[data[at : at + BLOCK + 2]].astype(np.uint32)
        code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
        own = np.count_nonzero(x[1:-1] != 32)
        yield ((code[code != 0x202020] * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64), own


def script(text: str) -> int:
    """Which script most characters are of: 0 for ASCII letters, otherwise half of the lead byte that comes most."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.zeros(256, np.int64)
    for at in range(0, len(data), BLOCK):
        n += np.bincount(data[at : at + BLOCK], minlength=256)
    leads = n[0xC2:].copy()
    leads = np.add.reduceat(leads, np.arange(0, len(leads), 2))
    return 0 if n[65:91].sum() + n[97:123].sum() >= leads.sum() else 0x61 + int(leads.argmax())


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def told(seen: dict[tuple[str, int], np.ndarray]) -> pd.DataFrame:
        at = [np.flatnonzero(n) for n in seen.values()]
        size = [len(x) for x in at]
        return pd.DataFrame({"declared": np.repeat(np.array([d for d, _ in seen], object), size), "script": np.repeat(np.array([k for _, k in seen], np.int32), size), "bucket": np.concatenate(at).astype(np.int32), "n": np.concatenate([n[x] for n, x in zip(seen.values(), at, strict=True)])})

    seen: dict[tuple[str, int], np.ndarray] = {}
    for b in batches:
        for t, lang in zip(b["text"], b["declared"], strict=True):
            key = (lang, script(t))
            if key not in seen and len(seen) >= HELD:
                yield told(seen)
                seen = {}
            n = seen.setdefault(key, np.zeros(BUCKETS, np.int64))
            for bucket, _ in trigrams(t):
                n += np.bincount(bucket, minlength=BUCKETS)
    if seen:
        yield told(seen)


class Model:
    """Log-probabilities of buckets under each class. Half a trigram in each bucket, or less for little text, gives all buckets of a class the same
    log-probability, `floor`; a bucket seen n times has log(n / added + 1) more, and only these terms are kept, by bucket."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """found: (buckets, their counts) of each class. One without text is uniform."""
        total = np.array([n.sum() for _, n in found], np.float64)
        added = 0.5 * np.where(total > 0, np.minimum(1.0, total / LABELLED), 1.0)
        self.floor = np.log(added / (total + added * BUCKETS))
        bucket = np.concatenate([b for b, _ in found])
        order = np.argsort(bucket, kind="stable")
        self.at = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.cls = np.repeat(np.arange(len(found), dtype=np.int32), [len(b) for b, _ in found])[order]
        self.more = np.concatenate([np.log(n / a + 1).astype(np.float32) for a, (_, n) in zip(added, found, strict=True)])[order]

    def loglik(self, bucket: np.ndarray) -> np.ndarray:
        """Log-likelihood of a text's buckets under each class."""
        n = np.bincount(bucket, minlength=BUCKETS)
        out, seen, step = len(bucket) * self.floor, np.flatnonzero(n), max(1, TERMS // len(self.floor))
        for k in range(0, len(seen), step):
            u = seen[k : k + step]
            size = self.at[u + 1] - self.at[u]
            term = np.repeat(self.at[u] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out += np.bincount(self.cls[term], np.repeat(n[u], size) * self.more[term].astype(np.float64), minlength=len(out))
        return out


def fit(labelled: DataFrame, least: int = LABELLED, most: int = MODELS) -> tuple[list[str], Model]:
    """(classes, model) from all rows of (text, declared): languages with a model of their own, pools, and UNKNOWN last."""
    rows = labelled.where("declared <> ''").select("text", "declared").mapInPandas(released(_count), "declared string, script int, bucket int, n long")
    counts = materialize(rows.groupBy("declared", "script", "bucket").agg(F.sum("n").alias("n")), "language-trigrams")
    own = counts.groupBy("declared").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "declared").limit(most)
    languages = sorted(r.declared for r in own.collect())
    named = counts.withColumn("cls", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.concat(F.lit(POOL), F.col("script").cast("string"))))
    each = named.groupBy("cls", "bucket").agg(F.sum("n").alias("n")).groupBy("cls").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
    found = {r.cls: (np.array(r.buckets, np.int32), np.array(r.counts, np.int64)) for r in each.toLocalIterator()}  # a row per class, of BUCKETS numbers at most
    classes = [*languages, *sorted(set(found) - set(languages))]
    return [*classes, UNKNOWN], Model([*(found[x] for x in classes), (np.empty(0, np.int32), np.empty(0, np.int64))])


def _loglik(text: str, model: Model) -> tuple[np.ndarray, int]:
    """Tempered log-likelihood per class, and letters of the whole text."""
    total, n, own = np.zeros(len(model.floor)), 0, 0
    for bucket, k in trigrams(text):
        total += model.loglik(bucket)
        n, own = n + len(bucket), own + k
    return total * min(1.0, EVIDENCE / max(n, 1)), own


def _decide(model):
    """What each text alone says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [_loglik(t, model.value) for t in b["text"]]
            yield b.drop(columns="text").assign(best=np.array([np.argmax(x) if own else len(x) - 1 for x, own in said], np.int32))

    return released(run)


def named(cls: str, declared: str, shown: str) -> str:
    """The language of a text of that class: a pool's is the declared one, if that has no model of its own."""
    return cls if not cls.startswith(POOL) else declared if shown == OTHER else UNKNOWN


def _fuse(model, classes: list[str]):
    """The posterior of each row, from its text, the prior of its host and what its declaration says. Other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t, prior, says, declared, shown in zip(*(b.column(c).to_pylist() for c in ("text", "prior", "says", "raw", "declared")), strict=True):
                x, own = _loglik(t or "", model.value)
                joint = x + np.log(prior) + np.array(says)
                at = int(np.argmax(joint)) if own else len(classes) - 1
                p = float(np.exp(joint[at] - joint.max()) / np.exp(joint - joint.max()).sum())
                language = named(classes[at], declared, shown)
                pooled = language != UNKNOWN and classes[at].startswith(POOL)
                out.append((named(classes[int(np.argmax(x)) if own else -1], declared, shown), language, p, own, pooled, language != UNKNOWN and p >= LEAST))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_())
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("rest"), b.column("text"), *cols], names=["rest", "text", *RESULT])

    return released(run)


def host_parts(host: Column) -> tuple[Column, Column]:
    """(domain, address suffix): the last two labels of a host, and the last. A name without a full stop has no suffix."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), "."), F.when(n > 1, F.element_at(labels, -1)).otherwise("")


def _counts(decided: DataFrame, by: list[str]) -> DataFrame:
    """Per `by`: rows whose text alone is of each class, as a map of those that occur, `of`, and all of them, `n`."""
    each = decided.groupBy(*by, "best").agg(F.sum("n").alias("each"))
    return each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("best", "each"))).alias("of"), F.sum("each").alias("n"))


def _whole(decided: DataFrame, k: int) -> list[int]:
    out = [0] * k
    for r in decided.groupBy("best").agg(F.sum("n").alias("n")).collect():  # a row per class
        out[r.best] = r.n
    return out


def _row(decided: DataFrame, name: str, values: list[float]) -> DataFrame:
    return F.broadcast(decided.sparkSession.createDataFrame([(values,)], f"{name} array<double>"))


def _of(i: Column | int) -> Column:
    return F.coalesce(F.element_at("of", i), F.lit(0))


def host_priors(decided: DataFrame, k: int, smooth: float = SMOOTH) -> DataFrame:
    """(suffix, domain, host, prior): probabilities per class, each level's counts smoothed by the prior of the level above. That of UNKNOWN is
    the same everywhere: a short text that only looks unknown is no evidence about its host."""
    whole = _whole(decided, k)
    prior = [(1 - UNKNOWN_PRIOR) * (n + 1.0) / (sum(whole[:-1]) + k - 1) for n in whole[:-1]] + [UNKNOWN_PRIOR]
    levels, above = ["suffix", "domain", "host"], _row(decided, "prior", prior)
    for depth in range(1, 4):
        c = _counts(decided, levels[:depth])
        c = c.crossJoin(above) if depth == 1 else c.join(above, levels[: depth - 1])
        known = F.col("n") - _of(F.lit(k - 1)) + smooth
        own = F.transform("prior", lambda p, i: F.when(i == k - 1, F.lit(UNKNOWN_PRIOR)).otherwise((_of(i) + smooth * p) / known))  # noqa: B023
        above = c.select(*levels[:depth], own.alias("prior"))
    return above


def declarations(decided: DataFrame, k: int, smooth: float = SMOOTH) -> DataFrame:
    """(declared, says): the log-probability per class that its text is declared so, smoothed by how often anything is."""
    whole, c = _whole(decided, k), _counts(decided, ["declared"])
    usual = (F.col("n") + 1) / F.lit(float(sum(whole) + c.count()))
    c = c.withColumn("usual", usual).crossJoin(_row(decided, "whole", [float(n) for n in whole]))
    return c.select("declared", F.transform("whole", lambda n, i: F.log((_of(i) + smooth * F.col("usual")) / (n + smooth))).alias("says"))


def identify(docs: DataFrame, declared: Column, host: Column, text_col: str = "text", smooth: float = SMOOTH) -> DataFrame:
    """All columns of docs, and a struct `identified` of text_language, language, posterior, letters, pooled and accepted."""
    spark = docs.sparkSession
    ship(spark)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(beside(docs, text_col), F.col(f"`{text_col}`").alias("text"), F.lower(F.trim(blank(declared))).alias("raw"), F.lower(F.trim(blank(host))).alias("host"))
    domain, suffix = host_parts(F.col("host"))
    rows = rows.withColumns({"domain": domain, "suffix": suffix})
    classes, fitted = fit(rows.select(blank(F.col("text")).alias("text"), F.col("raw").alias("declared")))
    modelled = [c for c in classes[:-1] if not c.startswith(POOL)]
    rows = rows.withColumn("declared", F.when(F.col("raw").isin("", *modelled), F.col("raw")).otherwise(OTHER))
    texts = rows.select("declared", "host", "domain", "suffix", blank(F.col("text")).alias("text"))
    model, k = spark.sparkContext.broadcast(fitted), len(classes)
    decided = texts.mapInPandas(_decide(model), "declared string, host string, domain string, suffix string, best int").groupBy("declared", "host", "domain", "suffix", "best").agg(F.count(F.lit(1)).alias("n"))
    decided = materialize(decided, "language-decisions")
    priors, says = materialize(host_priors(decided, k, smooth), "host-priors"), materialize(declarations(decided, k, smooth), "declarations")
    # a row per host and per declaration: Spark sends these to all tasks where they are small, and splits large hosts where they aren't
    both = rows.join(priors, ["suffix", "domain", "host"]).join(says, "declared").select("rest", "text", "prior", "says", "raw", "declared")
    kinds = (T.StringType(), T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.BooleanType())
    schema = T.StructType([both.schema["rest"], both.schema["text"], *(T.StructField(n, t) for n, t in zip(RESULT, kinds, strict=True))])
    out = both.mapInArrow(_fuse(model, classes), schema)
    return put_back(out, docs, text_col, F.struct(*RESULT), "identified")


#: Pages: the markup's declared language, and the host of the address.
def page_language(html: Column) -> Column:
    return F.substring_index(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]+(?:-[A-Za-z0-9]+)*)", 1), "-", 1)


def page_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)


def page_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[A-Za-z#0-9]+;", " ")


def query(spark, sf: str) -> DataFrame:
    d = identify(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source"), F.col("lang"), F.col("source"))
    return d.select("doc_id", "lang", *(last(d)[n].alias(n) for n in RESULT[:-1]), last(d).accepted.alias("kept"))


def pages_query(spark, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", page_language(F.col("html")).alias("declared"), page_text(F.col("html")).alias("text"))
    d = identify(p, F.col("declared"), page_host(F.col("url")))
    return d.select("page_id", "declared", *(last(d)[n].alias(n) for n in RESULT))


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Pipeline: documents that are rejected go."""
    d = identify(docs, F.col("lang"), F.col("source"))
    return d.where(last(d).accepted).select(*docs.columns)
