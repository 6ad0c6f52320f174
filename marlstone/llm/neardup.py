"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct shingles of SHINGLE words. Under each of PERMUTATIONS hash functions both the smallest and the largest
value of the set are kept: two values of a signature for one evaluation. The probability that two sets agree in either is their Jaccard
similarity. BANDS bands of ROWS values, half of them minima, half maxima, and each value of a band from a different function, make candidates;
a pair at similarity 0.8 has no band in common with a probability of (1 - 0.8 ** 5) ** 40 = 1.3e-7.

Documents with the same set are one class and are compared once. In each bucket every class is first compared with the class that meets most
others in its buckets: the original of a group of copies, if it is there. What that joins is one component; then, in buckets that still hold
several components, classes of different components are compared: members that are connected already need no further link. The rarest
shingles of a class and its size bound what it can share (see _open_pairs), which rules out nearly all of them before any pair is made; so a
large group of copies costs its size and not its square. All candidates are confirmed on their full sets.

Null, empty and blank texts have no shingles and no links; a text of fewer words than SHINGLE is one shingle. Rows with the same doc_id are one
node. Rows with a null id have a null component and are kept. Ids are of any type that Spark orders; a component is named by the least. Ties
in hash values are equal values of a signature; ties for a bucket's lead go to the later class. Very long texts are taken whole, their shingles
in numpy. An empty table gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.bytewords import mix, words
from marlstone.llm.common import documents, free, like, materialize, owned, released, slices
from marlstone.llm.components import components
from marlstone.operators.joins import checked_broadcast

PERMUTATIONS, ROWS, BANDS, PERCENT = 100, 5, 40, 80
#: Most ids that are broadcast as hashes.
WANTED = 1 << 20
_RANDOM = np.random.default_rng(20240229)
A = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
POWERS = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    found, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, _, _, owner, h in words(texts):
        found.append(h)
        owners.append(owner)
    h = np.concatenate(found)
    ends = np.cumsum(np.bincount(np.concatenate(owners), minlength=len(texts)))
    return [_shingles(h[a:z], n) for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True)] if texts else []


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return h
    n = min(n, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * POWERS[k]
    out = np.sort(mix(total + np.uint64(n)))
    return out[np.r_[True, out[1:] != out[:-1]]]


def min_max(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(values), 2048):
        v = A[:, None] * values[None, i : i + 2048] + B[:, None]
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    both = np.concatenate([low, high]).reshape(BANDS, ROWS)
    return mix((mix(both) * POWERS[None, :ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _class(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text").to_pylist(), n)
            keys = [band_keys(*min_max(s)).astype(np.int64) for s in sets if len(s)]
            ends = pa.array(np.r_[0, np.cumsum([BANDS * (len(s) > 0) for s in sets])].astype(np.int32))
            bands = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            cols = {"doc_id": b.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array([_class(s) for s in sets], pa.string()), "bands": bands}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return released(run)


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                sets = shingle_sets(list(b["text"].iloc[i : i + 256]), n)
                yield pd.DataFrame({"cls": [_class(s) for s in sets], "items": [s.astype(np.int64) for s in sets]})

    return released(run)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets hold 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("common"), F.size("x").alias("nx"), F.size("y").alias("ny")).where(100 * F.col("common") >= percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("a", "b")


def _open_pairs(placed: DataFrame, leads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that could still be linked, from buckets whose classes (key, cls, n, component) are in several components.

    Shingles are put in one order, the rarest first. The first common shingle of a linked pair, at position `at` of a class of n, has all common ones
    behind it, at least percent * (n + m) / (100 + percent) of n - at; so the partner's size m is at most
    limit = (100 + percent) * (n - at) / percent - n. What sets the copies of one original apart is rare, so a class that isn't linked with the
    original has its usual partners' sizes beyond the limit before its common shingles begin. Rows that no class with their shingle could pair
    with go before any pair is made, so a large group costs its size and not its square."""
    keys = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    rest = placed.join(keys, "key", "left_semi").join(leads.select("key", F.col("lead.cls").alias("lead")), "key").where("cls <> lead")
    rest = materialize(rest.select("cls", "n", "component").distinct(), "open-classes")
    items = materialize(sets.join(rest, "cls").select("cls", "n", "component", F.explode("items").alias("i")), "open-shingles")
    free(rest)
    often = items.groupBy("i").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    inside = Window.partitionBy("cls")
    at = F.col("n") - F.count(F.lit(1)).over(inside) + F.row_number().over(inside.orderBy("f", "i")) - 1
    rows = items.join(often, "i").withColumn("limit", F.floor((100 + percent) * (F.col("n") - at) / percent) - F.col("n"))
    rows = materialize(rows.where(100 * F.col("limit") >= percent * F.col("n")).select("i", "cls", "n", "component", "limit"), "open-prefixes")
    free(items)
    for _ in range(2):  # each pass may leave shingles with fewer classes
        ends = rows.groupBy("i").agg(F.min("n").alias("least"), F.max("limit").alias("reach"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("i", "least", "reach")
        last, rows = rows, materialize(rows.join(ends, "i").where("limit >= least and n <= reach").drop("least", "reach"), "open-rest")
        free(last)
    two = rows.select("i", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("component").alias("d"), F.col("limit").alias("limit_b"))
    pairs = rows.join(two, "i").where("component < d and m <= limit and n <= limit_b").select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
    pairs = materialize(pairs, "open-pairs")
    free(rows)
    return pairs


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    rows = documents(docs, id_col, text_col)
    signatures = materialize(rows.mapInArrow(_signatures(shingle), like(rows, "n_shingles long, cls string, bands array<long>")), "signatures")
    signed = materialize(signatures.drop("bands"), "signed")
    live = signed.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    banded = signatures.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).select("cls", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialize(banded.join(shared, "key"), "buckets")
    free(signatures)
    weights = buckets.groupBy("cls").agg(F.sum("size").alias("weight"))
    members = materialize(buckets.drop("size").join(weights, "cls"), "weighted-buckets")
    free(buckets)
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    # texts are read where they lie: what is sent to them is a hash of each wanted id, 8 bytes, up to WANTED of them; beyond, texts are shuffled
    wanted = materialize(members.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select(F.xxhash64("rep").alias("h")).distinct(), "wanted")
    texts = rows.withColumn("h", F.xxhash64("doc_id")).join(checked_broadcast(wanted, WANTED), "h", "left_semi").select("text")
    sets = materialize(texts.mapInPandas(_sets(shingle), "cls string, items array<long>").dropDuplicates(["cls"]), "sets")
    free(wanted)

    leads = members.groupBy("key").agg(F.max(F.struct("weight", "cls", "n")).alias("lead"))
    led = members.join(leads, "key").where(F.col("cls") != F.col("lead.cls"))
    stars = led.where(near(F.col("n"), F.col("lead.n"))).select(F.col("cls").alias("a"), F.col("lead.cls").alias("b")).distinct()
    first = materialize(confirmed(stars, sets, percent), "confirmed")
    found = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = members.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    pairs = _open_pairs(placed, leads, sets, percent)
    links = materialize(first.unionByName(confirmed(pairs, sets, percent)), "confirmed")
    free(first, pairs, members, sets)

    reps = classes.select("cls", "rep")
    by_rep = links.join(reps.withColumnsRenamed({"cls": "a", "rep": "u"}), "a").join(reps.withColumnsRenamed({"cls": "b", "rep": "v"}), "b").select("u", "v")
    same_id = live.join(reps, "cls").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    nodes = components(by_rep.unionByName(same_id))
    out = signed.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), shingle=4)


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Pipeline: of each group of near-duplicates the document with the smallest id stays, once if its row is repeated. Rows without an id stay."""
    with owned(spark):
        found = materialize(near_duplicates(docs).select("doc_id", "kept"), "near-dedup", outlives=True)
    # a table of its own, whose size is known before the join is planned, so that texts stay where they lie while it is small; ids of 8 bytes at most are
    # broadcast up to WANTED of them
    gone = materialize(found.where("not kept").select("doc_id").distinct(), "gone")
    gone = checked_broadcast(gone, WANTED) if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") else gone
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialize(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
