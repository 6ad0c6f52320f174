"""Line dedup: a line goes if an earlier line is the same or lies within one word's edit of it.

Lines end at line feeds; their words are the bytes between ASCII white space, A-Z lowered. Lines without words always stay. An edit
counts between lines of MIN_WORDS words or more: in shorter ones it is over a quarter of the line, and any two lines of one word are an edit apart.
Earlier means a smaller (id, hash of the text's lines, line number), null ids first, so how rows fall on tasks decides nothing; of rows that
are equal in all of these either may keep its lines. An earlier line counts whether it stays itself or not.

Equal lines are found by their hash. For the others, the deletion neighbourhood of a line is the line itself and every variant with one word left
out, each as a hashed key. Two lines of n words that give the same variant without word i differ in that word alone; a line of n + 1 words with a
variant equal to a line of n words has one word more. Keys of the first kind hold i and n, so all lines under one key lie within the bound of each
other, and the key's earliest is the only witness needed; no pairs are made. Witnesses are then verified word by word.

Only lines that can have a neighbour emit variants: one edit leaves the first or the second half of a line as it was, so a line whose halves (three
keys, which take care of lines of n and n + 1 words) no other distinct line has can't have one.

Null texts stay null and empty ones empty. A text all of whose lines go becomes empty. Repeated rows: one keeps its lines. Very long texts are
taken whole, and an empty table gives no rows. Other columns, whatever their names, are handed on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.bytewords import mix, words
from marlstone.llm.common import beside, free, last, materialize, put_back, released, ship, slices

MIN_WORDS = 4
_Q = 0xD6E8FEB86659FD93
_DOWN = pow(_Q, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


class Sequences:
    """Hashes of any run of words of any line, from one running sum over the words of all lines."""

    def __init__(self, lines: list[str]) -> None:
        found, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, _, _, owner, h in words(lines):
            found.append(h)
            owners.append(owner)
        h = np.concatenate(found)
        self.n = np.bincount(np.concatenate(owners), minlength=len(lines)).astype(np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(_Q, len(h)), out=self.sums[1:])
        self.down = _powers(_DOWN, len(h) + 2)

    def part(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (self.sums[z] - self.sums[a]) * self.down[a]

    def without(self, i: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The run [a, z) without word i."""
        return self.part(a, i) + (self.sums[z] - self.sums[i + 1]) * self.down[a + 1]


def _key(h: np.ndarray, *more) -> np.ndarray:
    out = mix(h)
    for x in more:
        out = mix(out ^ mix(np.atleast_1d(np.asarray(x)).astype(np.uint64) + np.uint64(0x51ED270B)))
    return out.view(np.int64)


def _describe(min_words: int):
    """Per text: packed text, and number, hash and half-line keys of each line that has words, the latter null where it has fewer than min_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            if b.num_rows:
                texts = b.column("text").to_pylist()
                split = [t.split("\n") if t is not None else [] for t in texts]
                count = np.array([len(s) for s in split])
                s = Sequences([x for lines in split for x in lines])
                number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                on = np.flatnonzero(s.n)
                a, n = s.start[on], s.n[on]
                e, m, k = a + n, n // 2, (n - 1) // 2
                short = np.where(n % 2 == 0, k, n - 1 - k)  # the other half-length for a partner of one word less
                cols = {"line": number[on].astype(np.int32), "h": _key(s.part(a, e), n), "k1": _key(s.part(a, a + m), 1, m), "k2": _key(s.part(e - (n - m), e), 2, n - m)}
                cols["k3"] = np.where(n % 2 == 0, _key(s.part(a, a + short), 1, short), _key(s.part(e - short, e), 2, short))
                ends = np.searchsorted(on, np.cumsum(count))
                offsets = pa.array(np.r_[0, ends].astype(np.int32))
                packed = pa.array([None if t is None else z.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(v, mask=n < min_words if c.startswith("k") else None)) for c, v in cols.items()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rest"), packed, *arrays], names=["id", "rest", "packed", *cols])

    return released(run)


def _unpacked(packed: bytes, z: zstandard.ZstdDecompressor) -> list[str]:
    return z.decompress(packed).decode("utf-8", "surrogatepass").split("\n")


def _texts_of_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for packed, wanted in zip(b["packed"], b["wanted"], strict=True):
            lines = _unpacked(packed, z)
            yield pd.DataFrame({"h": [w["h"] for w in wanted], "words": [" ".join(x.decode("utf-8", "surrogatepass") for x in lines[w["line"]].encode("utf-8", "surrogatepass").lower().split()) for w in wanted]})


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of each line's deletion neighbourhood. kind 0: without word i of n; 1: the same as a line of n - 1 words; 2: the line itself."""
    for b in batches:
        for at in range(0, len(b), 1024):
            h = b["h"].to_numpy(np.int64)[at : at + 1024]
            s = Sequences(list(b["words"].iloc[at : at + 1024]))
            a, e = s.start, s.start + s.n
            i = np.arange(int(s.n.sum()))
            A, E, N, H = (np.repeat(x, s.n) for x in (a, e, s.n, h))
            cut = s.without(i, A, E)
            keys = [_key(cut, 10, i - A, N), _key(cut, 11, N - 1), _key(s.part(a, e), 11, s.n)]
            yield pd.DataFrame({"key": np.concatenate(keys), "kind": np.repeat(np.array([0, 1, 2], np.int32), [len(k) for k in keys]), "h": np.concatenate([H, H, h])})


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one inserted, left out or replaced word makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a line are joined by single spaces, whatever other characters they hold."""
    for b in batches:
        good = [within_one(x.split(" "), y.split(" ")) for x, y in zip(b["words"], b["other"], strict=True)]
        yield b[["h", "w"]].assign(good=good)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in slices(batches):
        texts, lines_, gone_ = [], [], []
        for packed, gone in zip(b.column("packed").to_pylist(), b.column("gone").to_pylist(), strict=True):
            lines, out = _unpacked(packed, z) if packed is not None else [], set(gone or ())
            texts.append(None if packed is None else "\n".join(x for k, x in enumerate(lines) if k not in out))
            lines_.append(len(lines))
            gone_.append(len(out))
        yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string()), pa.array(lines_, pa.int64()), pa.array(gone_, pa.int64())], names=["rest", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text without the lines that go, and the columns n_lines and n_removed as `line_counts`."""
    ship(docs.sparkSession)
    q = lambda c: F.col(f"`{c}`")
    base = docs.select(q(id_col).alias("id"), beside(docs, text_col), q(text_col).alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([base.schema["id"], base.schema["rest"], T.StructField("packed", T.BinaryType()), T.StructField("line", T.ArrayType(T.IntegerType())), *(T.StructField(c, longs) for c in ("h", "k1", "k2", "k3"))])
    packed = materialize(base.mapInArrow(_describe(min_words), schema).withColumns({"row": F.monotonically_increasing_id(), "content": F.xxhash64("h")}), "packed-lines")

    order = F.struct("id", "content", "row", "line")
    lines = packed.select("id", "content", "row", F.explode(F.arrays_zip("line", "h")).alias("x")).select("id", "content", "row", "x.line", "x.h")
    firsts = materialize(lines.groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("times")), "distinct-lines")

    halves = packed.select(F.explode(F.arrays_zip("h", "k1", "k2", "k3")).alias("x")).where("x.k1 is not null").select("x.h", F.explode(F.array("x.k1", "x.k2", "x.k3")).alias("k"))
    shared = materialize(halves.groupBy("k").agg(F.min("h").alias("h0"), F.max("h").alias("h1")).where("h0 <> h1").select("k"), "shared-halves")
    near = materialize(firsts.join(halves.join(shared, "k", "left_semi").select("h").distinct(), "h", "left_semi"), "near-lines")
    free(shared)
    wanted = near.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct("h", F.col("first.line").alias("line"))).alias("wanted"))
    texts = materialize(packed.select("row", "packed").join(wanted, "row").mapInPandas(released(_texts_of_lines), "h long, words string"), "near-line-texts")

    variants = materialize(texts.mapInPandas(released(_variants), "key long, kind int, h long"), "line-variants")
    keys = variants.groupBy("key").agg(F.min("h").alias("h0"), F.max("h").alias("h1")).where("h0 <> h1").select("key")
    met = materialize(variants.join(keys, "key", "left_semi").join(near.select("h", "first"), "h"), "met-variants")
    free(variants)
    earliest = lambda k: F.min(F.when(F.col("kind") == k, F.struct("first", "h")))
    leads = materialize(met.groupBy("key").agg(*(earliest(k).alias(f"e{k}") for k in range(3))), "leads")
    witnesses = met.join(leads, "key").select("h", "first", F.when(F.col("kind") == 0, F.col("e0")).when(F.col("kind") == 1, F.col("e2")).otherwise(F.col("e1")).alias("e")).where("e.h <> h and e.first < first")

    def verified(pairs: DataFrame) -> DataFrame:
        """(h, w, good) of pairs (h, w)."""
        both = pairs.join(texts, "h").join(texts.select(F.col("h").alias("w"), F.col("words").alias("other")), "w")
        return both.mapInPandas(released(_verified), "h long, w long, good boolean")

    checked = materialize(verified(witnesses.groupBy("h").agg(F.min("e").alias("e")).select("h", F.col("e.h").alias("w"))), "witnesses")
    good, bad = checked.where("good").select("h", "w"), checked.where("not good").select("h").distinct()
    if not bad.isEmpty():  # keys met though the lines are apart, which takes two equal 64-bit hashes: all earlier lines under these lines' keys
        other = met.select("key", F.element_at(F.array(F.lit(0), F.lit(2), F.lit(1)), F.col("kind") + 1).alias("kind"), F.col("h").alias("w"), F.col("first").alias("w_first"))
        others = met.join(bad, "h", "left_semi").join(other, ["key", "kind"]).where("w <> h and w_first < first").select("h", "w").distinct()
        good = good.unionByName(verified(others).where("good").select("h", "w"))
    near_first = good.join(near.select(F.col("h").alias("w"), F.col("first").alias("near_first")), "w").groupBy("h").agg(F.min("near_first").alias("near_first"))

    bounds = firsts.join(near_first, "h", "left").where("times > 1 or near_first is not null").select("h", F.least("first", F.coalesce("near_first", "first")).alias("bound"))
    bounds = materialize(bounds, "line-bounds")
    free(near, texts, met, leads, checked, firsts)
    gone = lines.join(bounds, "h").where(F.col("bound") < order).groupBy("row").agg(F.collect_list("line").alias("gone"))
    out = packed.select("row", "rest", "packed").join(gone, "row", "left").select("rest", "packed", "gone")
    result = T.StructType([base.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    cut = out.mapInArrow(released(_without), result)
    return put_back(cut, docs, text_col, F.struct("n_lines", "n_removed"), "line_counts")


def query(spark, sf: str) -> DataFrame:
    d = dedup_lines(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", last(d).n_lines.alias("n_lines"), last(d).n_removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Pipeline: lines go; so do documents that lost lines and have no word left."""
    d = dedup_lines(docs)
    d = d.where((last(d).n_removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
