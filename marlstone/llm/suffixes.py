"""Exact substring dedup: bytes under a string of LENGTH bytes that also starts anywhere else.

Suffixes are split by their first LENGTH bytes only, in passes over digits of eight bytes; groups that are still equal after the last pass
are exactly the repeated windows. What can't be equal is ruled out first, so one row for some 70 suffixes is shuffled and not one per suffix:

    anchors    Windows that are equal have the same anchor (windows_of_bytes.py), and neighbours mostly share it. Windows whose anchor's hash
               occurs once aren't repeated.
    contexts   The context of an anchor is all bytes under its windows. Copies of a context, known by a 128-bit BLAKE2 digest, are counted
               as one; all windows of one that occurs twice or more are repeated.
    digits     Within an anchor of several contexts, the windows of one copy of each are split by one digit after the other: eight bytes a
               pass, in numpy over all contexts of an anchor; where an anchor has more than CROWD contexts, which could be any number, by
               Spark, in passes of wider digits (DIGITS), each a grouping by the bytes themselves. Groups of one are dropped after each pass.

Within an anchor bytes make windows equal, and anchors' hashes only rule out. That two contexts are copies of each other rests on their digest: four of five
distinct repeated windows are known by it, the others by the digits. Digits are taken from the first eight bytes, then the last eight, then the rest in order, as
the last tell most windows apart; equality doesn't depend on that order, and no order of suffixes is returned. Copies of a text add to counts that Spark sums before it shuffles them, so
large groups of copies don't meet in one task.

Null and empty texts have nothing to remove. Repeated rows are copies of each other, with ids or without; ids of any type are handed on as they
are. Of windows that tie all go, the first as well. Very long texts are taken in blocks. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import windows_of_bytes as wb
from marlstone.llm.common import documents, like, materialize, released
from marlstone.llm.windows_of_bytes import LENGTH

CROWD = 2000
#: Rows of the table of contexts in one piece of the anchors' stream.
STREAM = 20_000
#: Bytes of a window in each of Spark's passes: the first and the last eight, then what lies between.
DIGITS = ((0, 8, -8, 0), (8, 40), (40, 104), (104, -8))


def _digest(body: bytes, place: int) -> bytes:
    return hashlib.blake2b(body, digest_size=16, salt=place.to_bytes(16, "little")).digest()


def _packed(n_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                raw = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
                found = [wb.runs(np.frombuffer(x, np.uint8), n_bytes) for x in raw]
                ends = pa.array(np.r_[0, np.cumsum([len(f[0]) for f in found])].astype(np.int32))
                k, place, first, n = (np.concatenate([f[j] for f in found]) for j in range(4))
                size = (n + n_bytes - 1).tolist()
                owner = np.repeat(np.arange(len(raw)), [len(f[0]) for f in found]).tolist()
                c = [_digest(raw[o][a : a + m], p) for o, a, m, p in zip(owner, first.tolist(), size, place.tolist(), strict=True)]
                lists = {"k": pa.array(k.view(np.int64)), "c": pa.array(c, pa.binary()), "first": pa.array(first.astype(np.int32)), "n": pa.array(n.astype(np.int32))}
                cols = {"doc_id": b.column("doc_id"), "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "packed": pa.array([z.compress(x) for x in raw], pa.binary())}
                cols |= {name: pa.ListArray.from_arrays(ends, v) for name, v in lists.items()}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return released(run)


def _contexts(n_bytes: int):
    """Per text: the bytes under each of its wanted runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out: dict[str, list] = {"k": [], "c": [], "many": [], "body": []}
            for text, wanted in zip(b["packed"], b["wanted"], strict=True):
                raw = z.decompress(text)
                for r in wanted:
                    for name in ("k", "c", "many"):
                        out[name].append(r[name])
                    out["body"].append(raw[r["first"] : r["first"] + r["n"] + n_bytes - 1])
            yield pd.DataFrame(out)

    return released(run)


def _repeated(n_bytes: int):
    """Contexts in order of their anchor: for each, the windows (from its first) that another context of the anchor has too, as spans."""

    def settle(rows: list[tuple[int, bytes, bool, bytes]]) -> pd.DataFrame:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = np.array([len(r[3]) for r in rows])
        n = size - n_bytes + 1
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(size) - size, n)
        twice = wb.repeated(data, at, np.array([r[0] for r in rows], np.int64)[owner], n_bytes)
        out = []
        for (key, context, many, _), a, z in zip(rows, np.cumsum(n) - n, np.cumsum(n), strict=True):
            edge = np.flatnonzero(np.diff(np.r_[False, twice[a:z], False]))
            if not many and len(edge):
                out.append((key, context, edge[::2].tolist(), edge[1::2].tolist()))
        return pd.DataFrame(out, columns=["k", "c", "a", "z"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes, bool, bytes]] = []
        for b in batches:
            for r in zip(b["k"], b["c"], b["many"], b["body"], strict=True):
                if len(held) >= STREAM and r[0] != held[-1][0]:  # whole anchors only
                    yield settle(held)
                    held = []
                held.append(r)
        if held:
            yield settle(held)

    return released(run)


def _digits(n_bytes: int, parts: tuple[int, ...]):
    """Rows of (ctx, k, body, live): each live window's group and the digit of the pass. live: null for all of the context's windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = [(a, z if z > 0 else n_bytes + z) for a, z in zip(parts[::2], parts[1::2], strict=True)]
        ends = [(a if a >= 0 else n_bytes + a, z) for a, z in ends]
        for b in batches:
            for ctx, k, body, live in zip(b["ctx"], b["k"], b["body"], b["live"], strict=True):
                rows = [(r["i"], r["ga"], r["gb"]) for r in live] if live is not None else [(i, k, -1) for i in range(len(body) - n_bytes + 1)]
                digit = [b"".join(body[i + a : i + z] for a, z in ends) for i, _, _ in rows]
                yield pd.DataFrame({"ctx": ctx, "i": [r[0] for r in rows], "ga": [r[1] for r in rows], "gb": [r[2] for r in rows], "digit": digit})

    return released(run)


def _crowded(contexts: DataFrame, n_bytes: int) -> DataFrame:
    """(k, c, a, z) as _repeated gives it, for anchors of any number of contexts (k, c, many, body). A group is named by its least window."""
    contexts = materialize(contexts.withColumn("ctx", F.monotonically_increasing_id()), "crowded-contexts")
    live, group = contexts.select("ctx", "k", "body", F.lit(None).cast("array<struct<i: int, ga: bigint, gb: int>>").alias("live")), ["ga", "gb", "digit"]
    for number, parts in enumerate(DIGITS):
        rows = materialize(live.mapInPandas(_digits(n_bytes, parts), "ctx long, i int, ga long, gb int, digit binary"), f"digits-{number}")
        names = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("t"), F.min(F.struct("ctx", "i")).alias("least")).where("t > 1").drop("t")
        left = rows.join(names, group).groupBy("ctx").agg(F.collect_list(F.struct("i", F.col("least.ctx").alias("ga"), F.col("least.i").alias("gb"))).alias("live"))
        left = materialize(left, f"live-windows-{number}")
        live = contexts.select("ctx", "k", "body").join(left, "ctx")
    marked = contexts.where("not many").select("ctx", "k", "c").join(left, "ctx").select("k", "c", F.array_sort(F.transform("live", lambda x: x["i"].cast("long"))).alias("a"))
    return marked.select("k", "c", "a", F.transform("a", lambda x: x + 1).alias("z"))


def _cut(n_bytes: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            removed, count, kept, spans = [], [], [], []
            for text, found in zip(b.column("packed").to_pylist(), b.column("found").to_pylist(), strict=True):
                raw, first, last = z.decompress(text), np.empty(0, np.int64), np.empty(0, np.int64)
                if found:
                    shift = np.repeat([r["first"] for r in found], [len(r["a"]) for r in found])
                    first = np.array([x for r in found for x in r["a"]], np.int64) + shift
                    last = np.array([x for r in found for x in r["z"]], np.int64) + shift + n_bytes - 1
                    first, last = wb.union(first, last)
                rest = wb.kept(raw, first, last) if len(first) else raw
                removed.append(int((last - first).sum()))
                count.append(len(first))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
                spans.append(np.stack([first, last], axis=1).tolist())
            cols = {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64())}
            cols |= {"kept": pa.array(kept, pa.string())} if digest else {"kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return released(run)


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans): kept is what remains, as bytes, spans the removed [first, last) bytes. With digest,
    kept is its SHA-256 and there are no spans."""
    if length <= 112:
        raise ValueError("length must be over 112")
    rows = documents(docs, id_col, text_col)
    packed = rows.mapInArrow(_packed(length), like(rows, "n_bytes long, packed binary, k array<long>, c array<binary>, first array<int>, n array<int>"))
    packed = materialize(packed.withColumn("row", F.monotonically_increasing_id()), "packed-texts")

    anchors = packed.select("row", F.explode(F.arrays_zip("k", "c", "first", "n")).alias("x")).select("row", "x.k", "x.c", "x.first", "x.n")
    keys = packed.select(F.explode("k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("k")
    anchors = materialize(anchors.join(materialize(keys, "repeated-anchors"), "k"), "anchors")

    contexts = anchors.groupBy("k", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first", "n")).alias("at"))
    contexts = materialize(contexts.select("k", "c", (F.col("times") > 1).alias("many"), "at.*"), "contexts")

    several = materialize(contexts.groupBy("k").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "mixed-anchors")
    wanted = F.collect_list(F.struct("k", "c", "many", "first", "n")).alias("wanted")
    body = lambda some: packed.select("row", "packed").join(contexts.join(some.select("k"), "k").groupBy("row").agg(wanted), "row").mapInPandas(_contexts(length), "k long, c binary, many boolean, body binary")
    few = body(several.where(F.col("d") <= crowd)).repartition("k").sortWithinPartitions("k")
    settled = few.mapInPandas(_repeated(length), "k long, c binary, a array<long>, z array<long>")
    crowds = several.where(F.col("d") > crowd)
    if not crowds.isEmpty():
        settled = settled.unionByName(_crowded(body(crowds), length))
    whole = contexts.where("many").select("k", "c", F.array(F.lit(0).cast("long")).alias("a"), F.array(F.col("n").cast("long")).alias("z"))
    settled = materialize(settled.unionByName(whole), "repeated-windows")

    found = anchors.select("row", "k", "c", "first").join(settled, ["k", "c"]).groupBy("row").agg(F.collect_list(F.struct("first", "a", "z")).alias("found"))
    last = packed.select("row", "doc_id", "n_bytes", "packed").join(found, "row", "left")
    tail = "kept string" if digest else "kept binary, spans array<array<long>>"
    return last.mapInArrow(_cut(length, digest), like(rows, f"n_bytes long, n_removed long, n_spans long, {tail}"))


def query(spark, sf: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"), digest=True).withColumnRenamed("kept", "kept_sha256")
