"""Language-model scores of whole documents.

1. Word counts over all training documents: each task counts hashed words of its documents, Spark adds the counts up.
2. The model (recurrent.py) is trained on all training documents, in rounds over ROUNDS sixteenths of them. In a round every task starts from
   the same parameters and trains on its own documents; the next parameters are the tasks' means, weighted by tokens and formed by Spark.
   The first parameters give each word its corpus frequency.
3. All documents are scored in one pass. The FREQUENT most frequent words' counts are broadcast (that many at most, whatever the corpus);
   what other words add to a score depends on their counts alone, and is found by a join on the word.

Training documents are those whose crc32(id as text) mod FOLDS is not HELD_OUT. Words are the bytes between ASCII white space, A-Z lowered,
known by a 61-bit hash and three bits for their shape (last byte a letter, a full stop, a comma or another; with or without bytes above 127).
Null and empty texts are the end token alone. A null id counts as an empty text's crc32. Repeated rows each count and each get a score. Very long texts
are scored whole, in windows between which the state is carried. Words of equal counts are told apart by their hash where the network's words are chosen, so ties
depend on no order of rows. Which documents a task trains on follows from how the rows are split: scores, not the base columns, differ with the layout of files.
Empty tables give no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import recurrent
from marlstone.llm.bytewords import words
from marlstone.llm.common import documents, like, materialize, released
from marlstone.llm.recurrent import HEAD, SHAPES, Network

FOLDS, HELD_OUT = 5, 1
#: Sixteenths of the training documents in each round, together all of them.
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, 16)))
#: Most words whose counts are broadcast: 16 bytes each.
FREQUENT = 1 << 19
#: Most distinct words a task counts before it hands them on; tokens in one call of the network.
HELD, TOKENS = 2_000_000, 2_000_000
#: Bytes of text that the scoring pass takes at once.
SLICE = 12_000_000
RATES = (0.02, 0.01, 0.006)
#: A task with few tokens goes over them again until it has made as many updates.
UPDATES = 40
_SHAPE = np.full(256, 3, np.uint64)
_SHAPE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 0
_SHAPE[ord(".")], _SHAPE[ord(",")] = 1, 2
LN10 = float(np.log(10))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word, number of words of each text). The key's low three bits are the word's shape."""
    found, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for data, starts, ends, owner, h in words(texts):
        wide = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data > 127, out=wide[1:])
        shape = _SHAPE[data[ends - 1]] + np.uint64(4) * (wide[ends] > wide[starts])
        found.append((h & ~np.uint64(7)) | shape)
        owners.append(owner)
    return np.concatenate(found), np.bincount(np.concatenate(owners), minlength=len(texts)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ks, ns = np.empty(0, np.uint64), np.empty(0, np.int64)
    for b in batches:
        for i in range(0, len(b), 1024):
            new, n = np.unique(keys(list(b["text"].iloc[i : i + 1024]))[0], return_counts=True)
            ks, at = np.unique(np.concatenate([ks, new]), return_inverse=True)
            ns = np.bincount(at, np.concatenate([ns, n]), minlength=len(ks)).astype(np.int64)
            if len(ks) > HELD:
                yield pd.DataFrame({"k": ks.view(np.int64), "n": ns})
                ks, ns = ks[:0], ns[:0]
    yield pd.DataFrame({"k": ks.view(np.int64), "n": ns})


class Lexicon:
    """Counts and head ids of the frequent words, found by the top bits of the key and a short search."""

    def __init__(self, ks: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(ks)
        self.keys, self.counts = ks[order], counts[order]
        self.bits = np.uint64(64 - max(1, int(len(ks)).bit_length() + 1))
        self.offset = np.searchsorted(self.keys >> self.bits, np.arange((1 << (64 - int(self.bits))) + 1, dtype=np.uint64)).astype(np.int32)
        self.ids = (HEAD + (self.keys & np.uint64(SHAPES - 1))).astype(np.int32)
        top = np.lexsort((self.keys, -self.counts))[: HEAD - 1]
        self.ids[top] = np.arange(1, len(top) + 1)

    def find(self, ks: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it isn't there."""
        out = np.full(len(ks), -1, np.int32)
        if not len(self.keys):
            return out
        bucket = (ks >> self.bits).astype(np.int64)
        at, end = self.offset[bucket], self.offset[bucket + 1]
        rows = np.flatnonzero(at < end)
        at, end, left = at[rows], end[rows], ks[rows]
        while len(rows):
            same = self.keys[at] == left
            out[rows[same]] = at[same]
            at = at + 1
            go = ~same & (at < end)
            rows, at, end, left = rows[go], at[go], end[go], left[go]
        return out

    def ids_of(self, ks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.ids[at] if len(self.ids) else 0, HEAD + (ks & np.uint64(SHAPES - 1)).astype(np.int32))


def with_ends(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts with the end id 0 after each, which of them are words, lengths with the end)."""
    word = np.ones(len(ids) + len(n), bool)
    word[np.cumsum(n + 1) - 1] = False
    out = np.zeros(len(word), np.int32)
    out[word] = ids
    return out, word, n + 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of several batches together, some SLICE bytes or one batch of more: many texts at once keep the network's lanes full."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column("text").nbytes
        if size >= SLICE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _train(lexicon, params, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, seen = lexicon.value, 0
        net = Network({k: v.copy() for k, v in recurrent.unflat(params.value).items()}, rate)
        held, ns, size = [], [], 0

        def learn() -> None:
            ids, _, lengths = with_ends(np.concatenate(held), np.concatenate(ns))
            for _ in net.run(ids, lengths, True):
                pass

        for part in _slices(batches):
            ks, n = keys(part.column("text").to_pylist())
            held.append(lex.ids_of(ks, lex.find(ks)))
            ns.append(n)
            size += len(ks) + len(n)
            seen += len(ks) + len(n)
            if size >= TOKENS:
                learn()
                held, ns, size = [], [], 0
        while size:
            learn()
            if net.steps >= UPDATES:
                break
        if seen:
            yield pa.RecordBatch.from_pydict({"tokens": pa.array([seen], pa.int64()), "values": pa.array([recurrent.flat(net.p).astype(np.float64)], pa.list_(pa.float64()))})

    return released(run)


def train(docs: DataFrame, lexicon, counts: np.ndarray) -> np.ndarray:
    """The model's parameters, from rounds over all of docs (doc_id, text)."""
    spark, values = docs.sparkSession, recurrent.flat(recurrent.start(counts))
    part = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(16))
    for own, rate in zip(ROUNDS, RATES, strict=True):
        handle = spark.sparkContext.broadcast(values)
        learnt = docs.where(part.isin(*own)).select("text").mapInArrow(_train(lexicon, handle, rate), "tokens long, values array<double>")
        each = learnt.select("tokens", F.posexplode("values").alias("i", "v"))
        mean = each.groupBy("i").agg((F.sum(F.col("v") * F.col("tokens")) / F.sum("tokens")).alias("v")).toPandas()  # a row per parameter
        if len(mean):
            values = mean.sort_values("i")["v"].to_numpy()
        handle.unpersist()
    return values


def _score(lexicon, params, tails: tuple[np.ndarray, np.ndarray], ends: int, total: float):
    """total: N + 0.5 * (V + 1). Words outside the lexicon are left in `rest`, with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, net = lexicon.value, Network(recurrent.unflat(params.value))
        mass = np.log10(tails[0] + 0.5 * (tails[1] + 1))
        for part in _slices(batches):
            ks, n = keys(part.column("text").to_pylist())
            at = lex.find(ks)
            ids, word, lengths = with_ends(lex.ids_of(ks, at), n)
            lp = np.empty(len(ids))
            for place, x in net.run(ids, lengths, False):
                lp[place] = x
            lp /= LN10
            base = np.full(len(ids), np.log10((ends + 0.5) / total))
            known = np.full(len(ids), ends > 0)
            seen = at >= 0
            own = np.where(seen, np.log10((lex.counts[at] if len(lex.counts) else 0) + 0.5), 0.0)
            base[word] = own - np.log10(total)
            known[word] = seen
            tail = ids >= HEAD
            lp[tail] -= mass[ids[tail] - HEAD]
            lp[word] += np.where(ids[word] >= HEAD, own, 0.0)
            first = np.cumsum(lengths) - lengths
            out = {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(lengths)}
            for name, v in (("n_known", known.astype(np.int64)), ("base_score", base), ("score", lp)):
                out[name] = pa.array(np.add.reduceat(v, first))
            owner = np.repeat(np.arange(len(n)), n)[~seen]
            away = ks[~seen].view(np.int64)
            cut = np.searchsorted(owner, np.arange(len(n) + 1))
            rest = [np.unique(away[i:j], return_counts=True) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            bounds = pa.array(np.r_[0, np.cumsum([len(r[0]) for r in rest])].astype(np.int32))
            for name, j in (("rest", 0), ("times", 1)):
                out[name] = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([r[j] for r in rest]).astype(np.int64)))
            yield from pa.table(out).to_batches()

    return released(run)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    training = rows.where(~F.col("held_out")).select("doc_id", "text")
    counts = materialize(training.select("text").mapInPandas(_count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "word-counts")
    ends = training.count()
    # 512 bins of the counts' logarithm and eight shapes: at most 4096 rows
    level = F.floor(F.log2("n") * 8)
    bins = counts.groupBy(level.alias("level"), F.col("k").bitwiseAND(SHAPES - 1).alias("shape")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).toPandas()
    n, v = int(bins["n"].sum()) + ends, int(bins["words"].sum()) + (ends > 0)
    above = bins.groupby("level")["words"].sum().sort_index(ascending=False).cumsum()
    cut = above[above <= FREQUENT].index.min() if (above <= FREQUENT).any() else None
    top = counts.where(level >= F.lit(int(cut))).toPandas() if cut is not None else pd.DataFrame({"k": np.empty(0, np.int64), "n": np.empty(0, np.int64)})  # at most FREQUENT rows
    lex = Lexicon(top["k"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))
    tails = np.zeros((2, SHAPES))
    for r in bins.itertuples():
        tails[:, int(r.shape)] += (r.n, r.words)
    heads = lex.ids < HEAD
    np.subtract.at(tails[0], (lex.keys[heads] & np.uint64(SHAPES - 1)).astype(int), lex.counts[heads])
    np.subtract.at(tails[1], (lex.keys[heads] & np.uint64(SHAPES - 1)).astype(int), 1)
    by_id = np.zeros(HEAD + SHAPES)
    by_id[0] = ends
    by_id[lex.ids[heads]] = lex.counts[heads]
    by_id[HEAD:] = tails[0]

    lexicon = spark.sparkContext.broadcast(lex)
    params = spark.sparkContext.broadcast(train(training, lexicon, by_id))
    total = n + 0.5 * (v + 1)
    schema = "held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<long>, times array<long>"
    scored = materialize(rows.mapInArrow(_score(lexicon, params, (tails[0], tails[1]), ends, total), like(rows, schema)).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("k"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = rest.join(counts, "k", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
    out = scored.drop("rest", "times").join(sums, "row", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.select("doc_id", "held_out", "n_tokens", add("n_known", "known"), F.lit(n).cast("long").alias("train_tokens"), add("base_score", "more"), add("score", "more"))


def query(spark, sf: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf}/documents.parquet"))
