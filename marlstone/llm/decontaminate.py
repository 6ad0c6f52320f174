"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every item. A document's words stream through it; at each word the length of the longest run
that ends there and occurs in an item is known. Where it reaches WINDOW, the last WINDOW words are a window of an item; an item with fewer
words is a window of its own, marked at the state that holds all of it. All words of such occurrences are hit.

Items are dealt into blocks of at most BLOCK_WORDS words (one item's length more at most). One block at a time is collected and broadcast, so
what the driver and a task hold is bounded whatever the benchmark's size; documents pass once per block. With one block, one pass is all; with several, each
pass writes its findings by the texts' SHA-256, the documents themselves are never written, and findings are joined to them in the end. Null and empty texts have no words.
Repeated rows and null ids give a row each; items with null or empty texts never occur, and the words of one without an id are hit like all
others but add nothing to the items found. Items with the same words all occur. Very long texts are taken whole; their time grows with their
length. An empty table gives no rows, an empty benchmark no hits. Other columns, whatever their names, are handed on as they are.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import LOWER, UPPER, beside, documents, free_name, last, materialize, new_path, put_back, released, ship, slices

WINDOW, BLOCK_WORDS = 10, 200_000
#: A document is dropped when more than this share of its words is hit.
COVERAGE_LIMIT = 0.5
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans(UPPER, LOWER)


def _lowered(text: str) -> str:
    """A-Z lowered; every character keeps its place."""
    return text.lower() if text.isascii() else text.translate(_LOW)


def words(text: str | None) -> list[str]:
    return _WORD.findall(_lowered(text)) if text else []


class Automaton:
    """A generalised suffix automaton over lists of words."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self._mark(items)

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        """A copy of q for the strings up to p's and w."""
        c = self._add(self.length[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._add(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _holder(self, state: int, size: int) -> int:
        """The state on the chain of suffix links that holds the last `size` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, items: list[tuple[object, list[str]]]) -> None:
        full: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        for item, ws in items:
            state, named = 0, () if item is None else (item,)
            for n, w in enumerate(ws, 1):
                state = self.next[state][w]
                if n >= self.window:
                    full.setdefault(self._holder(state, self.window), set()).update(named)
            if 0 < len(ws) < self.window:
                short.setdefault(self._holder(state, len(ws)), {}).setdefault(len(ws), set()).update(named)
        self.full = full
        # for each state, the short items among the suffixes of its strings: (words, items), longest first
        self.short: list[tuple] = [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            own = tuple((n, frozenset(x)) for n, x in sorted(short.get(s, {}).items(), reverse=True))
            self.short[s] = own + self.short[self.link[s]] if own else self.short[self.link[s]]
        self.any_short = any(self.short)

    def match(self, ws: list[str]) -> tuple[list[tuple[int, int]], set, int]:
        """Maximal hit spans [first, last) in words, items with an occurring window, and the longest matching length."""
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        root, state, n, most = nxt[0], 0, 0, 0
        spans: list[list[int]] = []
        items: set = set()
        for i, w in enumerate(ws):
            if state == 0 and w not in root:
                continue
            t = nxt[state].get(w)
            while t is None and state:
                state = link[state]
                n = length[state]
                t = nxt[state].get(w)
            if t is None:
                continue
            state, n = t, n + 1
            if n > most:
                most = n
            reach = 0
            if n >= window:
                reach = window
                items |= self.full[self._holder(state, window)]
            if short[state]:
                for size, found in short[state]:
                    if size <= n:
                        items |= found
                        reach = max(reach, size)
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, i + 1])
        return [tuple(s) for s in spans], items, most


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str | None, list[str]]]]:
    """Blocks of (item id as text, words), one at a time; an item's block follows from the words of the items before it. The driver holds one block."""
    rows = documents(benchmark, id_col, text_col).select(F.col("doc_id").cast("string").alias("item"), "text", F.xxhash64("doc_id", "text").alias("h"))
    # a sum per bucket of the hash, and one within it, put items in blocks without ordering all of them in one task
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(4096))).withColumn("n", F.regexp_count(F.translate("text", UPPER, LOWER), F.lit(_WORD.pattern)).cast("double"))
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = rows.join(F.broadcast(sums), "bucket").withColumn("block", F.floor((inside + F.col("before")) / block_words))  # at most 4096 sums
    path = new_path(benchmark.sparkSession, "benchmark-blocks")
    placed.select("block", "item", "text").write.partitionBy("block").parquet(path)
    blocks = benchmark.sparkSession.read.schema("item string, text string, block long").parquet(path)
    for k in sorted(r[0] for r in blocks.select("block").distinct().collect()):
        items = [(r["item"], words(r["text"])) for r in blocks.where(F.col("block") == k).select("item", "text").collect()]  # reads that block's folder
        yield [(i, w) for i, w in items if w]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """All columns of docs, and a struct `found` of n_words, spans (maximal hit spans of words as [first, last)), items (in order of their
    text) and longest."""
    spark = docs.sparkSession
    ship(spark)
    blocks = benchmark_blocks(benchmark, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        fields = T._parse_datatype_string(_FOUND).fields
        rows = docs.select(beside(docs, text_col), F.col(f"`{text_col}`").alias("text"))
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(first), window, ["rest", "text"]), T.StructType([rows.schema["rest"], rows.schema["text"], *fields]))
        return put_back(rows, docs, text_col, F.struct(*(f.name for f in fields)), "found")
    # several blocks: a pass over the texts for each, which writes what it finds by the text's digest; the documents themselves are not written
    keyed = docs.select(_digest(text_col).alias("key"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    parts = []
    for items in itertools.chain([first, second], blocks):  # a block's pass ends before the next block is collected
        handle = spark.sparkContext.broadcast(items)
        found = keyed.mapInArrow(_pass(handle, window, ["key"]), f"key binary, {_FOUND}").where("n_words > 0").dropDuplicates(["key"])
        parts.append(materialize(found, "decontamination-findings"))
        handle.destroy()
    whole = functools.reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))  # a row per block of each key
    whole = whole.mapInArrow(released(_merged), f"key binary, {_FOUND}").select(F.col("key").alias("_key"), F.struct(*(f.name for f in T._parse_datatype_string(_FOUND).fields)).alias("_found"))
    none = F.expr("named_struct('n_words', 0L, 'spans', cast(array() as array<array<bigint>>), 'items', cast(array() as array<string>), 'longest', 0L)")
    key = free_name(docs, "key")
    both = docs.withColumn(key, _digest(text_col)).join(whole, F.col(f"`{key}`") == F.col("_key"), "left")
    return both.select(*(docs[f"`{c}`"] for c in docs.columns), F.coalesce("_found", none).alias(free_name(docs, "found")))


_FOUND = "n_words long, spans array<array<long>>, items array<string>, longest long"


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.col(f"`{text_col}`"), 256))


_automata: dict[tuple[int, int], tuple] = {}


def automaton(handle, window: int) -> Automaton:
    """A broadcast block's automaton. A Python worker, which knows each broadcast by one handle, builds it once and keeps the latest one."""
    if (found := _automata.get((id(handle), window))) is None or found[0] is not handle:
        _automata.clear()
        found = _automata[id(handle), window] = (handle, Automaton(handle.value, window))
    return found[1]


def _pass(handle, window: int, through: list[str]):
    """One block's automaton over all texts, beside the columns to hand through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(handle, window)
        for b in slices(batches):
            if b.num_rows:
                n, spans, items, longest = [], [], [], []
                for t in b.column("text").to_pylist():
                    ws = words(t)
                    s, i, m = found.match(ws)
                    n.append(len(ws))
                    spans.append([list(x) for x in s])
                    items.append(sorted(i))
                    longest.append(m)
                columns = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in through), *columns], names=[*through, "n_words", "spans", "items", "longest"])

    return released(run)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks as maximal ones."""
    for b in batches:
        spans = [[list(x) for x in _union([], [tuple(x) for x in s])] for s in b.column("spans").to_pylist()]
        yield b.set_column(b.schema.get_field_index("spans"), "spans", pa.array(spans, pa.list_(pa.list_(pa.int64()))))


def _union(a: list, b: list) -> list:
    out: list = []
    for s in sorted([*a, *b]):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(tuple(s))
    return out


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans; what stands between two removed words goes with them."""
    at = [m.span() for m in _WORD.finditer(_lowered(text))]
    out, last_ = [], 0
    for a, z in spans:
        out.append(text[last_ : at[int(a)][0]])
        last_ = at[int(z) - 1][1]
    return "".join(out) + text[last_:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [cut_spans(t, s) if s else t for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string()), b.column("hit")], names=["rest", "text", "hit"])


def _hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE_LIMIT, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """All columns of docs, the text without its hit spans, and `removed_words`; documents more than `coverage` of whose words are hit go."""
    found = find(docs, benchmark, window, text_col=text_col)
    f = last(found)
    kept = found.select(*(F.col(f"`{c}`") for c in docs.columns), F.struct(f.n_words, f.spans, _hit(f.spans).alias("hit")).alias(found.columns[-1])).where((f.hit == 0) | (f.hit <= coverage * f.n_words))
    rows = kept.select(beside(docs, text_col), F.col(f"`{text_col}`").alias("text"), f.spans.alias("spans"), f.hit.alias("hit"))
    cut = rows.mapInArrow(released(_cut), T.StructType([rows.schema["rest"], rows.schema["text"], rows.schema["hit"]]))
    return put_back(cut, docs, text_col, F.col("hit"), "removed_words")


def query(spark, sf: str) -> DataFrame:
    d = find(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    f, n_hit = last(d), _hit(last(d).spans)
    return d.select("doc_id", f.n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Pipeline: benchmark passages are cut out, and documents that mostly consist of them go."""
    d = decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    return d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
