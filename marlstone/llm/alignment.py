"""Cross-tokenizer alignment of a byte-level vocabulary (A) and a SentencePiece one (B).

Both tokenize the same bytes: A takes a space and the text, B the text, before which it puts a space itself. Each byte gets a label: no token ends
with it, one of A does, one of B, or one of both. A regular expression scans the label string; each of its matches runs up to the next label of both
and is a group, which has as many tokens of A and of B as its labels say. The last byte of a text has the label of both, so the texts of a slice are
scanned as one string.

All pairs of a token of A and one of B in a group are links. A pair of ids counts in how many documents it's linked somewhere; a link is best if no other
partner of its A id counts more. Groups, links and their sums are written once. Counts are sums over partial counts of tasks, so a pair that all
documents have is no hot key. The counts of the most frequent pairs (all above a power of 2 ** (1 / STEPS), so that they are HELD at most) are broadcast, those of the
others, each in few documents, joined by shuffle. The highest count of each A id, as many as the vocabulary has, is broadcast too.

Texts that are null or empty, or whose tokens' bytes don't make up the space and the text for both vocabularies (such as those that hold U+2581), have
no tokens: counts of 0 and no groups. Special tokens' strings are plain text. Repeated rows are documents each; equal counts are all the highest. Null
ids, and ids of any type, are handed on as they are. Very long texts are taken whole: links are made and summed TOGETHER at a time, so a group of
very many tokens holds no more at once. An empty table gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.binary_output import Encoder
from marlstone.llm.common import documents, like, materialize, released, slices
from marlstone.llm.sentencepieces import SPACE, Model
from marlstone.llm.wordtable import gathered

#: Labels of no token's end, an end of A, an end of B, and one of both; and the pattern of a group.
LABELS = b".AB*"
GROUP = re.compile(rb"[^*]*\*")
#: Links that are made at once; pairs whose counts are broadcast; steps of an octave by which their least count is found.
TOGETHER, HELD, STEPS = 1 << 20, 1 << 18, 8
_SIZES = "n_a long, n_b long, n_groups long, n_links long"


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class TokenBytes:
    """The bytes of each id, one after another."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return gathered(self.flat, self.first[ids], self.size[ids]).tobytes()

    def __len__(self) -> int:
        return len(self.size)


class PlainEncoder(Encoder):
    """Encodes strings of special tokens as the text that they are."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.t.encode_special_tokens = True
        self.special = []

    def token_bytes(self) -> TokenBytes:
        letters, vocabulary = byte_letters(), self.t.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return TokenBytes(tokens)


def piece_bytes(model: Model) -> TokenBytes:
    by_byte = {i: bytes([b]) for b, i in model.bytes.items()}
    return TokenBytes([by_byte[i] if i in by_byte else model.sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(model.sp.get_piece_size())])


def labels(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> bytes:
    """The label string of `size` bytes in which tokens end behind the given bytes."""
    code = np.zeros(size, np.uint8)
    code[ends_a - 1] |= 1
    code[ends_b - 1] |= 2
    return np.frombuffer(LABELS, np.uint8)[code].tobytes()


_counted: dict[bytes, int] = {}


def _count(span: bytes) -> int:
    """Tokens of A and B in a group, as one number. Short groups, which are few kinds, are remembered."""
    n = (span.count(b"A") + 1) << 32 | (span.count(b"B") + 1)
    if len(span) <= 24:
        _counted[span] = n
    return n


def groups(label: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, tokens of A, tokens of B) of each group of a label string."""
    if len(_counted) > 1 << 18:
        _counted.clear()
    spans, known = GROUP.findall(label), _counted.get
    n = np.array([known(s) or _count(s) for s in spans], np.int64)
    return np.fromiter(map(len, spans), np.int64, len(spans)), n >> 32, n & 0xFFFFFFFF


class Aligner:
    """Both tokenizers and what their ids stand for."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.encoder, self.model = PlainEncoder(a_path), Model(b_path)
        self.a, self.b = self.encoder.token_bytes(), piece_bytes(self.model)
        # each id before each of the separators ",", "|" (of A) or ";" (of B), and nothing
        self.a_text = np.array([f"{i}{end}" for i in range(len(self.a)) for end in ",|"], object)
        self.b_text = np.array([f"{i}{end}" for i in range(len(self.b)) for end in (",", ";", "")], object)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text; none where the bytes of one of them aren't the space and the text."""
        ids_a = [x.astype(np.int64) for x in self.encoder.batch([" " + t for t in texts])]
        ids, n = self.model.encode(texts)
        ids_b = [x[1:-1].astype(np.int64) for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []
        none = np.empty(0, np.int64)
        for k, t in enumerate(texts):
            raw = (" " + t).encode("utf-8", "surrogatepass")
            if not t or self.a.joined(ids_a[k]) != raw or self.b.joined(ids_b[k]) != raw:
                ids_a[k] = ids_b[k] = none
        return ids_a, ids_b

    def align(self, texts: list[str]) -> Slice:
        return Slice(self, *self.tokens(texts))


class Slice:
    """Groups and links of some texts."""

    def __init__(self, aligner: Aligner, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> None:
        self.aligner = aligner
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        empty = [np.empty(0, np.int64)]
        self.ids_a, self.ids_b = np.concatenate(empty + ids_a), np.concatenate(empty + ids_b)
        ends_a, ends_b = np.cumsum(aligner.a.size[self.ids_a]), np.cumsum(aligner.b.size[self.ids_b])
        self.bytes, self.p, self.q = groups(labels(ends_a, ends_b, int(ends_a[-1]) if len(ends_a) else 0))
        self.first_a, self.first_b = np.cumsum(self.p) - self.p, np.cumsum(self.q) - self.q
        self.text = np.searchsorted(np.cumsum(self.n_a), self.first_a, side="right")
        self.n_groups = np.bincount(self.text, minlength=len(self.n_a)).astype(np.int64)
        self.n_links = np.bincount(self.text, self.p * self.q, len(self.n_a)).astype(np.int64)

    def written(self) -> list[str]:
        """The groups of each text: `a1,a2|b1;a3|b2,b3`."""
        total = len(self.ids_a) + len(self.ids_b)
        out, last = np.empty(total, object), np.zeros(len(self.ids_a), bool)
        last[self.first_a + self.p - 1] = True
        out[np.arange(len(self.ids_a)) + np.repeat(self.first_b, self.p)] = self.aligner.a_text[2 * self.ids_a + last]
        end = np.zeros(len(self.ids_b), np.int64)
        end[self.first_b + self.q - 1] = 1
        ends = np.cumsum(self.n_b)
        end[ends[self.n_b > 0] - 1] = 2
        out[np.arange(len(self.ids_b)) + np.repeat(self.first_a + self.p, self.q)] = self.aligner.b_text[3 * self.ids_b + end]
        cut = np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        pieces = out.tolist()
        return ["".join(pieces[a:z]) for a, z in zip(cut, cut[1:], strict=False)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids, times) of each distinct linked pair of each text, in that order. A pair is a * (ids of B) + b."""
        width = len(self.aligner.b)
        wide = len(self.aligner.a) * width
        of = np.repeat(np.arange(len(self.p)), self.p)  # the group of each token of A, which has q links
        each = self.q[of]
        upto = np.cumsum(each)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, done = 0, 0
        while at < len(of):
            z = max(at + 1, int(np.searchsorted(upto, done + TOGETHER, side="right")))
            n = each[at:z]
            b = np.repeat(self.first_b[of[at:z]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            a = np.repeat(self.text[of[at:z]] * wide + self.ids_a[at:z] * width, n)
            found.append(np.unique(a + self.ids_b[b], return_counts=True))
            if len(found) > 8:
                found = [_summed(found)]
            at, done = z, int(upto[z - 1])
        key, times = _summed(found) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return key // wide, key % wide, times


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    key, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(which, np.concatenate([t for _, t in parts]), len(key)).astype(np.int64)


def pack_links(key: np.ndarray, times: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    return z.compress(np.diff(key, prepend=0).astype("<i8").tobytes() + times.astype("<i8").tobytes())


def unpack_links(packed: bytes, z: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(z.decompress(packed), "<i8").reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _align(a_path: str, b_path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, z = Aligner(a_path, b_path), zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            s = aligner.align(b.column("text").to_pylist())
            written = s.written()
            if digest:
                written = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in written]
            text, key, times = s.links()
            cut = np.searchsorted(text, np.arange(len(written) + 1)).tolist()
            packed = [pack_links(key[x:y], times[x:y], z) for x, y in zip(cut, cut[1:], strict=False)]
            columns = [b.column("doc_id"), *(pa.array(x) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)), pa.array(written, pa.string()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return released(run)


def align_documents(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links) for every row: groups as text or, with digest, its SHA-256; links packed (`unpack_links`). One
    pass without a shuffle."""
    rows = documents(docs, id_col, text_col)
    return rows.mapInArrow(_align(a_path, b_path, digest), like(rows, f"{_SIZES}, groups string, links binary"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many of a slice's documents each pair is."""
    z = zstandard.ZstdDecompressor()
    for b in slices(batches, 1024):
        key = np.concatenate([np.empty(0, np.int64), *(unpack_links(x, z)[0] for x in b.column("links").to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(key, return_counts=True)], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each pair of ids linked."""
    return aligned.select("links").mapInArrow(released(_pairs), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _octave(n: str = "n"):
    return F.floor(F.log2(F.col(n)) * STEPS).cast("int")


def _least_held(counts: DataFrame, held: int) -> int:
    """The least step of counts such that at most `held` pairs are at it or above: a few hundred rows on the driver."""
    steps = sorted(((r.step, r["count"]) for r in counts.groupBy(_octave().alias("step")).count().collect()), reverse=True)
    least, total = 1 << 20, 0
    for step, n in steps:
        total += n
        if total > held:
            break
        least = step
    return least


def _scored(shared, ids_b: int, schema: pa.Schema):
    """Sums over the links whose pairs' counts are at hand; `rest`, packed, are the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        z, c = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for b in slices(batches, 1024):
            n_best, sums, rest = [], [], []
            for packed in b.column("links").to_pylist():
                key, times = unpack_links(packed, z)
                at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
                here = pair[at] == key if len(pair) else np.zeros(len(key), bool)
                count = n[at[here]]
                n_best.append(int(times[here][count == best[key[here] // ids_b]].sum()))
                sums.append(int((times[here] * count).sum()))
                rest.append(None if here.all() else pack_links(key[~here], times[~here], c))
            columns = [b.column(name) for name in schema.names[:-3]] + [pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return released(run)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in slices(batches, 1024):
        found = [unpack_links(x, z) for x in b.column("rest").to_pylist()]
        rows = np.repeat(b.column("row").to_numpy(), [len(k) for k, _ in found])
        key, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(key), pa.array(times)], names=["row", "pair", "times"])


def cross_align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) for every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    aligned = materialize(align_documents(docs, a_path, b_path, digest, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = materialize(pair_counts(aligned), "pair-counts")
    ids_a, ids_b = vocabulary_sizes(a_path, b_path)
    highest = materialize(counts.groupBy(F.floor(F.col("pair") / ids_b).alias("a")).agg(F.max("n").alias("best")), "best-partners")  # at most a row per id of A
    best, found = np.zeros(ids_a, np.int64), highest.toArrow()
    best[found.column("a").to_numpy()] = found.column("best").to_numpy()
    least = _least_held(counts, held)
    often = counts.where(_octave() >= least).orderBy("pair").toArrow()  # at most `held` rows
    shared = spark.sparkContext.broadcast((often.column("pair").to_numpy(), often.column("n").to_numpy(), best))
    doc_kind = aligned.schema["doc_id"]
    schema = T.StructType([T.StructField("row", T.LongType()), doc_kind, *T._parse_datatype_string(f"{_SIZES}, groups string, n_best long, count_sum long, rest binary").fields])
    scored = materialize(aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links").mapInArrow(_scored(shared, ids_b, to_arrow_schema(schema)), schema), "scored-links")
    rare = counts.where(_octave() < least).withColumn("a", F.floor(F.col("pair") / ids_b)).join(F.broadcast(highest), "a").select("pair", "n", "best")
    rest = scored.where("rest is not null").select("row", "rest").mapInArrow(released(_unpacked), "row long, pair long, times long")
    rest = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = scored.drop("rest").join(rest, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def vocabulary_sizes(a_path: str, b_path: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(a_path).get_vocab().values()) + 1, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def query(spark, sf: str) -> DataFrame:
    import public_tokenizers

    d = cross_align(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return d.withColumnRenamed("groups", "groups_sha256")
