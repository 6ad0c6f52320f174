"""Token ids as binary files: patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id, encoded, and written as segments. A segment holds whole documents, at least SEGMENT_IDS ids unless
it is a shard's last, and is one row of a Parquet table: Spark's writer commits it, so a lost executor leaves no half file, and any store
that Spark writes will do. Its `payload` is, little-endian:

    "PFOR" | uint32 ids | uint32 blocks | uint32 start of each block, from the payload's start | blocks

and a block of up to BLOCK ids is

    uint32 minimum | uint16 ids - 1 | uint8 width | uint16 exceptions | packed offsets, `width` bits each, lowest bit first |
    uint16 position of each exception | uint32 offset of each exception

The width is that of the PERCENTILE offset from the block's minimum, so a few large ids cost an entry in the exception list and not bits in
all others. The block index lets a reader reach any id without decoding what comes before it.

Null and empty texts have the end id alone. Rows with the same id follow each other in order of their length and text; null ids come first.
Ids may be of any type that Spark orders. Texts are taken whole, in pieces of bounded size; a very long document makes its segment longer.
An empty table gives files without rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.llm.common import documents, like, new_path, released, slices
from marlstone.llm.wordtable import WordTable, gathered, padded, pieces

BLOCK, SEGMENT_IDS, PERCENTILE = 1024, 1_000_000, 0.9
#: Chunks that the library takes as one text, and how a byte-level vocabulary writes a space.
TOGETHER, SPACE = 2_000, "\u0120"
END_ID = 0


def _widths(offsets: np.ndarray) -> np.ndarray:
    return np.where(offsets > 0, np.floor(np.log2(np.maximum(offsets, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _shifted(values: np.ndarray, w: int) -> np.ndarray:
    """Each row's values in w bits each, lowest bit first, as bytes. Values that start at the same bit of a 64-bit word are shifted together."""
    n, size = values.shape
    out = np.zeros((n, size * w // 64 + 2), np.uint64)
    for k in range(min(64, size) if w else 0):  # after 64 values the places in a word repeat
        at, bit = k * w // 64, np.uint64(k * w % 64)
        v = values[:, k::64]
        out[:, at : at + v.shape[1] * w : w][:, : v.shape[1]] |= v << bit
        if int(bit) + w > 64:
            out[:, at + 1 : at + 1 + v.shape[1] * w : w][:, : v.shape[1]] |= v >> (np.uint64(64) - bit)
    return np.ascontiguousarray(out.astype("<u8").view(np.uint8)[:, : -(-size * w // 8)])


def _unshifted(raw: np.ndarray, size: int, w: int) -> np.ndarray:
    out = np.zeros((len(raw), size), np.uint32)
    if w:
        wide = np.zeros((len(raw), 8 * (size * w // 64 + 2)), np.uint8)
        wide[:, : raw.shape[1]] = raw
        words, mask = wide.view("<u8"), np.uint64((1 << w) - 1)
        for k in range(min(64, size)):
            at, bit, n = k * w // 64, np.uint64(k * w % 64), -(-(size - k) // 64)
            v = words[:, at : at + n * w : w][:, :n] >> bit
            if int(bit) + w > 64:
                v = v | words[:, at + 1 : at + 1 + n * w : w][:, :n] << (np.uint64(64) - bit)
            out[:, k::64] = v & mask
    return out


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A segment's payload. Full blocks of one width are packed together."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = -(-len(ids) // block)
    parts: list[bytes] = [b""] * n
    full = len(ids) // block
    for first, count, size in ((0, full, block), (full, n - full, len(ids) - full * block)):
        if not count:
            continue
        values = ids[first * block : first * block + count * size].reshape(count, size)
        low = values.min(axis=1)
        off = values - low[:, None]
        k = min(size - 1, int(percentile * size))
        width = _widths(np.partition(off, k, axis=1)[:, k])
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            v = off[rows]
            over = v >= (np.uint64(1) << np.uint64(w))
            packed = _shifted(np.where(over, 0, v).astype(np.uint64), int(w))
            for j, r in enumerate(rows):
                at = np.flatnonzero(over[j])
                head = struct.pack("<IHBH", int(low[r]), size - 1, int(w), len(at))
                parts[first + r] = head + packed[j].tobytes() + at.astype("<u2").tobytes() + v[j, at].astype("<u4").tobytes()
    starts = 12 + 4 * n + np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]) if n else np.empty(0)
    return b"PFOR" + struct.pack("<II", len(ids), n) + starts.astype("<u4").tobytes() + b"".join(parts)


def unpack(payload: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of blocks first_block up to last_block (exclusive; None: all)."""
    if payload[:4] != b"PFOR":
        raise ValueError("not a PFOR payload")
    _, n = struct.unpack_from("<II", payload, 4)
    starts = np.frombuffer(payload, "<u4", n, 12)
    out, plain = {}, {}
    for k in range(first_block, n if last_block is None else min(n, last_block)):
        low, size, w, m = struct.unpack_from("<IHBH", payload, at := int(starts[k]))
        plain.setdefault((size + 1, w), []).append((k, at + 9, low, m))
    for (size, w), blocks in plain.items():
        length = -(-size * w // 8)
        raw = np.stack([np.frombuffer(payload, np.uint8, length, at) for _, at, _, _ in blocks]) if length else np.zeros((len(blocks), 0), np.uint8)
        v = _unshifted(raw, size, w)
        for j, (k, at, low, m) in enumerate(blocks):
            if m:
                v[j, np.frombuffer(payload, "<u2", m, at + length)] = np.frombuffer(payload, "<u4", m, at + length + 2 * m)
            out[k] = v[j] + np.uint32(low)
    return np.concatenate([out[k] for k in sorted(out)]) if out else np.empty(0, np.uint32)


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space of any script, by the encoding of its characters."""
    white = _ASCII_WHITE[data]
    lead = np.flatnonzero(_WHITE_LEAD[data[:-2]])
    one, two = data[lead + 1], data[lead + 2]
    wide = (data[lead] == 0xC2) & ((one == 0x85) | (one == 0xA0))
    white[lead[wide]] = white[lead[wide] + 1] = True
    code = (data[lead].astype(np.int32) << 16) | (one.astype(np.int32) << 8) | two
    wide = np.isin(code, _WIDE_WHITE)
    for k in range(3):
        white[lead[wide] + k] = True
    return white


#: The UTF-8 bytes of white space beyond ASCII, of three bytes each (those of two, C2 85 and C2 A0, are in _white).
_WIDE_WHITE = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080], np.int32)
_ASCII_WHITE, _WHITE_LEAD = np.zeros(256, bool), np.zeros(256, bool)
_ASCII_WHITE[[*range(9, 14), *range(28, 33)]] = True
_WHITE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Texts to ids. A single space between two characters that aren't white space always starts a new token of a byte-level vocabulary, so
    a text's ids are those of its chunks, cut before such spaces; each distinct chunk is encoded by the library and remembered in a table of
    bounded size (wordtable.py). Texts with a special token go through the library whole."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t, self.table = Tokenizer.from_file(path), WordTable()
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        vocabulary = self.t.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] == SPACE]] = True

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks. Those with one space, their first character, and no white space at the end are given to the library together, and
        told apart by the tokens that start with a space."""
        texts = [c.decode("utf-8", "surrogatepass") for c in chunks]
        plain = [k for k, t in enumerate(texts) if t.rfind(" ") == 0 and not t[-1].isspace()]
        pool, used = [np.empty(0, np.uint32)], 0
        first, size = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
        for i in range(0, len(plain), TOGETHER):
            some = plain[i : i + TOGETHER]
            ids = np.array(self._library(["".join([texts[k] for k in some])])[0], np.uint32)
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) == len(some):
                first[some], size[some] = used + cut, np.diff(cut, append=len(ids))
                pool.append(ids)
                used += len(ids)
        rest = np.flatnonzero(size < 0).tolist()
        for k, x in zip(rest, self._library([texts[k] for k in rest]), strict=True):
            first[k], size[k] = used, len(x)
            pool.append(np.array(x, np.uint32))
            used += len(x)
        return gathered(np.concatenate(pool), first, size), size

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = [k for k, t in enumerate(texts) if t and any(s in t for s in self.special)]
        special = set(whole)
        raw = [b"" if k in special or not t else t.encode("utf-8", "surrogatepass") for k, t in enumerate(texts)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for held in pieces(raw):
            data = padded([x for _, part, _ in held for x in (b"\xff", part)])
            size = np.array([len(part) + 1 for _, part, _ in held])
            begin, end = np.cumsum(size) - size + 1, np.cumsum(size)
            white = _white(data)
            space = np.flatnonzero(data[1 : end[-1]] == 32) + 1
            space = space[~white[space - 1] & ~white[space + 1] & (data[space + 1] != 0xFF)]
            cut = np.zeros(len(data), bool)
            cut[space] = cut[begin[begin < end]] = True
            starts = np.flatnonzero(cut)
            which = np.searchsorted(begin, starts, side="right") - 1
            ends = np.r_[starts[1:], 0]
            edge = np.r_[which[1:] != which[:-1], True] if len(starts) else np.empty(0, bool)
            ends[edge] = end[which[edge]]
            ids, n = self.table.encode(data, starts, ends, self.fresh)
            each = np.bincount(which, n, minlength=len(held)).astype(np.int64)
            for (k, _, _), x in zip(held, np.split(ids, np.cumsum(each)[:-1]), strict=True):
                out[k].append(x)
        for k, ids in zip(whole, self._library([texts[k] for k in whole]), strict=True):
            out[k] = [np.array(ids, np.uint32)]
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker, whose table serves its tasks in turn."""
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def _segments(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(path), TaskContext.get().partitionId()
        end = np.array([END_ID], np.uint32)
        ids, docs, lengths, held, start, segment = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            values = {"shard": [shard], "segment": [segment], "start": [start], "n_ids": [held], "doc_ids": [docs], "lengths": [lengths], "payload": [pack(np.concatenate(ids))]}
            return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in schema], schema=schema)

        for b in slices(batches):
            for d, x in zip(b.column("doc_id").to_pylist(), enc.batch(b.column("text").to_pylist()), strict=True):
                ids += (x, end)
                docs.append(d)
                lengths.append(len(x) + 1)
                held += lengths[-1]
                if held >= SEGMENT_IDS:
                    yield flush()
                    start, segment, held = start + held, segment + 1, 0
                    ids, docs, lengths = [], [], []
        if docs:
            yield flush()

    return released(run)


def _schema(id_type: T.DataType) -> T.StructType:
    """Of the files; ids are of any type."""
    long = T.LongType()
    kinds = {"shard": T.IntegerType(), "segment": T.IntegerType(), "start": long, "n_ids": long, "doc_ids": T.ArrayType(id_type), "lengths": T.ArrayType(long), "payload": T.BinaryType()}
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes all documents and writes them in ascending order of id: shards are ranges of ids. Returns the folder."""
    path = path or new_path(docs.sparkSession, "token-ids")
    rows = documents(docs, id_col, text_col)
    schema = _schema(rows.schema["doc_id"].dataType)
    # the length takes part so that rows without an id, which may be many, aren't one range
    ordered = rows.repartitionByRange("doc_id", F.length("text")).sortWithinPartitions("doc_id", F.length("text"), "text")
    ordered.mapInArrow(_segments(tokenizer, to_arrow_schema(schema)), schema).write.parquet(path)
    return path


def shard_starts(segments: DataFrame) -> DataFrame:
    """(shard, shard_start): one row per shard, from the segments' counts alone."""
    sums = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return sums.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, first, docs, n, payload in zip(*(b.column(c) for c in ("shard", "start", "doc_ids", "lengths", "payload")), strict=True):
            raw, n = unpack(payload.as_py()).astype("<u4").tobytes(), np.asarray(n.values, np.int64)
            ends = np.cumsum(n)
            starts = ends - n
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            cols = {"doc_id": docs.values, "shard": pa.array([shard.as_py()] * len(n), pa.int32()), "start": pa.array(starts + first.as_py()), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _files(spark, path: str) -> tuple[DataFrame, T.StructType]:
    files = spark.read.parquet(path)
    return files, T.StructType([T.StructField("doc_id", files.schema["doc_ids"].dataType.elementType)])


def read_documents(spark, path: str) -> DataFrame:
    """Per document, decoded from the files: (doc_id, start, n_tokens, ids_crc32)."""
    files, own = _files(spark, path)
    rows = files.mapInArrow(released(_read), like(spark.createDataFrame([], own), "shard int, start long, n_tokens long, ids_crc32 long"))
    starts = shard_starts(files)  # a row per shard, as many as there were write tasks: bounded by the number of partitions
    return rows.join(F.broadcast(starts), "shard").select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def _read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for docs, n, payload in zip(b.column("doc_ids"), b.column("lengths"), b.column("payload"), strict=True):
            offsets = np.r_[0, np.cumsum(np.asarray(n.values, np.int64))].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unpack(payload.as_py()).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([docs.values, ids], names=["doc_id", "ids"])


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, ids) with the end id."""
    files, own = _files(spark, path)
    return files.mapInArrow(released(_read_ids), like(spark.createDataFrame([], own), "ids array<long>"))


def query(spark, sf: str) -> DataFrame:
    import public_tokenizers

    return read_documents(spark, write_ids(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
