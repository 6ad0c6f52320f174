"""SentencePiece encoding and decoding for merge-type vocabularies.

A word is a list of symbols, one per character. An agenda holds each adjacent pair whose join is a piece, best score first, the leftmost first
on ties; pairs are joined in that order, and each join puts its two new neighbours on the agenda. What is left is looked up; a symbol that
is no piece falls back to its bytes. Many words are taken at once: a row of numpy arrays for each, of which every round joins the pair on top
of its agenda (Agenda); long words have an agenda in a heap (Model.merge).

White space is written as U+2581, with one more at the start. No piece of such a vocabulary has U+2581 after another character (Model sees
to that), so no join crosses the start of a run of U+2581, and a text's ids are those of its words. Each task remembers words in a table of bounded
size (wordtable.py). In every Arrow batch the words that are new are checked against the sentencepiece library; a difference is an error, never a
silent other result. Decoding is the library's.

Null and empty texts have the begin and end ids alone. Repeated rows, ties and null ids give a row each; ids of any type are handed on as
they are. Texts are taken whole, in pieces of bounded size, so very long ones need no more memory than their ids. An empty table gives no
rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import documents, like, released, slices
from marlstone.llm.wordtable import WordTable, padded, pieces

SPACE = "\u2581"
#: Fixed values of the model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of the longest word that numpy rows hold, and rows at once.
WIDEST, ROWS = 32, 1 << 14
_NONE = np.iinfo(np.int32).max


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        v |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return v, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            v, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class Model:
    """A model file's pieces and rules, with the library's processor for checks and decoding."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = list(_fields(sp.serialized_model_proto()))
        kinds = [dict(_fields(v)).get(3, NORMAL) for f, v in proto if f == 1]
        rules = dict(_fields(next((v for f, v in proto if f == 3), b"")))
        trainer = dict(_fields(next((v for f, v in proto if f == 2), b"")))
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if trainer.get(3) != 2:
            raise ValueError("not a merge-type vocabulary")
        if rules.get(1, b"identity") != b"identity" or rules.get(2, b"") or rules.get(4, 1) or rules.get(3, 1) != 1 or rules.get(5, 1) != 1:
            raise ValueError("only identity normalisation with a leading space is supported")
        if any(k in (USER_DEFINED, UNUSED) for k in kinds) or any(k == NORMAL and re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(pieces, kinds, strict=True)):
            raise ValueError("pieces with a space inside, defined by users or unused aren't supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        self.unknown = sp.unk_id()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.agenda, self.table = Agenda(self.ids, self.rank, len(pieces)), WordTable()

    def merge(self, word: str) -> list[str]:
        """The word's symbols after all joins of the agenda."""
        sym, rank = list(word), self.rank
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                agenda.append((r, i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != size:
                continue  # one of the two has been joined with another since
            sym[i] += sym[j]
            sym[j] = ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                r = rank.get(sym[i] + sym[k])
                if r is not None:
                    heapq.heappush(agenda, (r, i, k, len(sym[i]) + len(sym[k])))
            h = left[i]
            if h >= 0:
                r = rank.get(sym[h] + sym[i])
                if r is not None:
                    heapq.heappush(agenda, (r, h, i, len(sym[h]) + len(sym[i])))
        return [s for s in sym if s]

    def _symbols(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            out += [i] if i is not None else self.fallback(s)
        return out

    def fallback(self, symbol: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in symbol.encode()] if self.bytes else [self.unknown]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each). Words start with U+2581 where they follow white space."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        last = int(np.searchsorted(length[order], WIDEST, side="right"))
        out: list[np.ndarray] = [np.empty(0, np.uint32)]
        size = np.zeros(len(words), np.int64)
        for a in range(0, last, ROWS):
            rows = order[a : min(a + ROWS, last)]
            symbols = self.agenda.joined([words[k] for k in rows], length[rows])
            here = symbols >= 0
            plain = symbols < self.agenda.pieces
            size[rows] = here.sum(axis=1)
            if plain.all():
                out.append(symbols[here].astype(np.uint32))
                continue
            for k, row in zip(np.flatnonzero(~plain.all(axis=1)), symbols[~plain.all(axis=1)], strict=True):
                size[rows[k]] = sum(1 if s < self.agenda.pieces else len(self.fallback(chr(s - self.agenda.pieces))) for s in row[row >= 0].tolist())
            flat = symbols[here]
            n = np.ones(len(flat), np.int64)
            odd = np.flatnonzero(flat >= self.agenda.pieces)
            spelt = [self.fallback(chr(s)) for s in (flat[odd] - self.agenda.pieces).tolist()]
            n[odd] = [len(x) for x in spelt]
            long = np.repeat(flat, n)
            first = np.cumsum(n) - n
            for at, x in zip(first[odd].tolist(), spelt, strict=True):
                long[at : at + len(x)] = x
            out.append(long.astype(np.uint32))
        for k in order[last:].tolist():
            ids = self._symbols(self.merge(words[k]))
            size[k] = len(ids)
            out.append(np.array(ids, np.uint32))
        ids, n = np.concatenate(out), size[order]
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(n) - n
        return ids[np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(ids))], size

    def fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each start with a space, checked against the library."""
        texts = [w[1:].decode("utf-8", "surrogatepass") for w in words]
        ids, size = self.word_ids([SPACE + t.replace(" ", SPACE) for t in texts])
        alone = np.array([not t.strip(" ") for t in texts])  # nothing but spaces: not a word of a longer text
        together = ids[np.repeat(~alone, size)]
        theirs = self.sp.encode(" ".join([t for t in texts if t.strip(" ")])) if not alone.all() else []
        if not np.array_equal(together, np.array(theirs, np.uint32)):
            self._complain(texts, ids, size)
        for k in np.flatnonzero(alone):
            # the word of nothing is the space that the library puts before a text, which it leaves out
            if texts[k] and ids[size[:k].sum() :][: size[k]].tolist() != self.sp.encode(texts[k]):
                self._complain(texts[k : k + 1], ids[size[:k].sum() :], size[k : k + 1])
        return ids, size

    def _complain(self, texts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        for t, own in zip(texts, np.split(ids, np.cumsum(size))[: len(texts)], strict=True):
            if t and own.tolist() != (theirs := self.sp.encode(t)):
                raise ValueError(f"ids differ from the library's for {t!r}: {own.tolist()} and {theirs}")
        raise ValueError("ids of words together differ from the library's")

    def encode(self, texts: list[str | None], table: WordTable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with begin and end, number of ids of each)."""
        table = self.table if table is None else table
        raw = [t.encode("utf-8", "surrogatepass").replace(b"\xe2\x96\x81", b" ") if t else b"" for t in texts]
        out, count = [], np.full(len(texts), 2, np.int64)
        open_ = -1
        for held in pieces(raw):
            parts, owner = [], []
            for k, part, first in held:
                parts.append(b"\xff " if first and part else b"\xff")
                parts.append(part)
                owner.append(k)
            data = padded(parts)
            size = np.array([len(a) + len(b) for a, b in zip(parts[::2], parts[1::2], strict=True)])
            begin = np.cumsum(size) - size
            space = data[: int(size.sum())] == 32
            starts = np.flatnonzero(space & ~np.r_[False, space[:-1]])
            which = np.searchsorted(begin, starts, side="right") - 1
            ends = np.r_[starts[1:], int(size.sum())]
            edge = np.r_[which[1:] != which[:-1], True] if len(starts) else np.empty(0, bool)
            ends[edge] = (begin + size)[which[edge]]
            ids, n = table.encode(data, starts, ends, self.fresh)
            each = np.bincount(which, n, minlength=len(owner)).astype(np.int64)
            np.add.at(count, owner, each)
            at = 0
            for k, m in zip(owner, each.tolist(), strict=True):
                if k != open_:
                    out += [[self.eos]] * (open_ >= 0) + [[self.bos]]
                    open_ = k
                out.append(ids[at : at + m])
                at += m
        out += [[self.eos]] * (open_ >= 0)
        return np.concatenate([np.asarray(x, np.uint32) for x in out]) if out else np.empty(0, np.uint32), count

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode."""
        return self.sp.decode(ids.tolist())


class Agenda:
    """Agendas of many words at once. A symbol is its piece's id, or `pieces` and its code point where no piece is that character."""

    def __init__(self, ids: dict[str, int], rank: dict[str, float], pieces: int) -> None:
        self.pieces, self.ids = pieces, ids
        symbol = lambda s: ids[s] if s in ids else pieces + ord(s) if len(s) == 1 else -1
        level = {r: k for k, r in enumerate(sorted(set(rank.values())))}
        pairs = [(symbol(p[:k]), symbol(p[k:]), level[rank[p]], i) for p, i in ids.items() for k in range(1, len(p))]
        left, right, best, joined = np.array([x for x in pairs if x[0] >= 0 and x[1] >= 0], np.int64).reshape(-1, 4).T
        self.level, self.result = best.astype(np.int32), joined.astype(np.int32)
        self.key = left << 32 | right
        bits = max(4, int(4 * len(self.key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(self.key), dtype=np.int32), self._slot(self.key)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair, -1 where its join is no piece."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        out = self.slots[slot].astype(np.int64)
        left_ = np.flatnonzero((out >= 0) & (self.key[out] != key))
        while len(left_):
            slot[left_] = (slot[left_] + 1) & self.mask
            out[left_] = self.slots[slot[left_]]
            left_ = left_[(out[left_] >= 0) & (self.key[out[left_]] != key[left_])]
        return out

    def _levels(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The score's place of each pair, best 0; _NONE where its join is no piece."""
        entry = self.pair(left, right)
        return np.where((entry >= 0) & (left >= 0) & (right >= 0), self.level[entry], _NONE)

    def joined(self, words: list[str], length: np.ndarray) -> np.ndarray:
        """A row of symbols for each word, -1 behind its last."""
        n, widest = len(words), max(2, int(length.max()))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        each, which = np.unique(code, return_inverse=True)
        symbols = np.array([self.ids.get(chr(c), self.pieces + c) for c in each.tolist()], np.int32)
        s = np.full((n, widest), -1, np.int32)
        s[np.arange(widest) < length[:, None]] = symbols[which]
        done = np.full((n, widest), -1, np.int32)
        rows, place = np.arange(n), np.arange(widest)
        agenda = self._levels(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(n, -1)
        while True:
            top = agenda.argmin(axis=1)
            ended = agenda[np.arange(len(rows)), top] == _NONE
            if ended.any():
                done[rows[ended], : s.shape[1]] = s[ended]
                go = ~ended
                rows, s, agenda, top = rows[go], s[go], agenda[go], top[go]
            if not len(rows):
                return done
            k = np.arange(len(rows))
            s[k, top] = self.result[self.pair(s[k, top], s[k, top + 1])]
            width = s.shape[1]
            shift = place[:width] + (place[:width] > top[:, None])
            shift[:, -1] = np.minimum(shift[:, -1], width - 1)
            s = np.take_along_axis(s, shift, 1)
            s[:, -1] = -1
            agenda = np.take_along_axis(agenda, np.minimum(shift[:, :-1], width - 2), 1)
            if width > 2:
                s, agenda = s[:, :-1], agenda[:, :-1]
            else:
                agenda[:] = _NONE
                continue
            at = np.flatnonzero(top > 0)
            agenda[at, top[at] - 1] = self._levels(s[at, top[at] - 1], s[at, top[at]])
            at = np.flatnonzero(top < s.shape[1] - 1)
            agenda[at, top[at]] = self._levels(s[at, top[at]], s[at, top[at] + 1])


def _encode_batches(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(path)  # the task's own: with its table it would be a tenth of a worker's memory in all later stages
        for b in slices(batches):
            ids, n = m.encode(b.column("text").to_pylist())
            each = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
            back = [m.decode(x) for x in each]
            if digest:
                cols = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back], pa.string())]
            else:
                cols = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids.astype(np.int64))), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *cols], names=["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])])

    return released(run)


def encode_documents(docs: DataFrame, model: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with digest the SHA-256 of both instead. One pass without a shuffle."""
    rows = documents(docs, id_col, text_col)
    return rows.mapInArrow(_encode_batches(model, digest), like(rows, "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, decoded string")))


def query(spark, sf: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def stage(spark, docs: DataFrame, sf: str) -> DataFrame:
    """Pipeline: ids of each document, and the digest of what they decode to."""
    import public_tokenizers

    d = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return d.select("doc_id", "n_tokens", F.col("ids").cast("array<int>").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))
