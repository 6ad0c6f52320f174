"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, which change places around sentinels.

A text's units are the tokens `[A-Za-z]+|[^A-Za-z]`. One table-driven automaton over UTF-8 bytes finds them, characters and sentinels in a single
scan: its state is what the last bytes began (a letter run, the bytes that a character still needs, how much of a sentinel), and a transition
emits what starts or ends with its byte. The first scan only counts what is emitted, per block of BLOCK bytes; a second scan of the two blocks
that hold a document's cuts finds their bytes. All blocks of a batch advance together, one byte a step, as columns of a numpy array. The state
at a block's start is that after the LOOKBACK bytes before it, whatever came earlier: the automaton forgets its start in so many bytes, which is
proved from its table when it is made (`settles`).

The choice of form and cuts is drawn from SHA-256 of "seed:id", so it depends on the id alone. Plain documents stay as they are: empty ones,
those that hold a sentinel already, and those that the rate leaves out. No sentinel begins as another one ends, so none arises where two pieces meet, and
`restored` rebuilds the text exactly from an output and its form.

Null texts are empty and empty ones plain. A null id counts as the empty string of digits; ids of any type are handed on as they are. Repeated
rows are cut alike, a row each; equal cuts (an empty middle) are allowed. A byte that can't begin or continue a character, which a string column
can hold, is a character of its own. Very long texts are taken whole: what is held beside a batch's bytes is a few numbers per block. An
empty table gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import documents, like, released, slices

#: The sentinels, before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of documents that are transformed, and of those the percent with the suffix first.
RATE, SPM = 90, 20
BLOCK, LOOKBACK = 256, 4
UNIT, CHARACTER, SENTINEL = 1, 2, 4

# states: after another character, in a letter run, one to three bytes of a character to come, after "<", after "<" and a sentinel's letter
_OTHER, _LETTERS, _ONE, _TWO, _THREE, _OPEN, _NAMED = range(7)


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) of each (state, byte), as flat arrays indexed by state * 256 + byte."""
    following, emits = np.zeros((7, 256), np.uint8), np.zeros((7, 256), np.uint8)
    letters = [*range(65, 91), *range(97, 123)]
    lead = {**dict.fromkeys(range(0xC2, 0xE0), _ONE), **dict.fromkeys(range(0xE0, 0xF0), _TWO), **dict.fromkeys(range(0xF0, 0xF5), _THREE)}
    for state in range(7):
        for byte in range(256):
            if byte in letters:
                run = state in (_LETTERS, _NAMED)
                following[state, byte] = _NAMED if state == _OPEN and byte in b"PSM" else _LETTERS
                emits[state, byte] = CHARACTER if run else UNIT | CHARACTER
            elif 0x80 <= byte < 0xC0 and state in (_ONE, _TWO, _THREE):
                following[state, byte] = {_ONE: _OTHER, _TWO: _ONE, _THREE: _TWO}[state]
            else:
                following[state, byte] = lead.get(byte, _OPEN if byte == ord("<") else _OTHER)
                emits[state, byte] = UNIT | CHARACTER | (SENTINEL if state == _NAMED and byte == ord(">") else 0)
    return following.ravel(), emits.ravel()


NEXT, EMIT = automaton()


def settles(following: np.ndarray = NEXT, most: int = 8) -> int:
    """After how many bytes, whatever they are, no two states are left apart."""
    table = following.reshape(-1, 256)
    pairs = {(a, b) for a in range(len(table)) for b in range(a)}
    for steps in range(most + 1):
        if not pairs:
            return steps
        pairs = {(max(x, y), min(x, y)) for a, b in pairs for x, y in zip(table[a].tolist(), table[b].tolist(), strict=True) if x != y}
    raise ValueError("the automaton doesn't forget its start")


if settles() > LOOKBACK:
    raise AssertionError("LOOKBACK is shorter than the automaton's memory")


class Blocks:
    """The texts of a batch, each cut into blocks of BLOCK bytes; one scan counts what each block emits."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        size = np.diff(offsets)
        self.per_text = -(-size // BLOCK)
        self.first = np.r_[0, np.cumsum(self.per_text)]
        owner = np.repeat(np.arange(len(size)), self.per_text)
        self.start = offsets[owner] + BLOCK * (np.arange(len(owner)) - self.first[owner])
        self.end = np.minimum(self.start + BLOCK, offsets[owner + 1])
        self.begin = offsets[owner]
        self.units, self.characters, self.sentinels = self._scan(np.arange(len(owner)), counts=True)
        total = lambda x: np.add.reduceat(np.r_[x, 0], self.first[:-1]) * (self.per_text > 0) if len(size) else x
        self.n_units, self.n_characters, self.n_sentinels = total(self.units), total(self.characters), total(self.sentinels)

    def _scan(self, blocks: np.ndarray, counts: bool):
        """The automaton over some blocks in step. counts: what each emits, by kind; otherwise each byte's emission, a row per byte."""
        start, end, begin = self.start[blocks], self.end[blocks], self.begin[blocks]
        state = np.full(len(blocks), _OTHER, np.int64)
        for k in range(-LOOKBACK, 0):
            at = start + k
            here = at >= begin
            state[here] = NEXT[state[here] << 8 | self.data[at[here]]]
        sums = np.zeros((3, len(blocks)), np.int64)
        size = end - start
        longest = int(size.max(initial=0))
        rows = np.zeros((0 if counts else longest, len(blocks)), np.uint8)
        full = bool((size == longest).all())
        for k in range(longest):
            if full:
                index = state << 8 | self.data[start + k]
                state, out = NEXT[index].astype(np.int64), EMIT[index]
            else:
                here = size > k
                index = state << 8 | self.data[np.minimum(start + k, len(self.data) - 1)]
                state, out = NEXT[index].astype(np.int64), EMIT[index] * here
            if counts:
                for j, kind in enumerate((UNIT, CHARACTER, SENTINEL)):
                    sums[j] += (out & kind) > 0
            else:
                rows[k] = out
        return sums if counts else rows

    def cuts(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the unit of that number (from 0) of each text starts: (byte from the text's start, characters before). Its end, if it has no
        such unit."""
        before_units = np.r_[0, np.cumsum(self.units)]
        before_chars = np.r_[0, np.cumsum(self.characters)]
        byte, chars = np.diff(self.offsets)[texts], self.n_characters[texts].copy()
        inner = np.flatnonzero(units < self.n_units[texts])
        t = texts[inner]
        wanted = before_units[self.first[t]] + units[inner]  # units before it, over all blocks
        block = np.searchsorted(before_units, wanted, side="right") - 1
        for a in range(0, len(inner), 4096):
            some, b = inner[a : a + 4096], block[a : a + 4096]
            out = self._scan(b, counts=False)
            at = np.argmax(np.cumsum(out & UNIT, axis=0, dtype=np.int32) > (wanted[a : a + 4096] - before_units[b]), axis=0)
            byte[some] = self.start[b] + at - self.begin[b]
            inside = (out & CHARACTER > 0) & (np.arange(len(out))[:, None] < at)
            chars[some] = before_chars[b] - before_chars[self.first[t[a : a + 4096]]] + inside.sum(axis=0)
        return byte, chars


def draws(seed: int, ids: list) -> np.ndarray:
    """Four 32-bit numbers for each id, from the SHA-256 of "seed:id"."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(len(ids), 4).astype(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls, as they lie in its buffers."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8, int(offsets[-1])) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] :], offsets - offsets[0]


def _transform(seed: int, rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offsets = _texts(b.column("text"))
            blocks = Blocks(data, offsets)
            n, h = blocks.n_units, draws(seed, b.column("doc_id").to_pylist())
            cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
            plain = (n == 0) | (blocks.n_sentinels > 0) | (h[:, 2] % 100 >= rate)
            first = h[:, 3] % 100 < spm
            cut = np.flatnonzero(~plain)
            byte1, char1 = blocks.cuts(cut, cuts[cut, 0])
            byte2, char2 = blocks.cuts(cut, cuts[cut, 1])
            raw = data.tobytes()
            texts = [raw[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            for k, x, y in zip(cut.tolist(), byte1.tolist(), byte2.tolist(), strict=True):
                t = texts[k]
                prefix, middle, suffix = t[:x], t[x:y], t[y:]
                texts[k] = b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if first[k] else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
            form = np.where(plain, "plain", np.where(first, "spm", "psm"))
            prefix_chars, middle_chars = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            prefix_chars[cut], middle_chars[cut] = char1, char2 - char1
            columns = [
                b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain),
                pa.array(texts, pa.binary()).cast(pa.string(), safe=False),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return released(run)


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row; the counts of characters are null where the form is plain. One pass
    without a shuffle."""
    rows = documents(docs, id_col, text_col)
    return rows.mapInArrow(_transform(seed, rate, spm), like(rows, "n long, form string, prefix_chars long, middle_chars long, output string"))


def restored(output: str = "output", form: str = "form"):
    """The text that an output of a form was made from, as a column: what the sentinels part is put in order again."""
    text = F.col(output)
    after = lambda s: F.locate(s.decode(), text)
    p, s, m = after(PREFIX), after(SUFFIX), after(MIDDLE)
    size, end = len(PREFIX), F.length(text) + 1
    part = lambda a, z: F.substring(text, a + size, z - a - size)
    return F.when(F.col(form) == "psm", F.concat(part(p, s), part(m, end), part(s, m))).when(F.col(form) == "spm", F.concat(part(p, m), part(m, end), part(s, p))).otherwise(text)


def query(spark, sf: str) -> DataFrame:
    d = fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
