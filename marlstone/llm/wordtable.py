"""What each word of a text was encoded to, remembered in numpy arrays of bounded size.

A word of up to 8 * WIDTH bytes is its own key: its bytes, filled up with 0xFF, which no UTF-8 text holds. So a found word is the same word and
never only one with the same hash. Longer words are looked up in the texts at hand alone. Where the table is full, words that have come up
again since the last time stay and the others go; what a word is encoded to doesn't depend on that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from marlstone.llm.bytewords import mix

WIDTH, MOST = 3, 1 << 19
#: Bytes of text taken at once.
PIECE = 1 << 19
_FILL = np.array([0xFFFFFFFFFFFFFFFF << 8 * n & 0xFFFFFFFFFFFFFFFF for n in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Encodes words: all ids in one array, and how many each word has.
Fresh = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def padded(parts: list[bytes]) -> np.ndarray:
    """The parts, joined, with as much filling behind them as keys() reads."""
    return np.frombuffer(b"".join([*parts, b"\xff" * (8 * WIDTH + 8)]), np.uint8)


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of WIDTH numbers for each word. data: from padded()."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size, out = ends - starts, np.empty((len(starts), WIDTH), np.uint64)
    for j in range(WIDTH):
        at = np.minimum(starts + 8 * j, len(eight) - 1)
        out[:, j] = eight[at] | _FILL[np.clip(size - 8 * j, 0, 8)]
    return out


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first : first + size] of each, one after another."""
    return values[np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


class WordTable:
    def __init__(self, most: int = MOST) -> None:
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.bits = np.uint64(64 - int(2 * self.most - 1).bit_length())
        self.slots = np.full(1 << (64 - int(self.bits)), -1, np.int32)
        self.n = self.used = 0
        self.key, self.first = np.empty((1024, WIDTH), np.uint64), np.empty(1024, np.int64)
        self.size, self.again = np.empty(1024, np.int32), np.zeros(1024, bool)
        self.ids = np.empty(4096, np.uint32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix((key * _ODD).sum(axis=1, dtype=np.uint64)) >> self.bits).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out, left, slot = np.full(len(key), -1, np.int64), np.arange(len(key)), self._slot(key)
        while len(left):
            entry = self.slots[slot]
            full = entry >= 0
            left, slot, entry = left[full], slot[full], entry[full]
            same = (self.key[entry] == key[left]).all(axis=1)
            out[left[same]] = entry[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _room(self, n: int, ids: int) -> None:
        for name, wanted in (("key", n), ("first", n), ("size", n), ("again", n), ("ids", ids)):
            old = getattr(self, name)
            if len(old) < wanted:
                new = np.zeros((max(wanted, 2 * len(old)), *old.shape[1:]), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def add(self, key: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """New, distinct words."""
        if self.n + len(key) > self.most:
            stay = np.flatnonzero(self.again[: self.n])
            stay = stay[: self.most // 2] if self.n else stay
            kept = self.key[stay], self.size[stay], gathered(self.ids, self.first[stay], self.size[stay].astype(np.int64))
            self._empty()
            self._insert(*kept)
            if self.n + len(key) > self.most:
                size = size[: self.most - self.n]
                key, ids = key[: len(size)], ids[: int(size.sum())]
        self._insert(key, size, ids)

    def _insert(self, key: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        n, z = self.n, self.n + len(key)
        self._room(z, self.used + len(ids))
        self.key[n:z], self.size[n:z], self.again[n:z] = key, size, False
        self.first[n:z] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = z, self.used + len(ids)
        left, slot = np.arange(n, z, dtype=np.int32), self._slot(key)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several with one slot the last has it
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fresh: Fresh) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each). fresh encodes the words that the table hasn't."""
        key, short = keys(data, starts, ends), ends - starts <= 8 * WIDTH
        at = np.full(len(starts), -1, np.int64)
        at[short] = self.find(key[short])
        self.again[at[at >= 0]] = True
        first, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        known = at >= 0
        first[known], size[known] = self.first[at[known]], self.size[at[known]]
        pool, offset = [self.ids[: self.used]], self.used
        missing = np.flatnonzero(~known & short)
        if len(missing):
            h = mix((key[missing] * _ODD).sum(axis=1, dtype=np.uint64))
            _, one, which = np.unique(h, return_index=True, return_inverse=True)
            one = missing[one]
            same = (key[missing] == key[one[which]]).all(axis=1)
            ids, n = fresh([data[a:z].tobytes() for a, z in zip(starts[one], ends[one], strict=True)])
            pool.append(ids)
            n = n.astype(np.int64)
            begin = offset + np.cumsum(n) - n
            first[missing[same]], size[missing[same]] = begin[which[same]], n[which[same]]
            offset += len(ids)
            short[missing[~same]] = False  # another word with the same hash
        odd = np.flatnonzero(~known & ~short)
        if len(odd):
            words: dict[bytes, int] = {}
            which = np.array([words.setdefault(data[a:z].tobytes(), len(words)) for a, z in zip(starts[odd], ends[odd], strict=True)])
            more, m = fresh(list(words))
            pool.append(more)
            m = m.astype(np.int64)
            first[odd], size[odd] = (offset + np.cumsum(m) - m)[which], m[which]
        out = gathered(np.concatenate(pool) if len(pool) > 1 else pool[0], first, size)
        if len(missing):
            self.add(key[one], n.astype(np.int32), ids)
        return out, size


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Lists of (text, bytes, whether its beginning) of some `most` bytes. A longer text is cut before single spaces between ASCII letters or digits."""
    held: list[tuple[int, bytes, bool]] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > most:
                end = _cut(text, at + most)
            held.append((k, text[at:end] if at or end < len(text) else text, at == 0))
            size += end - at + 2
            at = end
            if size >= most:
                yield held
                held, size = [], 0
            if at >= len(text):
                break
    if held:
        yield held


def _cut(text: bytes, at: int) -> int:
    plain = lambda c: 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123
    while (at := text.find(b" ", at)) >= 0:
        if 0 < at < len(text) - 1 and plain(text[at - 1]) and plain(text[at + 1]):
            return at
        at += 1
    return len(text)
