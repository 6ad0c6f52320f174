"""Words of many texts at once, in numpy: where they lie, and a 64-bit hash of each.

Texts are joined to one array of UTF-8 bytes, A-Z lowered, and cut at ASCII white space. A word's hash is the sum of a random 64-bit value per
byte times a power of an odd base, taken from one running sum over all bytes; it depends on the word alone. Pieces of at most CHUNK bytes are
cut between words, so memory is bounded for texts of any length (a single longer word is a piece by itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
_RANDOM = np.random.default_rng(20240307)
TABLE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK + 4096)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


_powers = _Powers()


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]: equal bytes have equal hashes, wherever they lie."""
    up, down = _powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) byte of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text of each byte's word start): texts joined by a space, in pieces of about CHUNK bytes cut between words."""
    held, ids, size = [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b" ".join(held), np.uint8), np.repeat(np.array(ids), [len(x) + 1 for x in held])

    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or (at == 0 and not text):
            end = len(text)
            if end - at > CHUNK:
                end = next((i for i in range(at + CHUNK, len(text)) if SPACE[text[i]]), len(text))
            part = text[at:end] if at or end < len(text) else text
            held.append(part)
            ids.append(k)
            size += len(part) + 1
            at = end
            if size >= CHUNK:
                yield flush()
                held, ids, size = [], [], 0
            if not text:
                break
    if held:
        yield flush()


def words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, word starts, word ends, text index of each word, hash of each word) per piece; texts stay in order."""
    for data, owner in pieces([encoded(t) for t in texts]):
        starts, ends = spans(data)
        yield data, starts, ends, owner[starts], range_hashes(data, starts, ends)
