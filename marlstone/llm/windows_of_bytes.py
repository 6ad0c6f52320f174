"""Windows of LENGTH bytes, told apart by content-defined anchors, in numpy.

A window's anchor is the GRAM bytes inside it that have the least hash, the leftmost of equal ones: a function of the window's bytes alone.
Windows that follow each other mostly share an anchor, so a text of n bytes has about 2 n / (LENGTH - GRAM + 2) runs of windows; equal windows
lie at the same place beside equal anchors. Positions are taken in blocks, so memory is bounded for texts of any length.
"""

from __future__ import annotations

import numpy as np

from marlstone.llm.bytewords import range_hashes

LENGTH, GRAM = 200, 64
BLOCK = 1 << 20
_POS = np.uint64((1 << 24) - 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: prefix and suffix minima of blocks of that width."""
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor's place in the run, first window, number of windows) of each run of windows with one anchor."""
    out: list[tuple] = []
    width = length - gram + 1
    for b in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[b : b + BLOCK + length - 1]
        at = np.arange(len(part) - gram + 1)
        h = range_hashes(part, at, at + gram)
        anchor = (_sliding_least((h & ~_POS) | at.astype(np.uint64), width) & _POS).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        n = np.diff(np.r_[first, len(anchor)])
        q = anchor[first]
        out.append((h[q], q - first, first + b, n))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows that start at `at` have their bytes in common with another of their group.

    Most-significant-digit passes over eight bytes at a time: a pass splits each group by the next digit, and groups of one are done. The last
    eight bytes are the second digit: they tell windows apart that share a beginning. Groups that agree in a digit stay as they are."""
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    twice = np.zeros(len(at), bool)
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
    for digit in (0, length - 8, *range(8, length - 8, 8)):
        size = np.diff(np.r_[edge, len(order)])
        live = np.repeat(size > 1, size)
        order, size = order[live], size[size > 1]
        if not len(order):
            return twice
        edge = np.cumsum(size) - size
        value = eight[at[order] + digit].astype(np.uint64)
        differ = np.logical_or.reduceat(value != np.repeat(value[edge], size), edge)
        if differ.any():
            own = np.repeat(np.arange(len(size)), size)
            some = np.flatnonzero(differ[own])
            put = some[np.lexsort((value[some], own[some]))]
            order[some], value[some] = order[put], value[put]
            edge = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (value[1:] != value[:-1])])
    size = np.diff(np.r_[edge, len(order)])
    twice[order[np.repeat(size > 1, size)]] = True
    return twice


def union(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [a, z) of the union of spans [first, last)."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    a, z = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, a[1:] > z[:-1]]
    return a[new], z[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]]


def kept(data: bytes, first: np.ndarray, last: np.ndarray) -> bytes:
    """What lies outside the spans, which don't touch."""
    edges = np.concatenate([[0], np.stack([first, last], axis=1).ravel(), [len(data)]]).astype(np.int64)
    return b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
