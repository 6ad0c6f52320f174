"""A gated recurrent language model in numpy with a class-factored output softmax.

A token id below HEAD is a word of its own (0: the end of a text), the others stand for the rest of the vocabulary, one per shape of word.
The head's words are in classes of CLASS_SIZE by frequency; each shape is a class too. P(token) = P(class | state) * P(word | class, state);
within a shape, words have their smoothed corpus frequency, which the caller adds.

Texts are laid end to end on lanes; the state starts anew at each text and is carried from window to window, so a text's log-likelihood is
that of the complete text. Training goes back WINDOW steps (truncated backpropagation) and updates by Adam after each window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HEAD, CLASS_SIZE, SHAPES = 1024, 32, 8
CLASSES = HEAD // CLASS_SIZE
HIDDEN, LANES, WINDOW = 16, 256, 32
SHAPE_OF = {"X": (HEAD + SHAPES, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "C": (HIDDEN, CLASSES + SHAPES), "c": (CLASSES + SHAPES,), "W": (CLASSES, HIDDEN, CLASS_SIZE), "w": (CLASSES, CLASS_SIZE)}


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters whose output is the corpus frequency of each id, whatever the state."""
    r = np.random.default_rng(7)
    n = counts.astype(np.float64) + 0.5
    by_class = np.concatenate([n[:HEAD].reshape(CLASSES, CLASS_SIZE).sum(axis=1), n[HEAD:]])
    p = {k: np.zeros(s, np.float32) for k, s in SHAPE_OF.items()}
    p["X"][:] = r.normal(0, 0.4, SHAPE_OF["X"])
    p["X"][:, :HIDDEN] += 1.5  # the state is kept at first
    p["U"][:] = r.normal(0, HIDDEN**-0.5, SHAPE_OF["U"])
    p["c"][:] = np.log(by_class / by_class.sum())
    p["w"][:] = np.log(n[:HEAD]).reshape(CLASSES, CLASS_SIZE)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPE_OF])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPE_OF.items():
        n = int(np.prod(s))
        out[k], at = np.ascontiguousarray(v[at : at + n], dtype=np.float32).reshape(s), at + n
    return out


def lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts in lane order, first token of each lane in that order, tokens of each lane), the longest lane first. Within a lane, texts
    of all lengths are mixed: else training would end on short ones."""
    n = min(LANES, len(lengths))
    heap = [(0, k) for k in range(n)]
    member: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-lengths, kind="stable"):
        size, k = heapq.heappop(heap)
        member[k].append(int(d))
        heapq.heappush(heap, (size + int(lengths[d]), k))
    total = np.array([lengths[m].sum() for m in member])
    order = np.argsort(-total, kind="stable")
    mixed = np.random.default_rng(11)
    return np.concatenate([mixed.permutation(member[k]) for k in order]), np.concatenate([[0], np.cumsum(total[order])[:-1]]), total[order]


class Network:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01) -> None:
        self.p, self.rate, self.steps = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def _forward(self, inp: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple:
        """States after each step, and what the way back needs."""
        n, U = inp.shape[0], self.p["U"]
        x = self.p["X"][inp]
        before, after = np.empty((n, *h.shape), np.float32), np.empty((n, *h.shape), np.float32)
        gates, rec = np.empty((n, h.shape[0], 2 * HIDDEN), np.float32), np.empty((n, *h.shape), np.float32)
        new = np.empty_like(after)
        for t in range(n):
            h = np.multiply(h, keep[t], out=before[t])
            hu = h @ U
            g = gates[t]
            np.add(x[t, :, : 2 * HIDDEN], hu[:, : 2 * HIDDEN], out=g)
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            rec[t] = hu[:, 2 * HIDDEN :]
            c = new[t]
            np.multiply(g[:, HIDDEN:], rec[t], out=c)
            c += x[t, :, 2 * HIDDEN :]
            np.tanh(c, out=c)
            a = after[t]
            np.subtract(h, c, out=a)
            a *= g[:, :HIDDEN]
            a += c
            h = a
        return after, before, gates, rec, new

    def _output(self, h: np.ndarray, target: np.ndarray, learn: bool) -> tuple:
        """Log-probability of each target id; with learn also the gradient at h, and those of the output's parameters."""
        p = self.p
        head = target < HEAD
        cls = np.where(head, target // CLASS_SIZE, target - HEAD + CLASSES)
        rows = np.arange(len(h))
        z = h @ p["C"]
        z += p["c"]
        z -= z.max(axis=1, keepdims=True)
        picked = z[rows, cls]
        np.exp(z, out=z)
        total = z.sum(axis=1)
        lp = picked - np.log(total)
        g: dict = {}
        dh = None
        if learn:
            z /= total[:, None]
            z[rows, cls] -= 1
            dh = z @ p["C"].T
            g = {"C": h.T @ z, "c": z.sum(axis=0), "W": np.zeros_like(p["W"]), "w": np.zeros_like(p["w"])}
        at = np.flatnonzero(head)
        at = at[np.argsort(cls[at].astype(np.uint8), kind="stable")]
        edges = np.searchsorted(cls[at], np.arange(CLASSES + 1))
        hs, ts = h[at], target[at] % CLASS_SIZE
        lps = np.empty(len(at), np.float32)
        dhs = np.empty_like(hs) if learn else None
        for k in range(CLASSES):
            a, b = edges[k], edges[k + 1]
            if a == b:
                continue
            x, y = hs[a:b], ts[a:b]
            z = x @ p["W"][k]
            z += p["w"][k]
            z -= z.max(axis=1, keepdims=True)
            r = rows[: b - a]
            picked = z[r, y]
            np.exp(z, out=z)
            total = z.sum(axis=1)
            lps[a:b] = picked - np.log(total)
            if learn:
                z /= total[:, None]
                z[r, y] -= 1
                np.matmul(z, p["W"][k].T, out=dhs[a:b])
                g["W"][k], g["w"][k] = x.T @ z, z.sum(axis=0)
        lp[at] += lps
        if learn:
            dh[at] += dhs
        return lp, dh, g

    def _backward(self, dout: np.ndarray, inp: np.ndarray, keep: np.ndarray, after: tuple) -> dict[str, np.ndarray]:
        _, before, gates, rec, new = after
        n, lanes_, H = dout.shape
        U_t = np.ascontiguousarray(self.p["U"].T)
        dx, dhu = np.empty((n, lanes_, 3 * H), np.float32), np.empty((n, lanes_, 3 * H), np.float32)
        carry = np.zeros((lanes_, H), np.float32)
        for t in range(n - 1, -1, -1):
            d = dout[t] + carry
            z, r, c = gates[t, :, :H], gates[t, :, H:], new[t]
            keepz = d * z
            dn = (d - keepz) * (1 - c * c)
            dx[t, :, 2 * H :] = dn
            dx[t, :, :H] = keepz * (1 - z) * (before[t] - c)
            dhu[t, :, 2 * H :] = dn * r
            dx[t, :, H : 2 * H] = dn * rec[t] * r * (1 - r)
            dhu[t, :, : 2 * H] = dx[t, :, : 2 * H]
            carry = dhu[t] @ U_t
            carry += keepz
            carry *= keep[t]
        flat_in = inp.ravel()
        order = np.argsort(flat_in.astype(np.uint16), kind="stable")
        ids = flat_in[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        gx = np.zeros_like(self.p["X"])
        gx[ids[first]] = np.add.reduceat(dx.reshape(-1, 3 * H)[order], first, axis=0)
        return {"X": gx, "U": before.reshape(-1, H).T @ dhu.reshape(-1, 3 * H)}

    def _update(self, grads: dict[str, np.ndarray], n: int) -> None:
        """n: tokens of a whole window, so that windows with few live lanes change little."""
        self.steps += 1
        scale = self.rate * (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        for k, g in grads.items():
            g = np.clip(g / np.float32(n), -1, 1)
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            self.p[k] -= np.float32(scale) * m / (np.sqrt(v) + np.float32(1e-8))

    def run(self, ids: np.ndarray, lengths: np.ndarray, learn: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in ids, natural log-probabilities) window by window. ids: texts of `lengths` ids each, the end id included."""
        order, first, size = lanes(lengths)
        text_at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ordered = lengths[order]
        stream_at = np.repeat(text_at[order] - np.concatenate([[0], np.cumsum(ordered)[:-1]]), ordered) + np.arange(len(ids))
        stream = ids[stream_at]
        fresh = np.zeros(len(ids), bool)
        fresh[np.concatenate([[0], np.cumsum(ordered)[:-1]])] = True
        prev = np.concatenate([[0], stream[:-1]])
        prev[fresh] = 0
        h = np.zeros((len(first), HIDDEN), np.float32)
        for t0 in range(0, int(size[0]), WINDOW):
            live = int(np.searchsorted(-size, -t0, side="left"))
            steps = t0 + np.arange(min(WINDOW, int(size[0]) - t0))
            at = np.minimum(steps[:, None], size[None, :live] - 1) + first[None, :live]
            valid = steps[:, None] < size[None, :live]
            inp, keep = prev[at], (~fresh[at]).astype(np.float32)[:, :, None]
            state = self._forward(inp, keep, h[:live])
            h = state[0][-1]
            every = bool(valid.all())
            hs = state[0].reshape(-1, HIDDEN)
            target, place = stream[at].ravel(), stream_at[at].ravel()
            if not every:
                v = valid.ravel()
                hs, target, place = hs[v], target[v], place[v]
            lp, dh, grads = self._output(hs, target, learn)
            if learn:
                if not every:
                    full = np.zeros((valid.size, HIDDEN), np.float32)
                    full[v] = dh
                    dh = full
                grads |= self._backward(dh.reshape(state[0].shape), inp, keep, state)
                self._update(grads, at.shape[0] * len(first))
            yield place, lp
