"""A small gated recurrent language model in numpy, trained by truncated backpropagation.

Documents are packed end to end into parallel streams; the state is carried through a whole document, across windows, and starts at
zero with each document. The next symbol is predicted in two steps: its class, then the symbol within the class.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN = 16
CLASS = 32  # symbols in a class
WINDOW = 20  # steps through which gradients flow
STREAMS = 512
RATE = 0.01

Params = dict[str, np.ndarray]


def start(counts: np.ndarray, seed: int = 7) -> Params:
    """Parameters under which every symbol has its share in ``counts``; the number of symbols must be a multiple of CLASS."""
    rng, s = np.random.default_rng(seed), len(counts)
    share = (counts + 0.5) / (counts + 0.5).sum()
    inner = share.reshape(-1, CLASS)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "a": draw(s, 3 * HIDDEN), "u": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(HIDDEN, np.float32),
        "wc": np.zeros((HIDDEN, s // CLASS), np.float32), "bc": np.log(inner.sum(axis=1)).astype(np.float32),
        "ww": np.zeros((s // CLASS, HIDDEN, CLASS), np.float32), "bw": np.log(inner / inner.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def pack(p: Params) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def unpack(raw: bytes, like: Params) -> Params:
    out, at, flat = {}, 0, np.frombuffer(raw, np.float32)
    for k in sorted(like):
        out[k] = flat[at: at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


class Streams:
    """Documents dealt to streams of similar length, the longest first."""

    def __init__(self, documents: list[np.ndarray], streams: int):
        sizes = np.array([len(d) for d in documents])
        total = int(sizes.sum())
        streams = int(max(1, min(streams, len(documents), total // WINDOW + 1)))
        fill, held = np.zeros(streams, np.int64), [[] for _ in range(streams)]
        heap = [(0, s) for s in range(streams)]
        for d in np.argsort(-sizes, kind="stable"):
            used, s = heapq.heappop(heap)
            held[s].append(d)
            heapq.heappush(heap, (used + int(sizes[d]), s))
        for s, ds in enumerate(held):
            fill[s] = sizes[ds].sum() if ds else 0
        order = np.argsort(-fill, kind="stable")
        self.length, self.n, self.fill = int(fill.max()), streams, fill[order]
        self.symbols = np.zeros((self.length, streams), np.int16)  # short, as they sort faster
        self.fresh = np.zeros((self.length, streams), bool)
        self.owner = np.zeros((self.length, streams), np.int64)
        for s, old in enumerate(order):
            at = 0
            for d in held[old]:
                n = int(sizes[d])
                if n:
                    self.symbols[at: at + n, s], self.fresh[at, s], self.owner[at: at + n, s] = documents[d], True, d
                at += n

    def active(self, t: int) -> int:
        """Number of streams that reach step t; they come first."""
        return int(np.searchsorted(-self.fill, -t, "left"))


def _forward(p: Params, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after every step, and the last."""
    out = np.empty((len(inputs), len(h), HIDDEN), np.float32)
    a, u, b, k = p["a"], p["u"], p["b"], HIDDEN
    for t in range(len(inputs)):
        h = h * ~fresh[t][:, None]
        x = a[inputs[t]]
        hu = h @ u
        gates = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * k] + hu[:, : 2 * k]))
        z, r = gates[:, :k], gates[:, k:]
        hn = hu[:, 2 * k:] + b
        n = np.tanh(x[:, 2 * k:] + r * hn)
        if keep is not None:
            keep.append((h, z, r, n, hn))
        h = n + z * (h - n)
        out[t] = h
    return out, h


def _chosen(x: np.ndarray, at: np.ndarray, slopes: bool) -> np.ndarray:
    """Log of the softmax, down each column, at the row that ``at`` names; with ``slopes``, ``x`` becomes the gradient of its negative.

    A column per word, as numpy reduces and broadcasts long rows faster than short ones.
    """
    column = np.arange(x.shape[1])
    x -= x.max(axis=0)
    score = x[at, column]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if slopes:
        x /= total
        x[at, column] -= 1
    return score - np.log(total)


def _output(p: Params, h: np.ndarray, targets: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each target after its state; with ``grads``, adds the gradients of their negative sum and returns that of the states."""
    order = np.argsort(targets, kind="stable")  # words of one class side by side
    group, inner = np.divmod(targets[order], CLASS)
    states = np.ascontiguousarray(h[order].T)
    x = p["wc"].T @ states + p["bc"][:, None]
    score = _chosen(x, group, grads is not None)
    dh = None
    if grads is not None:
        grads["wc"] += states @ x.T
        grads["bc"] += x.sum(axis=1)
        dh = p["wc"] @ x
    edges = np.searchsorted(group, np.arange(len(p["bw"]) + 1))
    for c, (first, last) in enumerate(zip(edges[:-1], edges[1:])):
        if first < last:
            own = states[:, first:last]
            x = p["ww"][c].T @ own + p["bw"][c][:, None]
            score[first:last] += _chosen(x, inner[first:last], grads is not None)
            if grads is not None:
                grads["ww"][c] += own @ x.T
                grads["bw"][c] += x.sum(axis=1)
                dh[:, first:last] += p["ww"][c] @ x
    placed = np.empty_like(score)
    placed[order] = score
    if grads is None:
        return placed, None
    back = np.empty_like(h)
    back[order] = dh.T
    return placed, back


def windows(streams: Streams, first: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(step, active streams, inputs, targets, fresh) of consecutive windows; the input before a document's first symbol is ``first``."""
    t = 0
    while t < streams.length:
        m = streams.active(t)
        # all of a window's streams reach its end
        end = min(t + WINDOW, int(streams.fill[m - 1]))
        targets, fresh = streams.symbols[t:end, :m], streams.fresh[t:end, :m]
        before = streams.symbols[t - 1: end - 1, :m] if t else np.concatenate((np.zeros((1, m), np.int16), streams.symbols[: end - 1, :m]))
        yield t, m, np.where(fresh, np.int16(first), before), targets, fresh
        t = end


def train(p: Params, documents: list[np.ndarray], first: int, streams: int = STREAMS, rate: float = RATE) -> int:
    """One pass over the documents, updating ``p`` after each window by Adam; returns the number of symbols."""
    documents = [d for d in documents if len(d)]
    if not documents:
        return 0
    dealt = Streams(documents, min(streams, max(8, sum(map(len, documents)) // 4000)))
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    h, step = np.zeros((dealt.n, HIDDEN), np.float32), 0
    for _, m, inputs, targets, fresh in windows(dealt, first):
        g = {k: np.zeros_like(v) for k, v in p.items()}
        keep: list = []
        states, h = _forward(p, inputs, fresh, h[:m], keep)
        flat = states.reshape(-1, HIDDEN)
        _, d = _output(p, flat, targets.ravel(), g)
        d = d.reshape(states.shape)
        back, da, du = np.zeros((m, HIDDEN), np.float32), np.empty((len(inputs), m, 3 * HIDDEN), np.float32), np.empty((len(inputs), m, 3 * HIDDEN), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            hp, z, r, n, hn = keep[t]
            dh = d[t] + back
            dn = dh * (1 - z) * (1 - n * n)
            da[t, :, :HIDDEN] = dh * (hp - n) * z * (1 - z)
            da[t, :, HIDDEN: 2 * HIDDEN] = dn * hn * r * (1 - r)
            da[t, :, 2 * HIDDEN:] = dn
            du[t] = da[t]
            du[t, :, 2 * HIDDEN:] *= r
            back = (dh * z + du[t] @ p["u"].T) * ~fresh[t][:, None]
        flat_du, flat_da = du.reshape(-1, 3 * HIDDEN), da.reshape(-1, 3 * HIDDEN)
        g["u"] += np.concatenate([k[0] for k in keep]).T @ flat_du
        g["b"] += flat_du[:, 2 * HIDDEN:].sum(axis=0)
        order = np.argsort(inputs.ravel(), kind="stable")
        symbol = inputs.ravel()[order]
        edge = np.flatnonzero(np.diff(symbol, prepend=-1))
        g["a"][symbol[edge]] += np.add.reduceat(flat_da[order], edge, axis=0)
        step += 1
        scale = 1 / len(flat)
        for k in p:
            grad = np.clip(g[k] * scale, -0.1, 0.1)
            m1[k] += 0.1 * (grad - m1[k])
            m2[k] += 0.01 * (grad * grad - m2[k])
            p[k] -= (rate / (1 - 0.9**step) * m1[k] / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return sum(map(len, documents))


def score(p: Params, documents: list[np.ndarray], first: int, streams: int = STREAMS) -> np.ndarray:
    """Natural log-probability of every document."""
    out = np.zeros(len(documents))
    if not sum(map(len, documents)):
        return out
    dealt = Streams(documents, streams)
    h = np.zeros((dealt.n, HIDDEN), np.float32)
    for t, m, inputs, targets, fresh in windows(dealt, first):
        states, h = _forward(p, inputs, fresh, h[:m])
        got, _ = _output(p, states.reshape(-1, HIDDEN), targets.ravel())
        np.add.at(out, dealt.owner[t: t + len(inputs), :m].ravel(), got.astype(float))
    return out
