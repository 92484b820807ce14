"""A small gated recurrent language model in numpy, with a class-factored softmax.

Symbols are ranked by frequency; ``SIZE`` consecutive ranks form a class, and
p(symbol) = p(class) p(symbol | class). The input layer is a table of the
gates' input terms per symbol. The state runs through a whole document, in
windows of steps; gradients stop at the window's start.
"""

from __future__ import annotations

import numpy as np

SIZE = 32  # symbols of a class
_F = np.float32


def start(counts: np.ndarray, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights whose biases give the symbols' relative frequencies; ``counts`` are in rank order."""
    rng = np.random.default_rng(seed)
    classes = -(-len(counts) // SIZE)
    mass = np.full(classes * SIZE, 1e-6)
    mass[:len(counts)] = counts + 1.0
    mass = mass.reshape(classes, SIZE)
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(_F)
    return {"table": small(classes * SIZE, 3 * hidden), "state": small(hidden, 3 * hidden), "to_class": small(hidden, classes),
            "class_bias": np.log(mass.sum(1)).astype(_F) - _F(np.log(mass.sum())), "to_member": small(classes, hidden, SIZE),
            "member_bias": np.log(mass / mass.sum(1, keepdims=True)).astype(_F)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


def run(w: dict, inputs: np.ndarray, h: np.ndarray, keep: bool = False, end: int = -1):
    """States after each step of ``inputs`` (steps x rows), and what the gradients need if ``keep``.

    The input ``end`` begins a document, so the state before it is cleared.
    """
    n = h.shape[1]
    states = np.empty((len(inputs), *h.shape), _F)
    kept = []
    for t, x in enumerate(inputs):
        if end >= 0 and (x == end).any():
            h = np.where((x == end)[:, None], _F(0), h)
        g = w["table"][x]
        a = h @ w["state"]
        zr = _sigmoid(g[:, :2 * n] + a[:, :2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(g[:, 2 * n:] + r * a[:, 2 * n:])
        states[t] = h + z * (c - h)
        if keep:
            kept.append((h, z, r, c, a[:, 2 * n:]))
        h = states[t]
    return states, kept


def _softmax(h: np.ndarray, weight: np.ndarray, bias: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln p of the targets, and the numerators and denominators of all probabilities.

    States are within -1 and 1, so logits stay small; they are held to 60.
    """
    x = h @ weight
    x += bias
    np.minimum(x, _F(60), out=x)
    value = x[np.arange(len(target)), target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], _F)
    return value - np.log(total), x, total


def log_probabilities(w: dict, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln p of each target from its state; with ``grads``, adds the weights' gradients and returns those of the states."""
    kind = (target // SIZE).astype(np.int16)
    member = target % SIZE
    order = np.argsort(kind, kind="stable")
    kind, member, h = kind[order], member[order], h[order]
    value, d, total = _softmax(h, w["to_class"], w["class_bias"], kind)
    back = np.zeros_like(h)
    if grads is not None:
        d /= total[:, None]
        d[np.arange(len(kind)), kind] -= 1
        grads["to_class"] += h.T @ d
        grads["class_bias"] += d.sum(0)
        back = d @ w["to_class"].T
    edges = np.searchsorted(kind, np.arange(len(w["to_member"]) + 1))
    for k in np.flatnonzero(np.diff(edges)):
        own = slice(edges[k], edges[k + 1])
        v, d, total = _softmax(h[own], w["to_member"][k], w["member_bias"][k], member[own])
        value[own] += v
        if grads is not None:
            d /= total[:, None]
            d[np.arange(len(v)), member[own]] -= 1
            grads["to_member"][k] += h[own].T @ d
            grads["member_bias"][k] += d.sum(0)
            back[own] += d @ w["to_member"][k].T
    again = np.empty_like(order)
    again[order] = np.arange(len(order))
    return value[again], back[again] if grads is not None else None


class Documents:
    """Symbol sequences of documents, each closed by ``end``, in groups of like length."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, end: int, rows: int):
        n = len(bounds) - 1
        self.length = np.diff(bounds) + 1
        self.start = bounds[:-1] + np.arange(n)
        self.target = np.full(len(symbols) + n, end, np.int32)
        place = np.arange(len(symbols)) + np.repeat(np.arange(n), np.diff(bounds))
        self.target[place] = symbols
        self.input = np.empty_like(self.target)
        self.input[1:] = self.target[:-1]
        self.input[self.start] = end
        order = np.argsort(-self.length, kind="stable")
        self.groups = [order[i:i + rows] for i in range(0, n, rows)]

    def streams(self, most: int, steps: int):
        """(inputs, targets, validity) of windows over all documents laid end to end in up to ``most`` rows of equal length."""
        n = len(self.target)
        rows = int(np.clip(n // (64 * steps), min(16, n), most))
        length = -(-n // rows)
        first = np.arange(rows) * length
        for t in range(0, length, steps):
            at = t + np.arange(min(steps, length - t))
            place = first[None, :] + at[:, None]
            yield self.input[np.minimum(place, n - 1)], self.target[np.minimum(place, n - 1)], place < n

    def windows(self, group: np.ndarray, steps: int):
        """(rows still running, inputs, targets, validity) of each window; arrays are steps x rows."""
        length, start = self.length[group], self.start[group]
        for t in range(0, int(length[0]), steps):
            rows = int(np.searchsorted(-length, -t, "left"))
            at = t + np.arange(min(steps, int(length[0]) - t))
            valid = at[:, None] < length[None, :rows]
            place = np.minimum(start[None, :rows] + at[:, None], len(self.target) - 1)
            yield rows, self.input[place], self.target[place], valid


def score(w: dict, docs: Documents, steps: int = 64) -> np.ndarray:
    """ln p of each document."""
    total = np.zeros(len(docs.length))
    hidden = w["state"].shape[0]
    for group in docs.groups:
        h = np.zeros((len(group), hidden), _F)
        for rows, inputs, targets, valid in docs.windows(group, steps):
            states, _ = run(w, inputs, h[:rows])
            h = states[-1]
            value, _ = log_probabilities(w, states[valid], targets[valid])
            total[group[:rows]] += np.bincount(np.nonzero(valid)[1], value, rows)
    return total


class Trainer:
    """Adam steps of truncated backpropagation."""

    def __init__(self, w: dict, rate: float, steps: int = 16):
        self.w, self.rate, self.steps, self.t, self.seen = w, rate, steps, 0, 0
        self.mean = {k: np.zeros_like(v) for k, v in w.items()}
        self.square = {k: np.zeros_like(v) for k, v in w.items()}

    def learn(self, docs: Documents, end: int, rows: int) -> None:
        """One pass; the state is carried from window to window and cleared where a document begins."""
        h = None
        for inputs, targets, valid in docs.streams(rows, self.steps):
            h = np.zeros((inputs.shape[1], self.w["state"].shape[0]), _F) if h is None else h
            h = self._window(inputs, targets, valid, h, end)

    def _window(self, inputs, targets, valid, h, end):
        w, n = self.w, h.shape[1]
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        states, kept = run(w, inputs, h, keep=True, end=end)
        back = np.zeros_like(states)
        _, d = log_probabilities(w, states[valid], targets[valid], grads)
        back[valid] = d
        da, dg = np.empty((*states.shape[:2], 3 * n), _F), np.empty((*states.shape[:2], 3 * n), _F)
        carry = np.zeros_like(h)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, c, ac = kept[t]
            dh = back[t] + carry
            dc = dh * z * (1 - c * c)
            dz = dh * (c - before) * z * (1 - z)
            dr = dc * ac * r * (1 - r)
            dg[t, :, :n], dg[t, :, n:2 * n], dg[t, :, 2 * n:] = dz, dr, dc
            da[t, :, :n], da[t, :, n:2 * n], da[t, :, 2 * n:] = dz, dr, dc * r
            carry = dh * (1 - z) + da[t] @ w["state"].T
            carry[inputs[t] == end] = 0
        first = np.stack([k[0] for k in kept])
        grads["state"] = first.reshape(-1, n).T @ da.reshape(-1, 3 * n)
        flat = inputs.ravel()
        order = np.argsort(flat, kind="stable")
        symbols, cut = np.unique(flat[order], return_index=True)
        grads["table"][symbols] = np.add.reduceat(dg.reshape(-1, 3 * n)[order], cut, axis=0)
        self._update(grads, max(1, int(valid.sum())))
        self.seen += int(valid.sum())
        return states[-1]

    def _update(self, grads, count):
        self.t += 1
        step = self.rate * min(1.0, self.t / 20) * np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / count
        scale = _F(min(1.0, 1.0 / max(norm, 1e-12)) / count)
        for k, g in grads.items():
            g *= scale
            self.mean[k] += _F(0.1) * (g - self.mean[k])
            self.square[k] += _F(0.01) * (g * g - self.square[k])
            self.w[k] -= _F(step) * self.mean[k] / (np.sqrt(self.square[k]) + _F(1e-6))
