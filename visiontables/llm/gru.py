"""A gated recurrent language model in NumPy, with class-factored output."""

from __future__ import annotations

import heapq

import numpy as np

CLASS = 32
#: Tokens to a step, the largest mean gradient, and the steps after which the rate has fallen by the root of two.
STEP, CLIP, SLOWER = 384, 1.0, 400
#: Steps of back-propagation, and steps whose outputs are scored together.
WINDOW = 24
SCORED = 128
LANES = 384
_F = np.float32


def shapes(vocabulary: int, width: int) -> dict[str, tuple[int, ...]]:
    classes = vocabulary // CLASS
    return {"embed": (vocabulary, width), "in": (width, 3 * width), "in_bias": (3 * width,), "state": (width, 3 * width),
            "class": (width, classes), "class_bias": (classes,), "word": (classes, width, CLASS), "word_bias": (classes, CLASS)}


def start(counts: np.ndarray, width: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; output biases that give each symbol its share in ``counts``."""
    rng = np.random.default_rng(seed)
    model = {k: (rng.normal(0, 0.1, s) if not k.endswith("bias") else np.zeros(s)).astype(_F) for k, s in shapes(len(counts), width).items()}
    c = (counts + 0.5).reshape(-1, CLASS).astype(np.float64)
    model["class_bias"] = np.log(c.sum(axis=1) / c.sum()).astype(_F)
    model["word_bias"] = np.log(c / c.sum(axis=1, keepdims=True)).astype(_F)
    return model


def packed(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(v, _F).tobytes() for v in model.values())


def unpacked(data: bytes, vocabulary: int, width: int) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(data, _F), 0, {}
    for k, s in shapes(vocabulary, width).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lanes(first: np.ndarray, most: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Deal texts to lanes of like length, longest first: order of the tokens, and each lane's first (one more at the end)."""
    size = np.diff(first)
    heap = [(0, k) for k in range(min(most, max(1, len(size))))]
    load: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-size, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        load[k].append(i)
        heapq.heappush(heap, (n + int(size[i]), k))
    load.sort(key=lambda x: -sum(int(size[i]) for i in x))
    order = [np.arange(first[i], first[i + 1]) for x in load for i in x]
    edge = np.concatenate([[0], np.cumsum([sum(int(size[i]) for i in x) for x in load])])
    return np.concatenate(order) if order else np.zeros(0, np.int64), edge


class Reader:
    """Runs the model over texts side by side, its state carried from window to window to each text's end."""

    def __init__(self, model: dict[str, np.ndarray], end: int):
        self.model, self.end = model, end
        self.width = model["embed"].shape[1]
        self.grads: dict[str, np.ndarray] | None = None

    def windows(self, tokens: np.ndarray, first: np.ndarray, width: int | None = None):
        """Yield window number, inputs, states before and after each step, gates, and token places; ``tokens`` end each text with ``end``."""
        order, edge = lanes(first)
        stream = tokens[order]
        before = np.full(len(stream), self.end, stream.dtype)
        before[1:] = stream[:-1]
        begin, size = edge[:-1], np.diff(edge)
        h = np.zeros((len(begin), self.width), _F)
        width = width or WINDOW
        for number, t0 in enumerate(range(0, int(size[0]) if len(size) else 0, width)):
            steps = min(width, int(size[0]) - t0)
            live = [int(np.searchsorted(-size, -(t0 + j), side="left")) for j in range(steps)]
            yield number, order, stream, before, begin, t0, live, h
            h = self.state

    def run(self, x: np.ndarray, h: np.ndarray, table: np.ndarray, keep: list | None):
        """One step for all live lanes."""
        w = self.width
        begins = x == self.end
        if begins.any():
            h = np.where(begins[:, None], _F(0), h)
        a = table[x]
        b = h @ self.model["state"]
        zr = _sigmoid(a[:, : 2 * w] + b[:, : 2 * w])
        z, r = zr[:, :w], zr[:, w:]
        n = np.tanh(a[:, 2 * w :] + r * b[:, 2 * w :])
        new = n + z * (h - n)
        if keep is not None:
            keep.append((x, h, z, r, n, b[:, 2 * w :]))
        return new

    def output(self, hidden: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """Natural log-probability of each target; with ``grads``, adds gradients and gives that of ``hidden``."""
        m = self.model
        kind, place = target // CLASS, target % CLASS
        logit = hidden @ m["class"] + m["class_bias"]
        logit -= logit.max(axis=1, keepdims=True)
        e = np.exp(logit)
        total = e.sum(axis=1)
        rows = np.arange(len(target))
        logp = logit[rows, kind] - np.log(total)
        back = None
        if grads is not None:
            d = e / total[:, None]
            d[rows, kind] -= 1
            grads["class"] += hidden.T @ d
            grads["class_bias"] += d.sum(axis=0)
            back = d @ m["class"].T
        order = np.argsort(kind.astype(np.int16), kind="stable")
        cut = np.searchsorted(kind[order], np.arange(m["word"].shape[0] + 1))
        for c in np.flatnonzero(np.diff(cut)):
            k = order[cut[c] : cut[c + 1]]
            logit = hidden[k] @ m["word"][c] + m["word_bias"][c]
            logit -= logit.max(axis=1, keepdims=True)
            e = np.exp(logit)
            total = e.sum(axis=1)
            i = np.arange(len(k))
            logp[k] += logit[i, place[k]] - np.log(total)
            if grads is not None:
                d = e / total[:, None]
                d[i, place[k]] -= 1
                grads["word"][c] += hidden[k].T @ d
                grads["word_bias"][c] += d.sum(axis=0)
                back[k] += d @ m["word"][c].T
        return logp, back

    def table(self) -> np.ndarray:
        return self.model["embed"] @ self.model["in"] + self.model["in_bias"]

    def score(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log-probability of every token."""
        out, table = np.zeros(len(tokens)), self.table()
        for _, order, stream, before, begin, t0, live, h in self.windows(tokens, first, SCORED):
            hidden, at = [], []
            for j, k in enumerate(live):
                h = self.run(before[begin[:k] + t0 + j], h[:k], table, None)
                hidden.append(h)
                at.append(begin[:k] + t0 + j)
            self.state = h
            at = np.concatenate(at)
            out[order[at]] = self.output(np.concatenate(hidden), stream[at])[0]
        return out

    def train(self, tokens: np.ndarray, first: np.ndarray, rate: float, memory: dict) -> None:
        """Gradients of every window; a step of Adam for every ``STEP`` tokens or more.

        Windows of few tokens, as the last ones of long texts are, add up to a
        step instead of making one each. ``memory`` keeps what is not yet
        stepped; ``finish`` takes it.
        """
        table = self.table()
        for _, _, stream, before, begin, t0, live, h in self.windows(tokens, first):
            keep: list = []
            hidden, at = [], []
            for j, k in enumerate(live):
                h = self.run(before[begin[:k] + t0 + j], h[:k], table, keep)
                hidden.append(h)
                at.append(begin[:k] + t0 + j)
            self.state = h
            grads = memory.setdefault("sum", {k: np.zeros_like(v) for k, v in self.model.items()})
            at = np.concatenate(at)
            _, back = self.output(np.concatenate(hidden), stream[at], grads)
            self._back(keep, back, live, grads)
            memory["n"] = memory.get("n", 0) + len(at)
            if memory["n"] >= STEP:
                self._step(rate, memory)
                table = self.table()

    def finish(self, rate: float, memory: dict) -> None:
        """Step for what is left, in proportion, and take the mean of the weights after all steps, by their tokens."""
        if memory.get("n"):
            self._step(rate * min(1.0, memory["n"] / STEP), memory)
        if memory.get("seen"):
            for k in self.model:
                self.model[k] = (memory["mean"][k] / memory["seen"]).astype(_F)

    def _step(self, rate: float, memory: dict) -> None:
        grads, n = memory.pop("sum"), memory.pop("n")
        t = memory["t"] = memory.get("t", 0) + 1
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values())) / n
        scale = _F(min(1.0, CLIP / max(norm, 1e-12)) / n)
        rate = rate / np.sqrt(1 + t / SLOWER)
        mean = memory.setdefault("mean", {k: np.zeros(v.shape, np.float64) for k, v in self.model.items()})
        # early steps are far from where training ends, so steps weigh more the later they are
        weight = float(n) * t
        memory["seen"] = memory.get("seen", 0.0) + weight
        for k, g in grads.items():
            g *= scale
            m = memory.setdefault("m" + k, np.zeros_like(g))
            v = memory.setdefault("v" + k, np.zeros_like(g))
            m += _F(0.1) * (g - m)
            v += _F(0.01) * (g * g - v)
            self.model[k] -= _F(rate) * (m / _F(1 - 0.9**t)) / (np.sqrt(v / _F(1 - 0.99**t)) + _F(1e-6))
            mean[k] += weight * self.model[k]

    def _back(self, keep: list, back: np.ndarray, live: list[int], grads: dict[str, np.ndarray]) -> None:
        w, u = self.width, self.model["state"]
        edge = np.concatenate([[0], np.cumsum(live)])
        dh = np.zeros((0, w), _F)
        xs, ds = [], []
        for j in range(len(live) - 1, -1, -1):
            x, h, z, r, n, bn = keep[j]
            d = back[edge[j] : edge[j + 1]].copy()
            d[: len(dh)] += dh
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * bn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            db = np.concatenate([dz, dr, dn * r], axis=1)
            grads["state"] += h.T @ db
            dh = d * z + db @ u.T
            dh[x == self.end] = 0
            xs.append(x), ds.append(da)
        x, d = np.concatenate(xs), np.concatenate(ds)
        order = np.argsort(x, kind="stable")
        head = np.flatnonzero(np.diff(x[order], prepend=-1))
        by_token = np.add.reduceat(d[order], head, axis=0)
        used = x[order][head]
        grads["in_bias"] += by_token.sum(axis=0)
        grads["in"] += self.model["embed"][used].T @ by_token
        grads["embed"][used] += by_token @ self.model["in"].T
