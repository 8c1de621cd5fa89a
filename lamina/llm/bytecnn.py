"""A small byte-level convolutional network in numpy.

Bytes are mapped to 64 classes. Filters of widths 2, 3 and 4 slide over fixed-length windows, each
filter keeps its largest response in a window, and a dense layer makes the outputs. For scoring,
the filters are tabulated: a filter's response depends on 2, 3 or 4 classes, so one or two table
rows per position give the responses of all filters of a width, exactly.
"""

from __future__ import annotations

import numpy as np

CLASSES = 64
WIDTHS = (2, 3, 4)
#: Windows scored together.
BLOCK = 2048


def letter_classes() -> np.ndarray:
    """Byte classes for languages: letters without case, and the parts of two-byte characters."""
    out = np.full(257, 29, np.uint8)
    for k in range(26):
        out[97 + k] = out[65 + k] = 1 + k
    out[48:58] = 27
    out[[9, 10, 11, 12, 13, 32]] = 28
    out[0xC3], out[0xC4:0x100] = 30, 31
    out[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    out[256] = 0  # padding
    return out


def shape_classes() -> np.ndarray:
    """Byte classes for quality: lower-case letters, one class of capitals, every ASCII symbol."""
    out = np.full(257, 31, np.uint8)
    for k in range(26):
        out[97 + k], out[65 + k] = 1 + k, 27
    out[48:58] = 28
    out[:33] = 29
    out[10] = 30
    symbols = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
    out[symbols] = 32 + np.arange(len(symbols))
    out[256] = 0
    return out


def windows(offsets: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows over texts at ``offsets``: the text, the first byte, and the text's end. They cover every byte; a text has one at least."""
    sizes = np.diff(offsets)
    n = 1 + np.maximum(0, -(-(sizes - length) // stride))
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, offsets[text] + k * stride, offsets[text + 1]


class Net:
    """Filters, and a dense layer over what they find. ``outputs`` of 1 is a logistic output."""

    def __init__(self, classes: np.ndarray, outputs: int, filters: int = 16, length: int = 256, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.classes, self.outputs, self.length, self.filters = classes, outputs, length, filters
        self.conv = [rng.normal(0, 0.3, (w, CLASSES, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(filters * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.2, (filters * len(WIDTHS), outputs)).astype(np.float32)
        self.out = np.zeros(outputs, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.conv, self.bias, self.dense, self.out]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses and their places, for class windows x (windows, length)."""
        best, at = [], []
        for w, weights in zip(WIDTHS, self.conv, strict=True):
            n = x.shape[1] - w + 1
            z = weights[0][x[:, :n]]
            for k in range(1, w):
                z = z + weights[k][x[:, k : k + n]]
            p = z.argmax(1)
            at.append(p)
            best.append(np.take_along_axis(z, p[:, None], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(at, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 900, batch: int = 96, rate: float = 0.01, seed: int = 11) -> Net:
        """Adam on the cross entropy. x: bytes (windows, length) with 256 as padding; y: class numbers (or 0 and 1)."""
        rng = np.random.default_rng(seed)
        x = self.classes[x]
        weight = np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32)
        params = self.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            take = rng.integers(0, len(x), batch)
            xb, yb, wb = x[take], y[take], weight[take]
            z, at = self._pooled(xb)
            z = z + self.bias
            h = np.maximum(z, 0)
            logit = h @ self.dense + self.out
            if self.outputs == 1:
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - yb[:, None]).astype(np.float32)
            else:
                d = np.exp(logit - logit.max(1, keepdims=True))
                d /= d.sum(1, keepdims=True)
                d[np.arange(batch), yb] -= 1
            d *= wb[:, None] / batch
            back = (d @ self.dense.T) * (z > 0)
            grads = []
            rows, F = np.repeat(np.arange(batch), self.filters), self.filters
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(self.conv[k])
                part, place = back[:, k * F : (k + 1) * F].ravel(), at[:, k * F : (k + 1) * F].ravel()
                col = np.tile(np.arange(F), batch)
                for j in range(w):
                    np.add.at(g[j], (xb[rows, place + j], col), part)
                grads.append(g)
            grads += [back.sum(0), h.T @ d, d.sum(0)]
            step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
                p *= 1 - 1e-5
        return self

    def compiled(self) -> Net:
        """The tables are made once for each process; they aren't sent with the network."""
        if not hasattr(self, "_tables"):
            two, three, four = self.conv
            self._tables = (
                (two[0][:, None] + two[1][None]).reshape(-1, self.filters),
                (three[0][:, None, None] + three[1][None, :, None] + three[2][None, None]).reshape(-1, self.filters),
                (four[0][:, None] + four[1][None]).reshape(-1, self.filters),
                (four[2][:, None] + four[3][None]).reshape(-1, self.filters),
            )
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def logits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Outputs for windows of ``length`` bytes from ``start`` (nothing at and after ``end`` counts)."""
        self.compiled()
        t2, t3, t4, t4b = self._tables
        padded = np.append(self.classes[data], self.classes[256]).astype(np.int32)
        found = np.empty((len(start), self.filters * len(WIDTHS)), np.float32)
        F = self.filters
        for a in range(0, len(start), BLOCK):
            s, e = start[a : a + BLOCK], end[a : a + BLOCK]
            at = np.arange(self.length)[:, None] + s
            x = padded[np.where(at < e, at, len(data))]
            pair = x[:-1] * CLASSES + x[1:]
            acc = np.full((3, len(s), F), -np.inf, np.float32)
            one, two = np.empty((len(s), F), np.float32), np.empty((len(s), F), np.float32)
            triple = pair[:-1] * CLASSES + x[2:]
            for p in range(self.length - 1):
                np.maximum(acc[0], t2.take(pair[p], 0, one, "clip"), out=acc[0])
                if p < self.length - 2:
                    np.maximum(acc[1], t3.take(triple[p], 0, one, "clip"), out=acc[1])
                if p < self.length - 3:
                    t4.take(pair[p], 0, one, "clip")
                    one += t4b.take(pair[p + 2], 0, two, "clip")
                    np.maximum(acc[2], one, out=acc[2])
            found[a : a + BLOCK] = acc.transpose(1, 0, 2).reshape(len(s), -1)
        return np.maximum(found + self.bias, 0) @ self.dense + self.out


def padded(rows: list[bytes], length: int) -> np.ndarray:
    """Windows as an array of byte numbers with 256 as padding."""
    out = np.full((len(rows), length), 256, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = np.frombuffer(r, np.uint8)
    return out
