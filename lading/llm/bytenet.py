"""A small convolutional network over bytes, in numpy: training, and fast scoring.

Bytes are embedded; filters of several even widths slide over a window byte by
byte; each filter's largest response (at least 0) over the window is kept;
a softmax layer combines them.  A sample may have several windows, whose
pooled responses are averaged before the softmax.

For scoring, embedding and filters are folded into a table by byte pair, so a
position costs one table row for each two bytes of width and no product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STACK = 2048  # windows of several texts scored together


def windows_of(text: bytes, size: int, step: int) -> np.ndarray:
    """All overlapping windows of a text, covering it wholly; the last is padded with zeros."""
    count = max(1, -(-max(0, len(text) - size) // step) + 1)
    padded = np.zeros((count - 1) * step + size, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (count, size), (step, 1))


def spread(windows: np.ndarray, most: int) -> np.ndarray:
    """`most` windows evenly over the text, some repeated if there are fewer."""
    return windows[np.linspace(0, len(windows) - 1, most).round().astype(int)]


def begin(widths: dict[int, int], classes: int, seed: int, depth: int = 8) -> dict:
    rng = np.random.default_rng(seed)
    net = {"emb": rng.normal(0, 0.5, (256, depth)).astype(np.float32)}
    for width, filters in widths.items():
        scale = 1 / np.sqrt(width * depth)
        net[f"w{width}"] = rng.normal(0, scale, (width * depth, filters)).astype(np.float32)
        net[f"b{width}"] = np.zeros(filters, np.float32)
    total = sum(widths.values())
    net["head"] = rng.normal(0, 0.1, (total, classes)).astype(np.float32)
    net["bias"] = np.zeros(classes, np.float32)
    return net


def _widths(net: dict) -> list[int]:
    return sorted(int(k[1:]) for k in net if k[0] == "w")


def _forward(net: dict, flat: np.ndarray):
    """Pooled responses of windows (n, size), and what the backward pass needs."""
    e = net["emb"][flat]
    pooled, kept = [], []
    for width in _widths(net):
        slides = np.lib.stride_tricks.sliding_window_view(flat, width, axis=1)
        x = e[np.arange(len(flat))[:, None, None], np.arange(slides.shape[1])[:, None] + np.arange(width)]
        x = x.reshape(len(flat), slides.shape[1], -1)
        z = x @ net[f"w{width}"] + net[f"b{width}"]
        top = z.argmax(1)
        best = np.take_along_axis(z, top[:, None], 1)[:, 0]
        pooled.append(np.maximum(best, 0))
        kept.append((width, slides, x, top, best > 0))
    return np.concatenate(pooled, 1), kept


def fit(windows: np.ndarray, y: np.ndarray, widths: dict[int, int], classes: int, seed: int = 11,
        epochs: int = 6, batch: int = 64, rate: float = 0.004) -> dict:
    """Adam on the mean cross entropy; windows (samples, windows, size), y class numbers."""
    net = begin(widths, classes, seed)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(a) for k, a in net.items()} for _ in range(2))
    t = 0
    n, each, size = windows.shape
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(n), max(1, n // batch)):
            flat = windows[at].reshape(-1, size)
            pooled, kept = _forward(net, flat)
            mean = pooled.reshape(len(at), each, -1).mean(1)
            p = softmax(mean @ net["head"] + net["bias"])
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            grad = {"head": mean.T @ p + 1e-4 * net["head"], "bias": p.sum(0), "emb": np.zeros_like(net["emb"])}
            back = np.repeat(p @ net["head"].T / each, each, 0)
            start = 0
            for width, slides, x, top, live in kept:
                filters = top.shape[1]
                d = back[:, start : start + filters] * live
                start += filters
                picked = np.take_along_axis(x, top[:, :, None], 1)  # (n, filters, width * depth)
                grad[f"w{width}"] = np.einsum("nfk,nf->kf", picked, d)
                grad[f"b{width}"] = d.sum(0)
                into = d[:, :, None] * net[f"w{width}"].T  # (n, filters, width * depth)
                where = np.take_along_axis(slides, top[:, :, None], 1)  # bytes under the best place
                np.add.at(grad["emb"], where.reshape(-1), into.reshape(-1, grad["emb"].shape[1]))
            t += 1
            slow = rate * (1 - epoch / epochs * 0.8)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] -= (slow * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def tables(net: dict) -> list[list[np.ndarray]]:
    """For each width, a (65536, filters) response table for each pair of bytes in the filter."""
    emb, out = net["emb"], []
    depth = emb.shape[1]
    for width in _widths(net):
        w = net[f"w{width}"].reshape(width, depth, -1)
        by_byte = [emb @ w[j] for j in range(width)]
        out.append([(by_byte[j][None, :] + by_byte[j + 1][:, None]).reshape(65536, -1) for j in range(0, width, 2)])
        out[-1][0] = out[-1][0] + net[f"b{width}"]
    return out


def pooled(by_pair: list[list[np.ndarray]], windows: np.ndarray, block: int = 512) -> np.ndarray:
    """Largest responses in each window (n, all filters)."""
    parts = []
    for at in range(0, len(windows), block):
        flat = windows[at : at + block].astype(np.uint16)
        pairs = flat[:, :-1] | flat[:, 1:] << 8  # first byte is the low one
        best = []
        for own in by_pair:
            places = flat.shape[1] - 2 * len(own) + 1
            z = own[0][pairs[:, :places]]
            for j, rows in enumerate(own[1:], 1):
                z += rows[pairs[:, 2 * j : 2 * j + places]]
            best.append(np.maximum(z.max(1), 0))
        parts.append(np.concatenate(best, 1))
    return np.concatenate(parts)


def responses(by_pair: list[list[np.ndarray]], texts: list[bytes], size: int, step: int) -> Iterator[np.ndarray]:
    """Pooled responses of each text's windows; those of many texts are computed together."""
    waiting, held = [], 0
    for i, text in enumerate(texts, 1):
        waiting.append(windows_of(text, size, step))
        held += len(waiting[-1])
        if held >= STACK or i == len(texts):
            found = pooled(by_pair, np.concatenate(waiting))
            yield from np.split(found, np.cumsum([len(w) for w in waiting])[:-1])
            waiting, held = [], 0
