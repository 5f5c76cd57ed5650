"""A convolutional text classifier over hashed words and word beginnings, in numpy.

A word is given as a few feature numbers (itself, its beginnings); its embedding is the sum of theirs, and feature 0 is
none. Filters of several widths slide over the words; each gives its largest value over the text (max pooling), rectified,
to a logistic output. Texts shorter than a filter are padded with zeros. Trained by backpropagation.

Texts are laid out one after the other, each followed by padding, so that many are worked on at once and no window
reaches from one text into the next.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]
WIDTHS = (1, 2, 3)


def init(features: int, size: int, filters: int, seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    out: Params = {"e": rng.normal(size=(features, size)) * 0.1}
    out["e"][0] = 0
    for w in WIDTHS:
        out[f"k{w}"] = rng.normal(size=(w, size, filters)) / np.sqrt(w * size)
        out[f"c{w}"] = np.zeros(filters)
    out["v"] = rng.normal(size=len(WIDTHS) * filters) * 0.3
    out["b"] = np.zeros(1)
    return {k: x.astype(np.float32) for k, x in out.items()}


def _layout(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of every word, start of every text, total) when each text is followed by padding."""
    counts = np.diff(first)
    starts = np.concatenate(([0], np.cumsum(np.maximum(counts, 1) + max(WIDTHS) - 1)))
    return np.arange(first[-1]) + np.repeat(starts[:-1] - first[:-1], counts), starts, int(starts[-1])


def _bounds(starts: np.ndarray, counts: np.ndarray, w: int) -> np.ndarray:
    """The end of the windows of each text: those inside it, or the first one where it is shorter than the filter."""
    return starts[:-1] + np.maximum(counts - w + 1, 1)


def gradients(p: Params, words: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, Params]:
    """Weighted logistic loss of texts words[first[i]:first[i + 1]] (rows of feature numbers), and its gradients."""
    place, starts, total = _layout(first)
    counts = np.diff(first)
    features = np.zeros((total, words.shape[1]), np.int64)
    features[place] = words
    x = p["e"][features].sum(1)
    filters = len(p["c1"])
    chosen, pooled = [], []
    for w in WIDTHS:
        size = total - w + 1
        score = sum(x[j : j + size] @ p[f"k{w}"][j] for j in range(w))
        best = np.stack([a + score[a:b].argmax(0) for a, b in zip(starts, _bounds(starts, counts, w))])
        chosen.append(best)
        pooled.append(score[best, np.arange(filters)] + p[f"c{w}"])
    value = np.concatenate(pooled, 1)
    z = np.maximum(value, 0) @ p["v"] + p["b"][0]
    loss = float((weights * (np.logaddexp(0, z) - labels * z)).sum())
    d = weights * (1 / (1 + np.exp(-z)) - labels)
    grad: Params = {"v": d @ np.maximum(value, 0), "b": d.sum(keepdims=True)}
    dv = np.where(value > 0, d[:, None] * p["v"], 0)
    gx = np.zeros_like(x)
    for i, w in enumerate(WIDTHS):
        own, best, kernel = dv[:, i * filters : (i + 1) * filters], chosen[i], p[f"k{w}"]
        grad[f"c{w}"] = own.sum(0)
        grad[f"k{w}"] = np.stack([np.einsum("ifs,if->sf", x[best + j], own, optimize=True) for j in range(w)])
        for j in range(w):
            np.add.at(gx, best + j, own[:, :, None] * kernel[j].T)
    grad["e"] = np.zeros_like(p["e"])
    moved = np.flatnonzero(np.abs(gx).sum(1))
    np.add.at(grad["e"], features[moved], gx[moved][:, None, :])
    grad["e"][0] = 0
    return loss, grad


def trained(texts: list[np.ndarray], labels: np.ndarray, features: int, size: int, filters: int, epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Params:
    """Fit to texts, each an array of (words, features of a word)."""
    p = init(features, size, filters, seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    rng = np.random.default_rng(seed)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weight = 0.5 / np.maximum(share, 1e-9)  # both labels count the same
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            bounds = np.concatenate(([0], np.cumsum([len(texts[k]) for k in own])))
            _, grad = gradients(p, np.concatenate([texts[k] for k in own]), bounds, labels[own], weight[labels[own]] / len(own))
            step += 1
            now = rate * max(0.05, 1 - step / total)
            for k, g in grad.items():
                if k == "e":  # only rows that were touched move
                    rows = np.flatnonzero(np.abs(g).sum(1))
                    second[k][rows] += g[rows] ** 2
                    p[k][rows] -= 5 * now * g[rows] / (np.sqrt(second[k][rows]) + 1e-6)
                    continue
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def logits(p: Params, distinct: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores of the texts words[first[i]:first[i + 1]], whose words are rows of `distinct` (rows of feature numbers).

    A filter is a sum of one product per word, so these are worked out once per distinct word, and a convolution is a
    sum of table rows.
    """
    place, starts, total = _layout(first)
    counts = np.diff(first)
    laid = np.full(total, len(distinct))
    laid[place] = words
    x = np.concatenate([p["e"][distinct].sum(1), np.zeros((1, p["e"].shape[1]), np.float32)])
    out = np.full(len(counts), p["b"][0], np.float64)
    filters = len(p["c1"])
    for i, w in enumerate(WIDTHS):
        size = total - w + 1
        score = (x @ p[f"k{w}"][0])[laid[:size]]
        for j in range(1, w):
            score += (x @ p[f"k{w}"][j])[laid[j : j + size]]
        bounds = np.minimum(np.stack([starts[:-1], _bounds(starts, counts, w)], 1).ravel(), size - 1)
        best = np.maximum.reduceat(score, bounds, axis=0)[::2] + p[f"c{w}"]
        out += np.maximum(best, 0) @ p["v"][i * filters : (i + 1) * filters]
    return out
