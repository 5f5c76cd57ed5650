"""A bidirectional gated recurrent network over bytes, in numpy: a label for every position.

Forward, for input x and state h:  z = s(x Wz + h Uz), r = s(x Wr + h Ur), n = tanh(x Wn + r * (h Un)),
h' = (1 - z) n + z h. The two directions are joined per position and mapped to label scores. Trained by backpropagation
through time with Adam. The input is one of 256 bytes, so x W is a row of a table.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def init(hidden: int, labels: int, seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(hidden)
    out: Params = {}
    for d in "fb":
        out[f"x{d}"] = (rng.normal(size=(256, 3 * hidden)) * 0.3).astype(np.float32)
        out[f"u{d}"] = (rng.normal(size=(hidden, 3 * hidden)) * scale).astype(np.float32)
        out[f"c{d}"] = np.zeros(3 * hidden, np.float32)
    out["w"] = (rng.normal(size=(2 * hidden, labels)) * scale).astype(np.float32)
    out["b"] = np.zeros(labels, np.float32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(p: Params, d: str, codes: np.ndarray, keep: list | None) -> np.ndarray:
    """States after each position of codes (rows, length), in one direction."""
    rows, length = codes.shape
    u, c = p[f"u{d}"], p[f"c{d}"]
    size = len(u)
    h = np.zeros((rows, size), u.dtype)
    out = np.empty((length, rows, size), u.dtype)
    for t in range(length) if d == "f" else range(length - 1, -1, -1):
        x = p[f"x{d}"][codes[:, t]] + c
        g = h @ u
        zr = _sigmoid(x[:, : 2 * size] + g[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(x[:, 2 * size :] + r * g[:, 2 * size :])
        if keep is not None:
            keep.append((t, h, z, r, n, g[:, 2 * size :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def probabilities(p: Params, codes: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, states), both (length, rows, ...), for sequences of equal length."""
    h = np.concatenate([_run(p, d, codes, keep[k] if keep else None) for k, d in enumerate("fb")], axis=2)
    scores = h @ p["w"] + p["b"]
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True), h


def gradients(p: Params, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, Params]:
    """Weighted cross-entropy over all positions, and its gradients by backpropagation through time.

    `labels` per row; `weights` per row and position, summing to 1.
    """
    keep: tuple[list, list] = ([], [])
    prob, h = probabilities(p, codes, keep)
    rows, length = codes.shape
    w = weights.T
    at = prob[:, np.arange(rows), labels]
    loss = float(-(w * np.log(at + 1e-12)).sum())
    d = prob * w[:, :, None]
    d[:, np.arange(rows), labels] -= w
    grad: Params = {"w": np.einsum("tnh,tnl->hl", h, d, optimize=True), "b": d.sum((0, 1))}
    back = d @ p["w"].T
    size = len(p["uf"])
    for k, way in enumerate("fb"):
        u = p[f"u{way}"]
        gu, gc, gx = np.zeros_like(u), np.zeros(3 * size, u.dtype), np.zeros_like(p[f"x{way}"])
        carry = np.zeros((rows, size), u.dtype)
        for t, before, z, r, n, gn in reversed(keep[k]):
            dh = back[t][:, k * size : (k + 1) * size] + carry
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], 1)
            dg = np.concatenate([dz, dr, dn * r], 1)
            gu += before.T @ dg
            gc += dx.sum(0)
            np.add.at(gx, codes[:, t], dx)
            carry = dh * z + dg @ u.T
        grad |= {f"u{way}": gu, f"c{way}": gc, f"x{way}": gx}
    return loss, grad


def trained(codes: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, letters: np.ndarray, hidden: int, kinds: int, epochs: int, batch: int = 512, rate: float = 0.01, seed: int = 0) -> Params:
    """Fit to byte strings with a label and a weight each; positions count where `letters[byte]`."""
    p = init(hidden, kinds, seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    rng = np.random.default_rng(seed)
    sizes = np.array([len(c) for c in codes])
    step = 0
    total = epochs * sum(-(-int((sizes == n).sum()) // batch) for n in np.unique(sizes))
    for _ in range(epochs):
        batches = []
        for n in np.unique(sizes):
            own = rng.permutation(np.flatnonzero(sizes == n))
            batches += [own[i : i + batch] for i in range(0, len(own), batch)]
        for k in rng.permutation(len(batches)):
            own = batches[k]
            x = np.stack([codes[i] for i in own])
            w = (weights[own, None] * letters[x]).astype(np.float32)
            if not w.sum():
                continue
            _, grad = gradients(p, x, labels[own], w / w.sum())
            step += 1
            now = rate * max(0.1, 1 - step / total)
            for name, g in grad.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                p[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p
