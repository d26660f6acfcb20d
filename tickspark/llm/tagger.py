"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def start(symbols: int, tags: int, size: int, embedding: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"e": draw(symbols, embedding) * 2, "wo": draw(2 * size, tags), "bo": np.zeros(tags, np.float32), "tr": np.zeros((tags, tags), np.float32)}
    for d in "fb":
        bias = np.zeros(4 * size, np.float32)
        bias[size : 2 * size] = 1  # remember at first
        p |= {f"wx{d}": draw(embedding, 4 * size), f"wh{d}": draw(size, 4 * size), f"b{d}": bias}
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(p: Params, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (T, B, H) along x (T, B), and what the way back needs."""
    table = p["e"] @ p[f"wx{d}"] + p[f"b{d}"]
    size = p[f"wh{d}"].shape[0]
    h = c = np.zeros((x.shape[1], size), table.dtype)
    out, kept = np.empty((*x.shape, size), table.dtype), []
    for t, symbols in enumerate(x):
        z = table[symbols] + h @ p[f"wh{d}"]
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        kept.append((h, before, i, f, o, g, tc))
        out[t] = h = o * tc
    return out, kept


def _back(p: Params, d: str, x: np.ndarray, kept: list, dh_all: np.ndarray, grads: Params) -> None:
    wh = p[f"wh{d}"]
    size = wh.shape[0]
    dtable = np.zeros((p["e"].shape[0], 4 * size), wh.dtype)
    dwh = np.zeros_like(wh)
    dh = dc = np.zeros((x.shape[1], size), wh.dtype)
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, g, tc = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        np.add.at(dtable, x[t], dz)
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    grads[f"wh{d}"] = dwh
    grads[f"wx{d}"] = p["e"].T @ dtable
    grads[f"b{d}"] = dtable.sum(0)
    grads["e"] = grads.get("e", 0) + dtable @ p[f"wx{d}"].T


def emissions(p: Params, x: np.ndarray) -> np.ndarray:
    """Tag scores (T, B, tags) of windows x (T, B)."""
    forward, _ = _run(p, "f", x)
    backward, _ = _run(p, "b", x[::-1])
    return np.concatenate([forward, backward[::-1]], 2) @ p["wo"] + p["bo"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def loss_and_grads(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean negative log-likelihood of tags y (T, B) given x (T, B), and its gradients."""
    (hf, kf), (hb, kb) = _run(p, "f", x), _run(p, "b", x[::-1])
    hidden = np.concatenate([hf, hb[::-1]], 2)
    em, tr = hidden @ p["wo"] + p["bo"], p["tr"]
    n, batch, tags = em.shape
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0]
    for t in range(1, n):
        alpha[t] = em[t] + _lse(alpha[t - 1][:, :, None] + tr, 1)
    for t in range(n - 2, -1, -1):
        beta[t] = _lse(tr + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    every = np.arange(batch)
    right = sum(em[t][every, y[t]] for t in range(n)) + sum(tr[y[t - 1], y[t]] for t in range(1, n))
    dem = np.exp(alpha + beta - z[None, :, None])
    dtr = np.zeros_like(tr)
    for t in range(1, n):
        dtr += np.exp(alpha[t - 1][:, :, None] + tr + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dtr, (y[t - 1], y[t]), -1)
    for t in range(n):
        dem[t][every, y[t]] -= 1
    dem, dtr = dem / batch, dtr / batch
    flat = dem.reshape(-1, tags)
    grads: Params = {"wo": hidden.reshape(-1, hidden.shape[2]).T @ flat, "bo": flat.sum(0), "tr": dtr}
    dhidden = dem @ p["wo"].T
    size = hf.shape[2]
    _back(p, "f", x, kf, dhidden[:, :, :size], grads)
    _back(p, "b", x[::-1], kb, dhidden[::-1, :, size:], grads)
    return float((z - right).mean()), grads


def train(p: Params, x: np.ndarray, y: np.ndarray, epochs: int, batch: int, rate: float = 0.02, seed: int = 11) -> Params:
    """Adam over shuffled batches of windows x, y (windows, T); the rate falls to a tenth."""
    rng, step = np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            own = order[a : a + batch]
            _, grads = loss_and_grads(p, np.ascontiguousarray(x[own].T), np.ascontiguousarray(y[own].T))
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p[k] = (p[k] - rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def decode(p: Params, x: np.ndarray) -> np.ndarray:
    """The best tags (windows, T) of windows x (windows, T)."""
    return viterbi(emissions(p, np.ascontiguousarray(x.T)), p["tr"])


def viterbi(em: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The tags (B, T) with the largest sum of scores em (T, B, tags) and of transitions tr."""
    n, batch, _ = em.shape
    score, came = em[0], np.zeros(em.shape, np.int8)
    for t in range(1, n):
        ways = score[:, :, None] + tr
        came[t] = ways.argmax(1)
        score = ways.max(1) + em[t]
    tags = np.empty((n, batch), np.int8)
    tags[-1] = score.argmax(1)
    every = np.arange(batch)
    for t in range(n - 1, 0, -1):
        tags[t - 1] = came[t][every, tags[t]]
    return tags.T
