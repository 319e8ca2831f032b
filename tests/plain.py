"""Numpy versions of training and of questions to predictors, which plans are held against."""

from __future__ import annotations

import numpy as np

from latticework.operators import gat


def train(net: gat.Network, x, graph, y, train_mask, val_mask, *, epochs: int = 800, rate: float = 1e-3, decay: float = 1e-4, clip: float = 1.0, patience: int = 60, stale: int = 20) -> list[float]:
    """Adam on the masked mean squared error, gradient norm clipped, rate halved after `stale` epochs without progress, stopped after `patience`, best weights restored."""
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    best, kept, wait, losses = np.inf, None, 0, []
    for t in range(1, epochs + 1):
        _, g = net.gradients(x, graph, y, train_mask)
        norm = np.sqrt(sum((d * d).sum() for d in g.values()))
        for k, p in net.p.items():
            d = g[k] * min(1.0, clip / (norm + 1e-6)) + decay * p
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        pred, _ = net.forward(x, graph)
        loss = float(((pred - y)[val_mask] ** 2).mean())
        losses.append(loss)
        if loss < best - 1e-6:
            best, kept, wait = loss, {k: p.copy() for k, p in net.p.items()}, 0
        else:
            wait += 1
            if wait % stale == 0:
                rate = max(1e-6, rate / 2)
            if wait >= patience:
                break
    net.p = kept or net.p
    return losses


def mlp(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = (64, 32), *, epochs: int = 300, rate: float = 1e-2, seed: int = 42):
    """A multi-layer perceptron by Adam; gives its predictor."""
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *hidden, y.shape[1]]
    ws = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
    bs = [np.zeros(b) for b in sizes[1:]]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in ws + bs]

    def run(z):
        acts = [z]
        for k, (w, b) in enumerate(zip(ws, bs, strict=True)):
            z = z @ w + b
            z = np.maximum(z, 0) if k < len(ws) - 1 else z
            acts.append(z)
        return acts

    for t in range(1, epochs + 1):
        acts = run(x)
        g, gw, gb = 2 * (acts[-1] - y) / y.size, [], []
        for k in reversed(range(len(ws))):
            gw.insert(0, acts[k].T @ g)
            gb.insert(0, g.sum(0))
            g = (g @ ws[k].T) * (acts[k] > 0)
        for p, d, s in zip(ws + bs, gw + gb, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * d
            s[1] = 0.999 * s[1] + 0.001 * d * d
            p -= rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8)
    return lambda z: run(z)[-1]


def r2(truth: np.ndarray, guess: np.ndarray) -> np.ndarray:
    return 1 - ((truth - guess) ** 2).sum(0) / ((truth - truth.mean(0)) ** 2).sum(0)


def ablation(predict, x: np.ndarray, y: np.ndarray, groups: dict[str, list[int]], mask: np.ndarray) -> list[tuple[str, int, np.ndarray]]:
    """Name, number of features, fall of R2 on the mask with the group's features at 0."""
    base, out = r2(y[mask], predict(x)[mask]), []
    for name, cols in groups.items():
        z = x.copy()
        z[:, cols] = 0.0
        out.append((name, len(cols), base - r2(y[mask], predict(z)[mask])))
    return out


def permutation_importance(predict, x: np.ndarray, y: np.ndarray, mask: np.ndarray, repeats: int = 3, seed: int = 42) -> np.ndarray:
    """Mean fall of R2 for each feature and target, the feature's values permuted."""
    rng, base = np.random.default_rng(seed), r2(y[mask], predict(x)[mask])
    out = np.zeros((x.shape[1], y.shape[1]))
    for k in range(x.shape[1]):
        for _ in range(repeats):
            z = x.copy()
            z[:, k] = rng.permutation(z[:, k])
            out[k] += (base - r2(y[mask], predict(z)[mask])) / repeats
    return out


def partial_dependence(predict, x: np.ndarray, k: int, points: int = 50) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Value, mean and population deviation of the predictions with feature k at it."""
    out = []
    for v in np.linspace(x[:, k].min(), x[:, k].max(), points):
        z = x.copy()
        z[:, k] = v
        p = predict(z)
        out.append((float(v), p.mean(0), p.std(0)))
    return out


def shapley(predict, rows: np.ndarray, background: np.ndarray, samples: int = 50, seed: int = 42) -> np.ndarray:
    """Sampled Shapley values (rows, features, targets): marginal contributions along random orders, each from a random background row; they sum to the prediction's difference."""
    rng = np.random.default_rng(seed)
    n, f = rows.shape
    out = np.zeros((n, f, predict(rows[:1]).shape[1]))
    for _ in range(samples):
        z = background[rng.integers(0, len(background), n)].copy()
        before = predict(z)
        for k in rng.permutation(f):
            z[:, k] = rows[:, k]
            after = predict(z)
            out[:, k] += (after - before) / samples
            before = after
    return out


def edge_occlusion(net: gat.Network, x, graph, node: int, top: int = 10) -> list[tuple[int, int, float]]:
    """The edges whose removal changes a node's prediction most: a deterministic stand-in for learned edge masks. Only edges within two steps can matter."""
    src, dst, w = graph
    near = np.unique(np.append(src[dst == node], node))
    base, out = net.forward(x, graph)[0][node], []
    for e in np.flatnonzero(np.isin(dst, near) & (src != dst)):
        keep = np.arange(len(src)) != e
        out.append((int(src[e]), int(dst[e]), float(np.abs(net.forward(x, (src[keep], dst[keep], w[keep]))[0][node] - base).sum())))
    return sorted(out, key=lambda t: (-t[2], t[0], t[1]))[:top]
