"""Small learners for bounded samples, in numpy on the driver: logistic regression, boosted trees, lasso."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights, the last of them the constant, of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def lasso(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> np.ndarray:
    """Weights, the last of them the constant (not shrunk), of an L1 logistic regression by accelerated proximal steps."""
    n, x = len(x), np.column_stack([x, np.ones(len(x))])
    v = np.ones(x.shape[1])
    for _ in range(20):  # the largest eigenvalue, for the length of a step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-300
    rate = 4 * n / (v @ (x.T @ (x @ v)) + 1e-300)
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        moved = z - rate * (x.T @ (sigmoid(x @ z) - y)) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * strength, 0)
        new[-1] = moved[-1]
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (last - 1) / t * (new - w), new
    return w


Condition = tuple[int, str, float]


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int = 32, rate: float = 0.3, leaf: int = 20) -> list[tuple[Condition, ...]]:
    """The conditions on the way to each node of boosted regression trees: conjunctions of (feature, "<=" or ">", bound)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    prior = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    score, paths = np.full(len(y), np.log(prior / (1 - prior))), {}
    for _ in range(trees):
        p = sigmoid(score)
        g, h = y - p, p * (1 - p)
        todo: list[tuple[np.ndarray, tuple[Condition, ...]]] = [(np.arange(len(y)), ())]
        while todo:
            rows, path = todo.pop()
            best, total_g, total_h = (1e-9, -1, -1), g[rows].sum(), h[rows].sum()
            if len(path) < depth and len(rows) >= 2 * leaf:
                for f in range(x.shape[1]):
                    k = code[rows, f]
                    n = np.bincount(k, minlength=bins).cumsum()
                    left_g, left_h = np.bincount(k, g[rows], bins).cumsum(), np.bincount(k, h[rows], bins).cumsum()
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    gain[(n < leaf) | (len(rows) - n < leaf)] = -1
                    gain = gain[: len(cuts[f])]
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                score[rows] += rate * total_g / (total_h + 1)
                continue
            _, f, b = best
            bound, low = float(cuts[f][b]), code[rows, f] <= b
            for part, op in ((rows[low], "<="), (rows[~low], ">")):
                longer = simplified((*path, (f, op, bound)))
                paths[longer] = None
                todo.append((part, longer))
    return list(paths)


def simplified(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One condition for each feature and direction, the tightest; in fixed order."""
    tight: dict[tuple[int, str], float] = {}
    for f, op, b in path:
        tight[f, op] = b if (f, op) not in tight else (min if op == "<=" else max)(b, tight[f, op])
    return tuple(sorted((f, op, b) for (f, op), b in tight.items()))
