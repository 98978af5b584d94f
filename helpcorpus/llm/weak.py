"""Weak supervision: a generative model of voters, and a linear classifier on its posterior labels.

Both are fitted on a bounded sample; see the operators for the bound.
"""

from __future__ import annotations

import numpy as np

#: Rows that a Newton step looks at at once.
ROWS = 1000


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 by row, P(vote | class) as [voter, class, vote + 1], and voters' weights.

    votes: rows by voters, 1, -1 or 0 (abstains). start: first posterior. Accuracies are estimated by
    expectation-maximisation. Voters that err together count less: each is weighed by one over the
    sum of its absolute correlations, given the class, with all voters.
    """
    n, m = votes.shape
    post, weights = start.astype(float), np.ones(m)
    theta = np.full((m, 2, 3), 1 / 3)
    if not n:
        return post, theta, weights
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for i in range(rounds):
        by_class = np.stack([1 - post, post])
        theta = np.einsum("cn,nmv->mcv", by_class, hot) + 0.5
        theta /= theta.sum(axis=2, keepdims=True)
        if i % 5 == 4:  # correlations of what is left after the class is accounted for
            mean = np.einsum("mcv,v->mc", theta, np.array([-1.0, 0.0, 1.0]))
            rest = votes - np.einsum("cn,mc->nm", by_class, mean)
            sd = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            weights = 1 / np.maximum(np.abs(rest.T @ rest / n / np.outer(sd, sd)).sum(axis=0), 1.0)
        prior = (post.sum() + 0.5) / (n + 1)
        odds = np.log(prior / (1 - prior)) + np.einsum("nmv,mv,m->n", hot, np.log(theta[:, 1] / theta[:, 0]), weights)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, theta, weights


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    n, m = x.shape
    if not n:
        return np.zeros(m), -2.0
    w = np.zeros(m + 1)
    penalty = np.full(m + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        curve, slope = np.diag(penalty), -penalty * w
        for i in range(0, n, ROWS):  # a block at a time, so the driver holds no second copy of x
            a = np.hstack([x[i : i + ROWS], np.ones((len(x[i : i + ROWS]), 1))])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            curve += (a * (p * (1 - p))[:, None]).T @ a
            slope += a.T @ (target[i : i + ROWS] - p)
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def sparse_logistic(rows: list[tuple[np.ndarray, np.ndarray]], dimensions: int, target: np.ndarray, ridge: float = 1.0, rounds: int = 12, inner: int = 15) -> tuple[np.ndarray, float]:
    """logistic for rows of (distinct indices, values): Newton steps, each solved by conjugate gradients."""
    if not rows:
        return np.zeros(dimensions), -2.0
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    of_row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w, penalty = np.zeros(dimensions + 1), np.append(np.full(dimensions, ridge), 1e-3)
    by_row = lambda v: np.bincount(of_row, value * v[at], len(rows)) + v[-1]
    by_feature = lambda u: np.append(np.bincount(at, value * u[of_row], dimensions), u.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(by_row(w), -30, 30)))
        curve = p * (1 - p)
        slope = by_feature(target - p) - penalty * w
        step, rest = np.zeros_like(w), slope.copy()
        # scaled by the diagonal, so that features of few rows do not slow the others down
        scale = 1 / (np.append(np.bincount(at, value**2 * curve[of_row], dimensions), curve.sum()) + penalty)
        way = scale * rest
        size = rest @ way
        for _ in range(inner):
            if size < 1e-12:
                break
            bent = by_feature(curve * by_row(way)) + penalty * way
            move = size / (way @ bent)
            step += move * way
            rest -= move * bent
            new = scale * rest
            size, old = rest @ new, size
            way = new + size / old * way
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-3:
            break
    return w[:-1], float(w[-1])
