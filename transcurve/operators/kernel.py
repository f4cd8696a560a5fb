"""Numpy kernel of a model: entropies, gradients and Hessians of a batch of rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np

from transcurve.functions import jets, softmax
from transcurve.spec import Model

#: Levels of evaluation: each holds what the one before it holds.
VALUE, FIRST, SECOND = 0, 1, 2


class Kernel:
    """Evaluates one model on arrays x[regressor] and the offsets of what happened (-1: unknown)."""

    def __init__(self, model: Model):
        self.model, self.places = model, model.places()
        self.betas = np.array(model.betas, float)
        same = np.zeros((len(model.reachable) + 1, len(model.reachable)))
        for k, ks in enumerate(model.same):
            same[k, list(ks)] = 1.0
        self.same = same  # the last row is for outcomes that can't be reached

    def _parts(self, x: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        weights, parts = np.ones((len(self.model.entries), n)), []
        for e, entry in enumerate(self.model.entries):
            own = [c.value(x[r]) if c else x[r] for r, c in entry.depth]
            for p in own:
                weights[e] *= p
            parts.append(own)
        return weights, parts

    def scores(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        return self.betas @ self._parts(x, n)[0]

    def entropy(self, x: dict[str, np.ndarray], actual: np.ndarray) -> np.ndarray:
        p = softmax.np_probabilities(self.scores(x, len(actual)))
        return softmax.np_entropy((p * self.same[actual].T).sum(axis=0))

    def rows(self, x: dict[str, np.ndarray], actual: np.ndarray, level: int = SECOND, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Entropy [n], its gradient and the diagonal of its Hessian [params, n]; at the second level also the
        Hessian's sum over the rows [params, params] and the sum of its products with the gradient [params].

        The derivatives are those of the value: a row at the entropy cap has none. No more
        than one array of n is held for a pair of parameters. ``counts`` weigh the rows in the two sums.
        """
        n, m = len(actual), self.model
        weights, parts = self._parts(x, n)
        p = softmax.np_probabilities(self.betas @ weights)
        mine = self.same[actual].T
        hit = (p * mine).sum(axis=0)
        h = softmax.np_entropy(hit)
        live = hit > math.exp(-softmax.CAP)
        q = np.divide(p * mine, hit, out=np.zeros_like(p), where=live)
        g = (p - q) * live  # by score
        # how each parameter moves the score of its status
        slope = np.empty((len(self.places), n))
        for i, (k, e, d, j) in enumerate(self.places):
            if d < 0:
                slope[i] = weights[e]
            else:
                slope[i] = self.betas[k, e] * self._rest(parts[e], d) * self._curve(e, d).gradient(x[m.entries[e].depth[d][0]])[j]
        status = [k for k, *_ in self.places]
        grad = g[status] * slope
        weighed = grad if counts is None else grad * counts
        diagonal, hess, shift = np.empty((len(status), n)), np.empty((len(status), len(status))), np.zeros(len(status))
        for a, (k, e, d, j) in enumerate(self.places):
            for b in range(a, len(status) if level >= SECOND else a + 1):
                k2, e2, d2, j2 = self.places[b]
                by_score = ((p[k] - q[k]) * (k == k2) - p[k] * p[k2] + q[k] * q[k2]) * live
                term = by_score * slope[a] * slope[b]
                if k == k2 and e == e2 and (d >= 0 or d2 >= 0):
                    term += g[k] * self._bend(x, parts[e], k, e, d, j, d2, j2)
                hess[a, b] = hess[b, a] = term.sum() if counts is None else term @ counts
                shift[a] += term @ weighed[b]
                if a == b:
                    diagonal[a] = term
                else:
                    shift[b] += term @ weighed[a]
        return h, grad, diagonal, hess, shift

    def directional(self, x: dict[str, np.ndarray], actual: np.ndarray, directions: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each direction u of the parameters, summed over the rows (times ``counts``): (g u) H u, and the third derivatives t(u, u, .); both [directions, params].

        g is a row's gradient and H its Hessian; all by jets of the gradient along u.
        """
        n, m = len(actual), self.model
        _, parts = self._parts(x, n)
        curves = {(e, d): (c.value(x[r]), c.gradient(x[r]), c.hessian(x[r]), c.third(x[r])) for e, entry in enumerate(m.entries) for d, (r, c) in enumerate(entry.depth) if c}
        mine = self.same[actual].T
        flat = lambda v: np.stack((v, np.zeros_like(v), np.zeros_like(v)))
        cross, third = np.zeros((2, len(directions), len(self.places)))
        p0 = softmax.np_probabilities(self.scores(x, n))
        live = (p0 * mine).sum(axis=0) > math.exp(-softmax.CAP)
        for r, u in enumerate(directions):
            move = dict(zip(self.places, u, strict=True))
            moved = {(e, d): jets.curve(*found, *(move.get((m.entries[e].restrict, e, d, j), 0.0) for j in (0, 1))) for (e, d), found in curves.items()}
            factors = [[moved[e, d][0] if c else flat(parts[e][d]) for d, (_, c) in enumerate(entry.depth)] for e, entry in enumerate(m.entries)]
            rest = lambda e, *without, factors=factors: reduce(jets.times, [f for d, f in enumerate(factors[e]) if d not in without], flat(np.ones(n)))
            weights = [rest(e) for e in range(len(m.entries))]
            beta = lambda k, e, move=move: np.array([self.betas[k, e], move.get((k, e, -1, 0), 0.0), 0.0])[:, None]
            scores = np.stack([sum(jets.times(beta(k, e), w) for e, w in enumerate(weights)) for k in range(len(m.reachable))], axis=1)
            p = jets.softmax(p0, scores)
            hit = (p * mine).sum(axis=1)
            by_score = np.where(live, p - jets.over(p * mine, hit[:, None]), 0.0)
            along = np.zeros(n)
            bent = []
            for i, (k, e, d, j) in enumerate(self.places):
                slope = weights[e] if d < 0 else jets.times(beta(k, e), jets.times(rest(e, d), moved[e, d][1][j]))
                g = jets.times(by_score[:, k], slope)
                along += u[i] * g[0]
                bent.append(g[1])
                third[r, i] = 2 * (g[2].sum() if counts is None else g[2] @ counts)
            cross[r] = np.stack(bent) @ (along if counts is None else along * counts) if bent else 0.0
        return cross, third

    def _curve(self, e: int, d: int):
        return self.model.entries[e].depth[d][1]

    @staticmethod
    def _rest(parts: list[np.ndarray], *without: int) -> np.ndarray | float:
        out: np.ndarray | float = 1.0
        for i, p in enumerate(parts):
            if i not in without:
                out = out * p
        return out

    def _bend(self, x: dict[str, np.ndarray], parts: list[np.ndarray], k: int, e: int, d: int, j: int, d2: int, j2: int) -> np.ndarray:
        """Second derivative of a score by two parameters of one entry."""
        at = lambda i: x[self.model.entries[e].depth[i][0]]
        if d < 0 or d2 < 0:
            i, c = (d2, j2) if d < 0 else (d, j)
            return self._rest(parts, i) * self._curve(e, i).gradient(at(i))[c]
        if d == d2:
            return self.betas[k, e] * self._rest(parts, d) * self._curve(e, d).hessian(at(d))[j + j2]
        return self.betas[k, e] * self._rest(parts, d, d2) * self._curve(e, d).gradient(at(d))[j] * self._curve(e, d2).gradient(at(d2))[j2]


def shape(params: int, level: int) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of the sums of a level, in the order in which they are packed."""
    out: list[tuple[str, tuple[int, ...]]] = [("n", ()), ("h", ()), ("h2", ())]
    if level >= FIRST:
        out += [("g", (params,)), ("g2", (params,)), ("j", (params,))]
    if level >= SECOND:
        out += [("fisher", (params, params)), ("hessian", (params, params)), ("shift", (params,))]
    return out


def sums(kernel: Kernel, x: dict[str, np.ndarray], actual: np.ndarray, level: int, previous: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """The sums of a batch, packed; with the previous diagonal, the scaled gradients follow. ``counts`` are the rows that each row stands for."""
    n = float(len(actual)) if counts is None else counts.sum()
    total = (lambda v: v.sum(axis=-1)) if counts is None else (lambda v: v @ counts)
    if level == VALUE:
        h = kernel.entropy(x, actual)
        return np.array([n, total(h), total(h * h)])
    h, g, j, hess, shift = kernel.rows(x, actual, level, counts)
    parts = [[n, total(h), total(h * h)], total(g), total(g * g), total(j)]
    if level >= SECOND:
        parts += [((g if counts is None else g * counts) @ g.T).ravel(), hess.ravel(), shift]
    if previous is not None:
        parts += [total(v) for v in scaled(g, j, previous)]
    return np.concatenate([np.asarray(p, float).ravel() for p in parts])


def scaled(g: np.ndarray, j: np.ndarray, previous: np.ndarray) -> list[np.ndarray]:
    """Each row's gradients scaled by the criterion's row ratios against a previous Hessian diagonal, and their mass."""
    from transcurve.functions.criteria import cutoff

    cut = cutoff(np.abs(previous))
    weight = np.where(previous > 0, np.exp(-cut / np.where(previous > 0, previous, 1.0)), 0.0)[:, None]
    below = previous[:, None] * weight + g * g * (1 - weight)
    ratio = np.divide(g * g, below, out=np.zeros_like(g), where=below > 0).sum(axis=0)
    return [2 * g * ratio, 2 * g * j / np.maximum(cut, previous)[:, None], ratio]
