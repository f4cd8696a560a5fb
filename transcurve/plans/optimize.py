"""Fitting the free parameters of a model: damped Newton steps with a line search in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from transcurve.operators import kernel
from transcurve.operators.blocked import DECIDED, BlockedGrid, race
from transcurve.operators.evaluate import Point, evaluate_many, exact_penalty_gradients
from transcurve.settings import Settings
from transcurve.spec import Model


class FitError(RuntimeError):
    """A fit that can't begin or doesn't converge."""


@dataclass
class Optimum:
    point: Point
    steps: int
    converged: bool


#: Step lengths that a line search tries together.
STEPS = (1.0, 0.5, 2.0, 0.25, 0.1, 0.02)
#: A fit ends where no component of the gradient is larger, or the objective gains less.
GRADIENT, GAIN = 1e-9, 1e-12
#: Share of the settings' z-score cut-off below which a step's gain ends a fit that moves curves.
NOISE = 0.1

#: Which places (status, entry, depth, parameter) a fit may change.
Wanted = Callable[[tuple[int, int, int, int]], bool] | None


def _free(model: Model, wanted: Wanted) -> np.ndarray:
    return np.array([i for i, p in enumerate(model.places()) if wanted is None or wanted(p)], int)


def gain_z(gain: float, n: float) -> float:
    """The z-score of a gain in the mean objective over n rows: near an optimum the variance of the
    rows' differences is twice the gain, since the Hessian is the gradient's variance there."""
    return (max(gain, 0.0) * n / 2) ** 0.5


@dataclass
class _State:
    """A model on its way."""

    model: Model
    free: np.ndarray
    point: Point | None = None
    best: float = np.inf
    steps: int = 0
    done: bool = False
    whole: bool = True  # whether trial steps read all rows


def _penalties(grid: DataFrame, states: Sequence[_State], settings: Settings) -> list[np.ndarray]:
    """What the target adds to each state's gradient; that of the ICE targets takes one more pass for all."""
    if settings.target in ("ENTROPY", "L2"):
        return [s.point.penalty_gradient(settings.target, settings.l2_lambda) for s in states]
    return exact_penalty_gradients(grid, [s.point for s in states], settings.target)


def _level(target: str) -> int:
    """What a target's value needs."""
    return kernel.VALUE if target in ("ENTROPY", "L2") else kernel.SECOND if target == "ICE_RAW" else kernel.FIRST


def _moves(state: _State, penalty: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """Newton moves of several lengths and dampings; none where the gradient vanishes."""
    theta, free = state.model.pack(), state.free
    g, h = state.point.gradient + penalty, state.point.hessian
    if settings.target == "L2":
        h = h + 2 * settings.l2_lambda * np.eye(len(theta))
    g, h = g[free], h[np.ix_(free, free)]
    if not len(free) or np.max(np.abs(g)) < GRADIENT:
        return []
    out = []
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    for damp, lengths in ((1e-6, STEPS), (1e-3, STEPS[:1]), (1.0, STEPS[:1])):
        bent = np.maximum(np.abs(values), damp * max(1e-12, float(np.max(np.abs(values)))))
        direction = -vectors @ ((vectors.T @ g) / bent)
        for length in lengths:
            move = np.zeros(len(theta))
            move[free] = direction * length
            out.append(move)
    return out


def _raced(grid: BlockedGrid, states: Sequence[_State], tried: Sequence[Sequence[Model]], settings: Settings) -> list[np.ndarray]:
    """Objectives of the trial models, of which only each state's winner, or none, is finite: what the groups read say."""
    l2 = settings.l2_lambda if settings.target == "L2" else 0.0
    contests = [[s.model, *ms] for s, ms in zip(states, tried, strict=True)]
    size = lambda m: l2 * float(m.pack() @ m.pack())
    out = []
    for s, ms, won in zip(states, tried, race(grid, contests, offsets=[[size(m) - size(ms[0]) for m in ms] for ms in contests]), strict=True):
        found = np.full(len(ms), np.inf)
        if won.winner:
            found[won.winner - 1] = s.best + won.difference
        out.append(found)
    return out


def _foreseen(state: _State, model: Model, settings: Settings) -> float:
    """The gain of a move by the derivatives alone."""
    theta, l2 = state.model.pack(), settings.l2_lambda if settings.target == "L2" else 0.0
    move = model.pack() - theta
    return float(-(state.point.gradient + 2 * l2 * theta) @ move - move @ (state.point.hessian + 2 * l2 * np.eye(len(theta))) @ move / 2)


def minimise_many(grid: DataFrame | BlockedGrid, models: Sequence[Model], settings: Settings | None = None, wanted: Sequence[Wanted] | None = None) -> list[Optimum]:
    """Minimise the target of each model over its ``wanted`` parameters (all free ones by default).

    On a blocked grid the trial steps of a plain target read groups of rows until one is clearly
    the best, or none where no sample could tell; derivatives, and what is accepted, are always of all rows.
    A step that all rows don't confirm is taken back, and from there on trial steps read all rows.

    The models go in step: a step is one pass for the derivatives of all and one for all
    their step lengths, so many candidates cost the passes of the slowest. An ICE target
    takes one more, for the third derivatives in its gradient.
    """
    settings = settings or Settings()
    target, l2 = settings.target, settings.l2_lambda
    plain = target in ("ENTROPY", "L2")
    blocks, grid = (grid, grid.rows) if isinstance(grid, BlockedGrid) else (None, grid)
    states = [_State(m, _free(m, w), whole=blocks is None or not plain) for m, w in zip(models, wanted or [None] * len(models), strict=True)]
    for s, p in zip(states, evaluate_many(grid, models, kernel.SECOND), strict=True):
        if not p.n:
            raise FitError("no rows to fit")
        s.point, s.best = p, p.objective(target, l2)
    for _ in range(settings.max_steps):
        live = [s for s in states if not s.done]
        if not live:
            break
        tried = [[s.model.unpack(s.model.pack() + m) for m in _moves(s, penalty, settings)] for s, penalty in zip(live, _penalties(grid, live, settings), strict=True)]
        found = [np.zeros(0)] * len(live)
        for i, s in enumerate(live):
            # near the optimum a step gains less than even all rows could tell: it's taken unseen and judged by its derivatives' pass
            if not s.whole and tried[i] and gain_z(gain := _foreseen(s, tried[i][0], settings), s.point.n) < DECIDED:
                found[i] = np.array([s.best - max(gain, 2 * GAIN)])
        if part := [i for i, s in enumerate(live) if not s.whole and tried[i] and not len(found[i])]:
            for i, values in zip(part, _raced(blocks, [live[i] for i in part], [tried[i] for i in part], settings), strict=True):
                found[i] = values
        if whole := [i for i, s in enumerate(live) if s.whole and tried[i]]:
            points = iter(evaluate_many(grid, [m for i in whole for m in tried[i]], _level(target)))
            for i in whole:
                found[i] = np.array([next(points).objective(target, l2) for _ in tried[i]])
        moved = []
        for s, ms, values in zip(live, tried, found, strict=True):
            values = np.where(np.isfinite(values), values, np.inf)
            if not len(values) or values.min() >= s.best - GAIN:
                s.done, s.whole = s.whole or not ms, True  # what a sample denies, all rows may grant
                continue
            at = int(np.argmin(values))
            moved.append((s, ms[at], s.best - values[at]))
        points = evaluate_many(grid, [m for _, m, _ in moved], kernel.SECOND) if moved else []
        for (s, model, gain), p in zip(moved, points, strict=True):
            if not s.whole:
                gain = s.best - p.objective(target, l2)
                if not gain > GAIN:
                    s.whole = True
                    continue
            s.model, s.point, s.best, s.steps = model, p, p.objective(target, l2), s.steps + 1
            # betas alone are a convex problem, which ends at its optimum in a few more steps; curves have flat valleys
            places = s.model.places()
            s.done = any(places[i][2] >= 0 for i in s.free) and gain_z(gain, s.point.n) < NOISE * settings.z_score_cutoff
    return [Optimum(s.point, s.steps, s.done) for s in states]


def minimise(grid: DataFrame | BlockedGrid, model: Model, settings: Settings | None = None, wanted: Wanted = None) -> Optimum:
    """One model; of very many parameters by gradients alone."""
    settings = settings or Settings()
    if len(_free(model, wanted)) > settings.newton_params and settings.target in ("ENTROPY", "L2"):
        return minimise_by_gradient(grid, model, settings, wanted)
    return minimise_many(grid, [model], settings, [wanted])[0]


#: Steps that the gradient's optimiser remembers, and the lengths that it tries in a pass, about the one it expects.
MEMORY, LENGTHS = 12, (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
#: Passes that a line search takes at most to find a bracket, and points inside it.
BRACKETS, INSIDE = 6, 6
#: Steps in a row that gain next to nothing before it ends.
STALLS = 3


def minimise_by_gradient(grid: DataFrame | BlockedGrid, model: Model, settings: Settings | None = None, wanted: Wanted = None) -> Optimum:
    """Minimise entropy (or L2) by limited-memory quasi-Newton steps: each costs a pass for the gradient and one
    or more for a line search, and nothing is held but vectors of the parameters' length.

    The line search tries several lengths in a pass, moves on while the best is at an end,
    then looks inside the bracket around it.
    """
    settings = settings or Settings()
    if settings.target not in ("ENTROPY", "L2"):
        raise ValueError("gradients alone serve plain targets")
    grid, l2 = grid.rows if isinstance(grid, BlockedGrid) else grid, settings.l2_lambda if settings.target == "L2" else 0.0
    free = _free(model, wanted)
    value = lambda p: p.objective(settings.target, l2)

    def at(m: Model) -> tuple[Point, np.ndarray]:
        p = evaluate_many(grid, [m], kernel.FIRST)[0]
        return p, (p.gradient + p.penalty_gradient(settings.target, l2))[free]

    point, g = at(model)
    if not point.n:
        raise FitError("no rows to fit")
    past: list[tuple[np.ndarray, np.ndarray]] = []
    steps = stalls = 0
    while steps < settings.max_gradient_steps and len(free) and np.max(np.abs(g)) >= GRADIENT:
        direction = -_two_loops(g, past)
        if direction @ g >= 0:
            past, direction = [], -g
        expected = 1.0 if past else 1.0 / float(np.linalg.norm(g))
        found = _bracketed(grid, point, free, direction, expected, value)
        if found is None or value(point) - value(found) < GAIN:
            stalls += 1
            if found is None and not past or stalls >= STALLS:
                break
            past = []
            if found is None:
                continue
        else:
            stalls = 0
        before, was = point, g
        point, g = at(found.model)
        steps += 1
        s, y = (point.model.pack() - before.model.pack())[free], g - was
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            past = [*past, (s, y)][-MEMORY:]
    return Optimum(point, steps, steps < settings.max_gradient_steps)


def _two_loops(g: np.ndarray, past: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The inverse Hessian that the past steps and gradients suggest, times g."""
    q, shares = g.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        shares.append(a)
        q -= a * y
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(shares), strict=True):
        q += (a - (y @ q) / (s @ y)) * s
    return q


def _bracketed(grid: DataFrame, start: Point, free: np.ndarray, direction: np.ndarray, expected: float, value: Callable[[Point], float]) -> Point | None:
    """The best point found along a direction, None if none is better than the start."""
    theta, tried = start.model.pack(), {0.0: start}

    def trial(lengths: Sequence[float]) -> None:
        models = []
        for a in lengths:
            moved = theta.copy()
            moved[free] += a * direction
            models.append(start.model.unpack(moved))
        tried.update(zip(lengths, evaluate_many(grid, models), strict=True))

    of = lambda a: v if np.isfinite(v := value(tried[a])) else np.inf
    lengths = [expected * a for a in LENGTHS]
    for _ in range(BRACKETS):
        trial(lengths)
        best = min(tried, key=lambda a: (of(a), a))
        if best == max(tried):
            lengths = [best * 2.0**i for i in range(1, len(LENGTHS) + 1)]
        elif best == 0.0:
            least = min(a for a in tried if a)
            lengths = [least / 4.0**i for i in range(1, len(LENGTHS) + 1)]
        else:
            break
    if best == 0.0:
        return None
    order = sorted(tried)
    i = order.index(best)
    lo, hi = order[i - 1], order[min(i + 1, len(order) - 1)]
    if hi > lo and of(0.0) - of(best) > GAIN:
        trial([lo + (hi - lo) * j / (INSIDE + 1) for j in range(1, INSIDE + 1)])
    return tried[min(tried, key=lambda a: (of(a), a))]


def line_search(grid: DataFrame, model: Model, direction: Sequence[float], lengths: Sequence[float], settings: Settings | None = None) -> Point:
    """The best of a model's moves along a direction, evaluated in one pass."""
    settings, theta = settings or Settings(), model.pack()
    points = evaluate_many(grid, [model.unpack(theta + a * np.asarray(direction, float)) for a in lengths], _level(settings.target))
    return min(points, key=lambda p: p.objective(settings.target, settings.l2_lambda))
