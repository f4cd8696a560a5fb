"""Information criteria and comparisons of fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the digits of a double near four: relative tolerance of comparisons and cut-offs.
TOLERANCE = math.sqrt(math.ulp(4.0))


def aic(entropy: float | Column, n: float | Column, params: int) -> float | Column:
    return 2 * (n * entropy + params)


def aic_difference(params_a: int, params_b: int, entropy_a: float, entropy_b: float, n: float) -> float:
    """AIC of b less that of a."""
    return 2 * ((params_b - params_a) + n * (entropy_b - entropy_a))


def compare_rounded(a: float, b: float) -> int:
    """-1, 0 or 1 as a is below, near or above b, relative to b; both positive and finite."""
    if not (a > 0 and b > 0 and math.isfinite(a) and math.isfinite(b)):
        raise ValueError("compared numbers must be positive and finite")
    relative = (b - a) / (2 * b)
    return -1 if relative > TOLERANCE else 1 if relative < -TOLERANCE else 0


def is_aic_better(a: float, b: float) -> bool:
    return compare_rounded(a, b) < 0


def is_aic_worse(a: float, b: float) -> bool:
    return compare_rounded(a, b) > 0


def pseudo_inverse(m: np.ndarray, cut: float = 1e-8) -> np.ndarray:
    return np.linalg.pinv(m, rcond=cut) if m.size else m


def inverse_condition(m: np.ndarray) -> float:
    s = np.linalg.svd(m, compute_uv=False) if m.size else np.ones(1)
    return float(s[-1] / s[0]) if s[0] else 0.0


def penalty_trace(hessian: np.ndarray, fisher: np.ndarray) -> float:
    """tr(J^-1 I): the effective number of parameters."""
    return float(np.trace(pseudo_inverse(hessian) @ fisher))


def tic(entropy: float, n: float, hessian: np.ndarray, fisher: np.ndarray) -> float:
    return 2 * (n * entropy + penalty_trace(hessian, fisher))


def param_std(fisher: np.ndarray, n: float) -> np.ndarray:
    return np.sqrt(np.maximum(np.diag(pseudo_inverse(fisher)), 0)) / math.sqrt(n)


def cutoff(x: np.ndarray) -> float:
    return TOLERANCE * float(np.max(np.abs(x))) if len(x) else 0.0


def _terms(g2: np.ndarray, below: np.ndarray) -> float:
    floor = math.ulp(4.0) * float(np.max(g2)) if len(g2) else 0.0
    keep = (g2 >= floor) & (g2 > 0) & (below != 0)
    return float(np.sum(g2[keep] / below[keep]))


def ice_sum(g2: np.ndarray, j: np.ndarray) -> float:
    """Sum of g^2 / j over parameters, from means."""
    return _terms(g2, np.asarray(j, float))


def ice2_sum(g2: np.ndarray, j: np.ndarray, n: float, outcomes: float = 3.0) -> float:
    """g^2 against |j| balanced with g^2, more so for small tables."""
    b = 1 / (n * math.log(outcomes))
    return _terms(g2, np.abs(j) * (1 - b) + g2 * b)


def ice3_sum(g2: np.ndarray, j: np.ndarray) -> float:
    """g^2 against j where j is clearly positive, passing over to g^2 where it is not."""
    j = np.asarray(j, float)
    cut = cutoff(j)
    w = np.where(j > 0, np.exp(-cut / np.where(j > 0, j, 1.0)), 0.0)
    return _terms(g2, j * w + g2 * (1 - w))


def ice_derivative(g2: np.ndarray, shift: np.ndarray, j: np.ndarray, n: float, outcomes: float = 3.0) -> np.ndarray:
    """How the balanced penalty moves with each parameter, from means: the shift gradient against
    j (where positive) balanced with g^2. The third derivatives are taken to cancel one of the
    shift's two terms; parameters whose g^2 or shift lies below the sums' floor get none."""
    if not n:
        return np.zeros(len(g2))
    b = 1 / (n * math.log(outcomes))
    return _shifted(g2, shift, np.maximum(j, 0) * (1 - b) + g2 * b, n)


def ice_stable_derivative(g2: np.ndarray, shift: np.ndarray, j: np.ndarray, n: float) -> np.ndarray:
    """The same against j where it is clearly positive, passing over to g^2 where it is not."""
    j = np.asarray(j, float)
    cut = cutoff(j)
    if not n or not cut:
        return np.zeros(len(g2))
    w = np.where(j > 0, np.exp(-cut / np.where(j > 0, j, 1.0)), 0.0)
    return _shifted(g2, shift, j * w + g2 * (1 - w), n)


def _shifted(g2: np.ndarray, shift: np.ndarray, below: np.ndarray, n: float) -> np.ndarray:
    floor = math.ulp(4.0) * float(np.max(g2)) if len(g2) else 0.0
    keep = (g2 >= floor) & (shift >= floor) & (floor > 0) & (below > 0)
    return np.divide(shift, below * n, out=np.zeros(len(g2)), where=keep)


def penalty_gradient(target: str, n: float, theta: np.ndarray, g2: np.ndarray | None = None, j: np.ndarray | None = None, shift: np.ndarray | None = None, scaled: np.ndarray | None = None, scaled2: np.ndarray | None = None, l2: float = 0.0) -> np.ndarray:
    """What a target adds to the entropy's gradient; for the ICE targets but for the third derivatives.

    ICE and ICE_B take the gradients scaled against an earlier Hessian diagonal; ICE_RAW, whose
    own can't be had in a pass, takes those of ICE.
    """
    if target == "ENTROPY":
        return np.zeros(len(theta))
    if target == "L2":
        return 2 * l2 * theta
    if target in ("ICE_SIMPLE", "ICE2"):
        return ice_derivative(g2, shift, j, n)
    if target == "ICE_STABLE_B":
        return ice_stable_derivative(g2, shift, j, n)
    if target in ("ICE_RAW", "ICE", "ICE_B"):
        return (scaled2 if target == "ICE_B" else scaled) / max(n, 1.0)
    raise ValueError(f"unknown target {target}")


def exact_penalty_gradient(target: str, n: float, g2: np.ndarray, j: np.ndarray, dg2: np.ndarray, dj: np.ndarray, outcomes: float = 3.0) -> np.ndarray:
    """The derivative of ``objective``'s sum of ratios by each parameter, from those of g2 and j: rows by ratio, columns by parameter."""
    j = np.asarray(j, float)
    if target == "ICE_SIMPLE":
        below, dbelow = j, dj
    elif target == "ICE2":
        b = 1 / (n * math.log(outcomes))
        below, dbelow = np.abs(j) * (1 - b) + g2 * b, np.sign(j)[:, None] * dj * (1 - b) + dg2 * b
    elif target in ("ICE", "ICE_B", "ICE_STABLE_B"):
        cut, top = cutoff(j), int(np.argmax(np.abs(j))) if len(j) else 0
        dcut = TOLERANCE * np.sign(j[top]) * dj[top] if len(j) else 0.0
        up = np.where(j > 0, j, 1.0)[:, None]
        w = np.where(j > 0, np.exp(-cut / up[:, 0]), 0.0)[:, None]
        dw = np.where((j > 0)[:, None], w * (cut * dj / up - dcut) / up, 0.0)
        below = j * w[:, 0] + g2 * (1 - w[:, 0])
        dbelow = dj * w + j[:, None] * dw + dg2 * (1 - w) - g2[:, None] * dw
    else:
        raise ValueError(f"no ratios in {target}")
    floor = math.ulp(4.0) * float(np.max(g2)) if len(g2) else 0.0
    keep = (g2 >= floor) & (g2 > 0) & (below != 0)
    under = np.where(keep, below, 1.0)[:, None]
    return np.where(keep[:, None], (dg2 - g2[:, None] * dbelow / under) / under, 0.0).sum(axis=0) / n


def objective(target: str, n: float, entropy: float, theta: np.ndarray, g2: np.ndarray | None = None, j: np.ndarray | None = None, fisher: np.ndarray | None = None, hessian: np.ndarray | None = None, l2: float = 0.0) -> float:
    """What a fit with this target minimises."""
    if target == "ENTROPY":
        return entropy
    if target == "L2":
        return entropy + l2 * float(theta @ theta)
    if target == "ICE_RAW":
        return entropy + penalty_trace(hessian, fisher) / n
    if target == "ICE_SIMPLE":
        return entropy + ice_sum(g2, j) / n
    if target == "ICE2":
        return entropy + ice2_sum(g2, j, n) / n
    if target in ("ICE", "ICE_B", "ICE_STABLE_B"):
        return entropy + ice3_sum(g2, j) / n
    raise ValueError(f"unknown target {target}")


def ice_column(g2: list[Column], j: list[Column]) -> Column:
    """The same sum of ratios over Columns."""
    out = F.lit(0.0)
    for a, b in zip(g2, j, strict=True):
        out = out + a / b
    return out
