"""Closed-form and Newton fits from sufficient statistics (driver side; sizes depend on K and D only)."""

from __future__ import annotations

import numpy as np

from driftline.functions.dists import floored

#: Floors and ridges relative to the mean variance, pseudocount, least occupancy, least Poisson rate.
FIT_FLOOR = 1e-6
INIT_FLOOR = 1e-2
RIDGE = 1e-6
PSEUDOCOUNT = 1e-8
MIN_OCCUPANCY = 1.0
MIN_RATE = 1e-8


def categorical(counts: np.ndarray, old: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
    """Row-normalised counts with a pseudocount; rows without mass are uniform, rows under ``least`` keep ``old``."""
    counts = np.asarray(counts, float) + PSEUDOCOUNT
    out = counts / counts.sum(-1, keepdims=True)
    if old is not None and least > 0:
        weak = (counts - PSEUDOCOUNT).sum(-1, keepdims=True) < least
        out = np.where(weak, old, out)
    return out


def moments(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population mean and covariance of weighted sums."""
    safe = np.maximum(n, np.finfo(float).tiny)
    mean = first / safe[..., None]
    cov = second / safe[..., None, None] - mean[..., :, None] * mean[..., None, :]
    return mean, (cov + np.swapaxes(cov, -1, -2)) / 2


def gaussian(n: np.ndarray, first: np.ndarray, second: np.ndarray, old: tuple[np.ndarray, np.ndarray] | None = None, floor: float = FIT_FLOOR, least: float = MIN_OCCUPANCY, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of each state; states with less than ``least`` weight keep ``old``."""
    mean, cov = moments(n, first, second)
    if diagonal:
        cov = cov * np.eye(cov.shape[-1])
    cov = floored(cov, floor)
    if old is not None:
        weak = n < least
        mean, cov = np.where(weak[..., None], old[0], mean), np.where(weak[..., None, None], old[1], cov)
    return mean, cov


def poisson(n: np.ndarray, first: np.ndarray, old: np.ndarray | None = None, least: float = MIN_OCCUPANCY) -> np.ndarray:
    """Log rates of each state."""
    rates = np.log(np.maximum(first / np.maximum(n, np.finfo(float).tiny)[..., None], MIN_RATE))
    return rates if old is None else np.where((n < least)[..., None], old, rates)


def regression(n: np.ndarray, first: np.ndarray, second: np.ndarray, inputs: int, floor: float = FIT_FLOOR, ridge: float = RIDGE, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, bias, residual covariance) of the last coordinates on the first ``inputs``, from joint sums."""
    mean, cov = moments(np.asarray(n), first, second)
    uu, uv, vv = cov[..., :inputs, :inputs], cov[..., :inputs, inputs:], cov[..., inputs:, inputs:]
    lam = ridge * np.trace(uu, axis1=-2, axis2=-1) / max(1, inputs)
    lam = np.where(lam > 0, lam, ridge)
    w = np.swapaxes(np.linalg.solve(uu + lam[..., None, None] * np.eye(inputs), uv), -1, -2) if inputs else np.zeros((*uv.shape[:-2], uv.shape[-1], 0))
    bias = mean[..., inputs:] - np.einsum("...ij,...j->...i", w, mean[..., :inputs])
    cross = w @ uv
    rest = vv - cross - np.swapaxes(cross, -1, -2) + w @ uu @ np.swapaxes(w, -1, -2)
    if diagonal:
        rest = rest * np.eye(rest.shape[-1])
    return w, bias, floored(rest, floor, vv)


def poisson_statistics(coefficients: np.ndarray, bias: np.ndarray, y: np.ndarray, x: np.ndarray, w: np.ndarray, spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Objective, gradient (O, P+1) and Hessian (O, P+1, P+1) of Poisson regressions on uncertain inputs N(x, spread).

    ``y`` (N, O), ``x`` (N, P), ``w`` (N,), ``coefficients`` (O, P).
    """
    p = x.shape[-1]
    eta = x @ coefficients.T + bias
    moved = np.repeat(x[:, None, :], len(bias), 1)
    if spread is not None:
        s = np.einsum("nij,oj->noi", spread, coefficients)
        eta = eta + 0.5 * np.einsum("oi,noi->no", coefficients, s)
        moved = moved + s
    with np.errstate(over="ignore", invalid="ignore"):
        rate = np.exp(eta) * w[:, None]
        value = (w[:, None] * y * (x @ coefficients.T + bias) - rate).sum(0)
    one = np.concatenate([moved, np.ones((*moved.shape[:-1], 1))], -1)
    gradient = np.concatenate([np.einsum("no,np->op", w[:, None] * y, x), (w[:, None] * y).sum(0)[:, None]], 1) - np.einsum("no,nop->op", rate, one)
    hessian = -np.einsum("no,nop,noq->opq", rate, one, one)
    if spread is not None:
        hessian[:, :p, :p] -= np.einsum("no,nij->oij", rate, spread)
    return value, gradient, hessian


def newton(start: np.ndarray, measure, steps: int = 20, tolerance: float = 1e-8) -> np.ndarray:
    """Maximises separate objectives of each output by Newton steps, halved until none falls.

    ``measure`` gives (value (O,), gradient (O, P), Hessian (O, P, P)) at parameters (O, P); it may be a Spark job.
    """
    now = start.copy()
    value, gradient, hessian = measure(now)
    for _ in range(steps):
        move = -np.linalg.solve(hessian - 1e-8 * np.eye(now.shape[-1]), gradient[..., None])[..., 0]
        size = np.ones(len(now))
        for _ in range(20):
            trial = measure(now + size[:, None] * move)
            bad = ~(np.isfinite(trial[0]) & (trial[0] >= value - 1e-12 * np.abs(value)))
            if not bad.any():
                break
            size[bad] /= 2
        else:
            size[bad] = 0.0
            trial = measure(now + size[:, None] * move)
        now = now + size[:, None] * move
        value, gradient, hessian = trial
        if np.abs(size[:, None] * move).max() <= tolerance * (1 + np.abs(now).max()):
            break
    return now
