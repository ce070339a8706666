"""Matching of states and alignment of coordinates (driver side; sizes are those of models)."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

from driftline.functions.ascent import coordinate_ascent
from driftline.functions.dists import Affine


def match_permutation(costs: np.ndarray) -> np.ndarray:
    """p with the least sum of costs[i, p[i]]; the first in lexicographic order of equal ones."""
    costs = np.asarray(costs, float)
    best, out = np.inf, None
    for p in itertools.permutations(range(len(costs))):
        total = costs[np.arange(len(costs)), list(p)].sum()
        if total < best:
            best, out = total, p
    return np.array(out, int)


def match_by_mean(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each target state, the source state to put there, by the distance of means (K, D)."""
    return match_permutation(np.linalg.norm(target[:, None] - source[None], axis=-1))


def match_by_conditional_mean(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each target state, the source state to put there, by the squared distance of means (T, K, D) averaged over steps."""
    return match_permutation(((target[:, :, None] - source[:, None]) ** 2).sum(-1).mean(0))


def match_to_truth(occurrence: np.ndarray) -> np.ndarray:
    """For each true state, the inferred state that meets it most; ``occurrence`` (inferred, true)."""
    return match_permutation(-np.asarray(occurrence, float).T)


def best_permutation(objective: Callable[[np.ndarray], float], size: int) -> np.ndarray:
    """Exhaustive maximum."""
    best, out = -np.inf, None
    for p in itertools.permutations(range(size)):
        value = objective(np.array(p))
        if value > best:
            best, out = value, np.array(p)
    return out


def improve_permutation(objective: Callable[[np.ndarray], float], start: np.ndarray) -> tuple[np.ndarray, float]:
    """Best swaps until none helps."""
    now, value = np.array(start), objective(np.array(start))
    while True:
        options = []
        for i, j in itertools.combinations(range(len(now)), 2):
            p = now.copy()
            p[[i, j]] = p[[j, i]]
            options.append((objective(p), i, j, p))
        better = max(options, key=lambda o: (o[0], -o[1], -o[2]), default=None)
        if better is None or better[0] <= value:
            return now, value
        value, now = better[0], better[3]


def random_permutation(objective: Callable[[np.ndarray], float], start: np.ndarray, seed: int = 0, restarts: int = 16) -> np.ndarray:
    """Best-swap ascent from ``start`` and random restarts."""
    rng = np.random.default_rng(seed)
    found = [improve_permutation(objective, start)] + [improve_permutation(objective, rng.permutation(len(start))) for _ in range(restarts)]
    return max(found, key=lambda f: f[1])[0]


def affine_map(source: np.ndarray, target: np.ndarray) -> Affine:
    """Least-squares map of (N, D) onto (N, E)."""
    s, t = source.mean(0), target.mean(0)
    w = np.linalg.lstsq(source - s, target - t, rcond=None)[0].T
    return Affine(w, t - w @ s)


def procrustes(source: np.ndarray, target: np.ndarray, scaled: bool = True) -> Affine:
    """Rotation or reflection, with a scale and a shift, that maps source onto target best."""
    s, t = source.mean(0), target.mean(0)
    u, values, v = np.linalg.svd((target - t).T @ (source - s))
    w = u @ v
    if scaled:
        w = w * (values.sum() / max(((source - s) ** 2).sum(), np.finfo(float).tiny))
    return Affine(w, t - w @ s)


def orthogonal(source: np.ndarray, target: np.ndarray) -> Affine:
    """Rotation or reflection alone, about the origin."""
    u, _, v = np.linalg.svd(target.T @ source)
    return Affine(u @ v, np.zeros(len(u)))


def lda_directions(n: np.ndarray, means: np.ndarray, second: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(directions (D, C), pooled mean) of classes with counts (C,), means (C, D) and sums of outer products (C, D, D)."""
    if (np.asarray(n) <= 0).any():
        raise ValueError("a label has no rows")
    total = n.sum()
    pooled = (n[:, None] * means).sum(0) / total
    within = (second - n[:, None, None] * means[:, :, None] * means[:, None, :]).sum(0) / total
    between = np.einsum("c,ci,cj->ij", n, means - pooled, means - pooled) / total
    d = len(pooled)
    lower = np.linalg.cholesky(within + ridge * np.trace(within) / d * np.eye(d))
    half = np.linalg.solve(lower, np.linalg.solve(lower, between).T)
    values, vectors = np.linalg.eigh((half + half.T) / 2)
    order = np.argsort(values)[::-1][: min(d, len(n) - 1)]
    out = np.linalg.solve(lower.T, vectors[:, order])
    signs = np.sign(out[np.abs(out).argmax(0), np.arange(len(order))])
    return out * np.where(signs == 0, 1, signs), pooled


def zscore_map(mean: np.ndarray, variance: np.ndarray) -> Affine:
    scale = 1 / np.sqrt(np.where(variance > 0, variance, 1.0))
    return Affine(np.diag(scale), -scale * mean)


def sign_match(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Signs of source's columns that bring them closest to target's."""
    s = np.sign((source * target).sum(0))
    return np.where(s == 0, 1.0, s)


def signed_permutation(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, signs): target column i is close to signs[i] * source column order[i]."""
    dots = target.T @ source
    order = match_permutation(-np.abs(dots))
    signs = np.sign(dots[np.arange(len(order)), order])
    return order, np.where(signs == 0, 1.0, signs)


def statewise_signed_permutation(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(orders (K, P), signs (K, P)) of motifs (K, P, ...), matched within each state up to order and sign."""
    if source.shape != target.shape or source.ndim < 3:
        raise ValueError("motifs of both sides have one shape (K, P, ...)")
    found = [signed_permutation(s.reshape(len(s), -1).T, t.reshape(len(t), -1).T) for s, t in zip(source, target, strict=True)]
    return np.array([o for o, _ in found]), np.array([g for _, g in found])


def align_markov_counts(initial: np.ndarray, transitions: np.ndarray, max_sweeps: int = 50, seed: int = 0, restarts: int = 10) -> np.ndarray:
    """A permutation for each session that makes pooled Markov counts most likely; the session with most counts stays.

    ``initial`` (S, K), ``transitions`` (S, K, K). Sweeps re-match one session at a time against the others' pool.
    """
    s, k = initial.shape
    total = transitions.sum((1, 2)) + initial.sum(1)
    anchor = int(np.argmax(total))

    def permuted(x: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return initial[x][p], transitions[x][np.ix_(p, p)]

    def score(state: tuple) -> float:
        i, t = state[1] + 1e-8, state[2] + 1e-8
        return float((i * np.log(i / i.sum())).sum() + (t * np.log(t / t.sum(-1, keepdims=True))).sum())

    def put(state: tuple, x: int, p: np.ndarray) -> tuple:
        """The pools with one session's counts moved; the other sessions aren't added up again."""
        perms, i, t = state
        old, new = permuted(x, perms[x]), permuted(x, p)
        moved = perms.copy()
        moved[x] = p
        return moved, i - old[0] + new[0], t - old[1] + new[1]

    def propose(rng: np.random.Generator, objective: Callable[[np.ndarray], float], now: np.ndarray) -> np.ndarray:
        return best_permutation(objective, k) if k <= 6 else random_permutation(objective, now, int(rng.integers(1 << 31)), restarts)

    state = (np.tile(np.arange(k), (s, 1)), initial.sum(0), transitions.sum(0))
    active = [x != anchor and total[x] > 0 for x in range(s)]
    return coordinate_ascent(state, s, score, lambda state, x: state[0][x], put, propose, active, max_sweeps, seed)[0][0]
