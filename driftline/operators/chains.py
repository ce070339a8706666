"""Chain inference in NumPy, vectorised over a batch of right-padded sequences.

Shapes: B sequences, T steps of storage, K states, D coordinates. ``lengths`` (B,) says how many steps count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

TINY = np.finfo(float).tiny
LOG_2PI = float(np.log(2 * np.pi))


def valid(lengths: np.ndarray, steps: int) -> np.ndarray:
    """(B, T) whether a step counts."""
    return np.arange(steps)[None, :] < np.asarray(lengths)[:, None]


def transpose(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def symmetric(x: np.ndarray) -> np.ndarray:
    return (x + transpose(x)) / 2


def inverted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses and log determinants of symmetric matrices (..., D, D)."""
    out, logdet = _inverted(np.moveaxis(x, (-2, -1), (0, 1)))
    return np.moveaxis(out, (0, 1), (-2, -1)), logdet


def _inverted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of symmetric matrices (D, D, ...); positive ones of up to two coordinates in closed form."""
    d, first = len(x), x[0, 0]
    if d == 1 and (first > 0).all():
        return 1 / x, np.log(first)
    if d == 2 and (first > 0).all():
        ratio = x[0, 1] / first
        rest = x[1, 1] - ratio * x[0, 1]
        if (rest > 0).all():
            out = np.empty(x.shape)
            out[1, 1] = 1 / rest
            out[0, 1] = out[1, 0] = cross = -ratio * out[1, 1]
            out[0, 0] = 1 / first - ratio * cross
            return out, np.log(first * rest)
    x = np.moveaxis(x, (0, 1), (-2, -1))
    return np.moveaxis(symmetric(np.linalg.inv(x)), (-2, -1), (0, 1)), np.linalg.slogdet(x)[1]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices (I, J, B) with matrices (J, K, B) or vectors (J, B)."""
    wide = b.ndim == 3
    out = a[:, 0, None] * b[0] if wide else a[:, 0] * b[0]
    for j in range(1, len(b)):
        out += a[:, j, None] * b[j] if wide else a[:, j] * b[j]
    return out


@dataclass
class DiscretePosterior:
    """gamma (B, T, K), xi (B, T-1, K, K), filtered (B, T, K), log_normalizer (B,); zero beyond each length.

    A block of time (:func:`discrete_block`) has one pair more, with the step behind it, where there is one.
    """

    gamma: np.ndarray
    xi: np.ndarray
    filtered: np.ndarray
    log_normalizer: np.ndarray
    lengths: np.ndarray
    more: np.ndarray | None = None

    def pairs(self) -> np.ndarray:
        """(B,) number of pairs of steps."""
        return np.maximum(self.lengths - 1, 0) if self.more is None else self.lengths - 1 + self.more

    def entropy(self) -> np.ndarray:
        """(B,) entropy of the whole path."""
        first = -_xlogx(self.gamma[:, 0]).sum(-1) * (self.lengths > 0)
        pairs = -_xlogx(self.xi).sum((1, 2, 3))
        inner = valid(self.lengths - 1, self.gamma.shape[1])
        inner[:, 0] = False  # the first step stands in the first term already
        return first + pairs + (_xlogx(self.gamma).sum(-1) * inner).sum(1) + _xlogx(self.gamma[:, 0]).sum(-1) * (self.lengths > 1)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)


def discrete_chain(initial: np.ndarray, transition: np.ndarray, local: np.ndarray, lengths: np.ndarray) -> DiscretePosterior:
    """Forward-backward over ``local`` log factors (B, T, K); ``transition`` is (K, K) or (B, T-1, K, K), ``initial`` (K,) or (B, K)."""
    return _forward_backward(initial, transition, local, lengths)[0]


def discrete_block(before: np.ndarray, transition: np.ndarray, local: np.ndarray, lengths: np.ndarray, ahead: np.ndarray) -> DiscretePosterior:
    """Forward-backward over blocks of time of longer sequences: ``before`` (B, K) are state probabilities of each first step given all
    steps before it, ``ahead`` (B, K) log weights of the states of the step behind, or NaN at the end of a sequence.

    The normalizer is that of the block's own steps given all before them, so those of a sequence's blocks add up.
    """
    b, t, k = local.shape
    lengths, more = np.asarray(lengths), ~np.isnan(ahead).all(1)
    longer = np.concatenate([local, np.zeros((b, 1, k))], 1)
    longer[np.flatnonzero(more), lengths[more]] = ahead[more]
    post, score = _forward_backward(before, transition, longer, lengths + more)
    own = valid(lengths, t)
    return DiscretePosterior(np.where(own[..., None], post.gamma[:, :t], 0.0), post.xi, post.filtered[:, :t], (score[:, :t] * own).sum(1), lengths, more)


def _log_sum(x: np.ndarray, axis: int = 0) -> np.ndarray:
    """log sum exp over an axis; -inf where all are."""
    top = x.max(axis)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis)) + top


def _forward_backward(initial: np.ndarray, transition: np.ndarray, local: np.ndarray, lengths: np.ndarray) -> tuple[DiscretePosterior, np.ndarray]:
    """The posterior, and the log probability (B, T) of each step given those before it."""
    b, t, k = local.shape
    lengths = np.asarray(lengths)
    on = np.ascontiguousarray(valid(lengths, t).T)
    with np.errstate(divide="ignore"):
        move = np.log(transition)
        prior = np.broadcast_to(np.log(initial), (b, k)).T
    # Sequences come last, so that every step works on whole runs of them: (T, K, B), and moves (T-1, K, K, B or 1).
    move = np.ascontiguousarray(np.moveaxis(move, 0, -1)) if move.ndim == 4 else np.broadcast_to(move[..., None], (max(t - 1, 0), k, k, 1))
    local = np.ascontiguousarray(np.moveaxis(local, 0, -1))
    # Everything is kept as logarithms: the only states that are possible may be less likely than any float by far.
    filtered, score = np.full((t, k, b), -np.inf), np.zeros((t, b))
    for i in range(t):
        if i:
            prior = _log_sum(filtered[i - 1, :, None] + move[i - 1])
        joint = prior + local[i]
        total = _log_sum(joint)
        total = np.where(np.isfinite(total), total, np.log(TINY))
        filtered[i] = np.where(on[i], joint - total, -np.inf)
        score[i] = np.where(on[i], total, 0.0)
    back, xi = np.zeros((t, k, b)), np.zeros((max(t - 1, 0), k, k, b))
    for i in range(t - 2, -1, -1):
        ahead = move[i] + (local[i + 1] + back[i + 1] - score[i + 1])
        xi[i] = np.where(on[i + 1], np.exp(filtered[i, :, None] + ahead), 0.0)
        back[i] = np.where(on[i + 1], _log_sum(np.swapaxes(ahead, 0, 1)), 0.0)
    gamma, filtered = np.exp(filtered + back), np.exp(filtered)
    if t:
        gamma = np.where(on[:, None], gamma / np.maximum(gamma.sum(1, keepdims=True), TINY), 0.0)
    gamma, filtered, xi, score = (np.ascontiguousarray(np.moveaxis(x, -1, 0)) for x in (gamma, filtered, xi, score))
    return DiscretePosterior(gamma, xi, filtered, score.sum(1), lengths), score


@dataclass
class GaussianPosterior:
    """mean (B, T, D), cov (B, T, D, D), cross (B, T-1, D, D) = Cov(x_t, x_t+1), log_normalizer (B,)."""

    mean: np.ndarray
    cov: np.ndarray
    cross: np.ndarray
    log_normalizer: np.ndarray
    lengths: np.ndarray

    def second(self) -> np.ndarray:
        """E[x x'] of every step."""
        return self.cov + self.mean[..., :, None] * self.mean[..., None, :]

    def lagged(self) -> np.ndarray:
        """E[x_t x_t+1']."""
        return self.cross + self.mean[:, :-1, :, None] * self.mean[:, 1:, None, :]

    def entropy(self) -> np.ndarray:
        """(B,) entropy of the whole path."""
        d = self.mean.shape[-1]
        unit = d * (1 + LOG_2PI)
        inverse, logdet = inverted(self.cov)
        out = np.where(self.lengths > 0, unit + logdet[:, 0], 0.0)
        if self.mean.shape[1] > 1:
            on = valid(self.lengths - 1, self.cross.shape[1])
            inner = symmetric(self.cov[:, 1:] - transpose(self.cross) @ (inverse[:, :-1] @ self.cross))
            inner = np.where(on[..., None, None], inner, np.eye(d))
            out = out + np.where(on, unit + inverted(inner)[1], 0.0).sum(1)
        return out / 2


@dataclass
class GaussianFactors:
    """Block-tridiagonal log factors: -x'Jx/2 + h'x + c, with ``lower`` = J[t+1, t]."""

    diag: np.ndarray
    lower: np.ndarray
    info: np.ndarray
    const: np.ndarray
    lengths: np.ndarray

    def value(self, x: np.ndarray) -> np.ndarray:
        """(B,) log factor at the path ``x``."""
        on = valid(self.lengths, x.shape[1])
        own = (x * (self.info - 0.5 * (self.diag @ x[..., None])[..., 0])).sum(-1)
        pair = -(x[:, 1:] * (self.lower @ x[:, :-1, :, None])[..., 0]).sum(-1)
        return (own * on).sum(1) + (pair * valid(self.lengths - 1, pair.shape[1])).sum(1) + self.const

    def of(self, rows: np.ndarray) -> GaussianFactors:
        """The factors of some sequences."""
        return GaussianFactors(self.diag[rows], self.lower[rows], self.info[rows], self.const[rows], np.asarray(self.lengths)[rows])

    def dense_precision(self, sequence: int) -> np.ndarray:
        """The precision (T * D, T * D) of one sequence as a whole."""
        n, d = int(self.lengths[sequence]), self.info.shape[-1]
        out = np.zeros((n, d, n, d))
        for t in range(n):
            out[t, :, t] = self.diag[sequence, t]
            if t + 1 < n:
                out[t + 1, :, t] = self.lower[sequence, t]
                out[t, :, t + 1] = self.lower[sequence, t].T
        return out.reshape(n * d, n * d)


def gaussian_chain(f: GaussianFactors) -> GaussianPosterior:
    """Block elimination forward, moments backward."""
    b, t, d = f.info.shape
    on = valid(f.lengths, t)
    eye = np.eye(d)
    # Sequences come last, so that every step works on whole runs of them.
    diag, lower, info = (np.ascontiguousarray(np.moveaxis(x, 0, -1)) for x in (np.where(on[..., None, None], f.diag, eye), np.where(on[:, 1:, None, None], f.lower, 0.0), np.where(on[..., None], f.info, 0.0)))
    inverse, offset, gain, logdet = np.zeros((t, d, d, b)), np.zeros((t, d, b)), np.zeros((max(t - 1, 0), d, d, b)), np.zeros((t, b))
    now, h = diag[0] if t else None, info[0] if t else None
    for i in range(t):
        inverse[i], logdet[i] = _inverted(now)
        offset[i] = _times(inverse[i], h)
        if i + 1 < t:
            gain[i] = -_times(inverse[i], np.swapaxes(lower[i], 0, 1))
            now = diag[i + 1] + _times(lower[i], gain[i])
            now = (now + np.swapaxes(now, 0, 1)) / 2
            h = info[i + 1] - _times(lower[i], offset[i])
    mean, cov, cross = offset.copy(), inverse.copy(), np.zeros_like(gain)
    for i in range(t - 2, -1, -1):
        mean[i] += _times(gain[i], mean[i + 1])
        cross[i] = _times(gain[i], cov[i + 1])
        now = inverse[i] + _times(cross[i], np.swapaxes(gain[i], 0, 1))
        cov[i] = (now + np.swapaxes(now, 0, 1)) / 2
    info, mean, cov, cross = (np.ascontiguousarray(np.moveaxis(x, -1, 0)) for x in (info, mean, cov, cross))
    total = f.const + 0.5 * (info * mean).sum((1, 2)) - 0.5 * (logdet.T * on).sum(1) + 0.5 * f.lengths * d * LOG_2PI
    mean = np.where(on[..., None], mean, 0.0)
    cov = np.where(on[..., None, None], cov, eye)
    return GaussianPosterior(mean, cov, np.where(on[:, 1:, None, None], cross, 0.0), total, f.lengths)


def linear_factors(mean0: np.ndarray, cov0: np.ndarray, a: np.ndarray, bias: np.ndarray, q: np.ndarray, steps: int, lengths: np.ndarray, begins: np.ndarray | None = None) -> GaussianFactors:
    """Prior chain x_0 ~ N(mean0, cov0), x_t ~ N(a x_t-1 + bias_t, q); ``a`` (B, T-1, D, D), ``bias`` (B, T-1, D), ``q`` likewise.

    ``begins`` (B,) says which rows begin a sequence; others are blocks of time and have no initial factor.
    """
    b, d = len(lengths), mean0.shape[-1]
    diag, info, const = np.zeros((b, steps, d, d)), np.zeros((b, steps, d)), np.zeros(b)
    on = valid(lengths, steps)
    p0 = np.linalg.inv(cov0)
    some = np.asarray(lengths) > 0
    if begins is not None:
        some = some & begins
    diag[:, 0] += p0 if begins is None else p0 * begins[:, None, None]
    info[:, 0] += p0 @ mean0 if begins is None else (p0 @ mean0) * begins[:, None]
    const += np.where(some, -0.5 * (mean0 @ p0 @ mean0 + np.linalg.slogdet(cov0)[1] + d * LOG_2PI), 0.0)
    if steps < 2:
        return GaussianFactors(diag, np.zeros((b, 0, d, d)), info, const, lengths)
    p = np.linalg.inv(q)
    pair = on[:, 1:].astype(float)
    pa = p @ a
    diag[:, :-1] += transpose(a) @ pa * pair[..., None, None]
    diag[:, 1:] += p * pair[..., None, None]
    pb = np.einsum("...ij,...j->...i", p, bias)
    info[:, :-1] -= np.einsum("btji,btj->bti", np.broadcast_to(a, diag[:, 1:].shape), np.broadcast_to(pb, info[:, 1:].shape)) * pair[..., None]
    info[:, 1:] += pb * pair[..., None]
    const += (-0.5 * (np.einsum("...i,...i->...", bias, pb) + np.linalg.slogdet(q)[1] + d * LOG_2PI) * pair).sum(1)
    return GaussianFactors(diag, -np.broadcast_to(pa, diag[:, 1:].shape), info, const, lengths)


def add_gaussian_emissions(f: GaussianFactors, y: np.ndarray, weight: np.ndarray, c: np.ndarray, d: np.ndarray, r: np.ndarray) -> GaussianFactors:
    """Adds log N(y; C x + d, R) of the visible steps."""
    p = np.linalg.inv(r)
    e = np.where(weight[..., None] > 0, y - d, 0.0)
    pe = e @ p
    const = -0.5 * weight * (np.einsum("bti,bti->bt", e, pe) + np.linalg.slogdet(r)[1] + len(d) * LOG_2PI)
    return GaussianFactors(f.diag + weight[..., None, None] * (c.T @ p @ c), f.lower, f.info + weight[..., None] * (pe @ c), f.const + const.sum(1), f.lengths)


def laplace_chain(prior: GaussianFactors, y: np.ndarray, weight: np.ndarray, c: np.ndarray, d: np.ndarray, likelihood, start: np.ndarray | None = None, max_steps: int = 50, tolerance: float = 1e-6) -> tuple[GaussianPosterior, np.ndarray]:
    """Posterior of a chain with a ``likelihood`` of C x + d at its mode, by Newton steps that are halved until the objective doesn't fall.

    Returns the posterior, whose log_normalizer is that of the quadratic model at the mode, and the mode. Steps are done where no
    coordinate moves further than ``tolerance`` of its size.
    """
    x = np.zeros_like(prior.info) if start is None else start.copy()
    outer = (c[:, :, None] * c[:, None, :]).reshape(len(c), -1)

    def terms(own: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = weight[own][..., None] > 0
        return tuple(np.where(seen, v, 0.0) for v in likelihood.terms(y[own], z @ c.T + d))

    def objective(own: np.ndarray, chain: GaussianFactors, z: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return chain.value(z) + terms(own, z)[0].sum((1, 2))

    def quadratic(own: np.ndarray, chain: GaussianFactors, z: np.ndarray) -> GaussianPosterior:
        value, slope, curve = terms(own, z)
        value, slope, curve = value.sum((1, 2)), slope @ c, (curve @ outer).reshape(chain.diag.shape)
        pull = (curve @ z[..., None])[..., 0]
        const = value - (slope * z).sum((1, 2)) - 0.5 * (z * pull).sum((1, 2))
        return gaussian_chain(GaussianFactors(chain.diag + curve, chain.lower, chain.info + slope + pull, chain.const + const, chain.lengths))

    every = np.arange(len(x))
    own, chain = every, prior  # sequences that still move: done ones cost nothing
    best = objective(own, chain, x)
    for _ in range(max_steps):
        z = x[own]
        move = quadratic(own, chain, z).mean - z
        size = np.ones(len(z))
        todo = np.ones(len(z), bool)
        for _ in range(30):
            trial = objective(own, chain, z + size[:, None, None] * move)
            todo = ~(np.isfinite(trial) & (trial >= best - 1e-12 * np.abs(best)))
            if not todo.any():
                break
            size[todo] /= 2
        if todo.any():
            size[todo] = 0.0
            trial = objective(own, chain, z + size[:, None, None] * move)
        x[own] = z + size[:, None, None] * move
        best = trial
        change = np.sqrt(((size[:, None, None] * move) ** 2).sum((1, 2))) / (1 + np.sqrt((x[own] ** 2).sum((1, 2))))
        moving = change > tolerance
        if not moving.any():
            break
        if not moving.all():
            own, best, chain = own[moving], best[moving], chain.of(moving)
    return quadratic(every, prior, x), x


@dataclass
class SwitchingPosterior:
    """q(z) q(x) with its lower bound (B,), and the bound after every round (B, rounds)."""

    states: DiscretePosterior
    latents: GaussianPosterior
    bound: np.ndarray
    trace: np.ndarray


def switching_chain(initial: np.ndarray, transition: np.ndarray, mean0: np.ndarray, cov0: np.ndarray, a: np.ndarray, bias: np.ndarray, q: np.ndarray, lengths: np.ndarray, steps: int, emit: Callable[[GaussianFactors, GaussianPosterior | None], tuple[GaussianPosterior, Callable[[GaussianPosterior], np.ndarray]]], iterations: int = 10, start: np.ndarray | None = None) -> SwitchingPosterior:
    """Mean field over states and latents. ``a`` (K, D, D), ``bias`` (B, T-1, K, D), ``q`` (K, D, D), ``mean0`` (K, D).

    ``emit`` gets the averaged prior and the posterior so far and returns the latent posterior with emissions, and the
    expected emission log probability (B,) of a posterior.
    """
    b, k, d = len(lengths), len(initial), mean0.shape[-1]
    on = valid(lengths, steps)
    weight = np.broadcast_to(initial, (b, steps, k)).copy() if start is None else start
    firsts = [linear_factors(mean0[j], cov0[j], np.zeros((b, 0, d, d)), np.zeros((b, 0, d)), np.zeros((b, 0, d, d)), 1, np.minimum(lengths, 1)) for j in range(k)]
    latents, states, bounds = None, None, []
    for _ in range(max(1, iterations)):
        prior = _mixed(firsts, weight, a, bias, q, on, lengths)
        latents, score = emit(prior, latents)
        local = _expected_steps(latents, mean0, cov0, a, bias, q) * on[..., None]
        states = discrete_chain(initial, transition, local, lengths)
        weight = states.gamma
        inner = (states.gamma * local).sum((1, 2))
        log_p = (states.gamma[:, 0] * np.log(np.maximum(initial, TINY))).sum(-1) * (lengths > 0) + (states.xi * np.log(np.maximum(transition, TINY))).sum((1, 2, 3))
        bounds.append(log_p + inner + score(latents) + states.entropy() + latents.entropy())
    return SwitchingPosterior(states, latents, bounds[-1], np.stack(bounds, 1))


def _mixed(firsts: list[GaussianFactors], weight: np.ndarray, a: np.ndarray, bias: np.ndarray, q: np.ndarray, on: np.ndarray, lengths: np.ndarray) -> GaussianFactors:
    """State-averaged prior: the first step weighs the initial factors, step t the dynamics into t."""
    b, t, _ = weight.shape
    d = a.shape[-1]
    diag, lower, info = np.zeros((b, t, d, d)), np.zeros((b, max(t - 1, 0), d, d)), np.zeros((b, t, d))
    const = np.zeros(b)
    for j, first in enumerate(firsts):
        w0, w = weight[:, 0, j], weight[:, 1:, j] * on[:, 1:]
        p = np.linalg.inv(q[j])
        diag[:, 0] += w0[:, None, None] * first.diag[:, 0]
        info[:, 0] += w0[:, None] * first.info[:, 0]
        pb = bias[:, :, j] @ p
        diag[:, :-1] += w[..., None, None] * (a[j].T @ p @ a[j])
        diag[:, 1:] += w[..., None, None] * p
        lower -= w[..., None, None] * (p @ a[j])
        info[:, :-1] -= w[..., None] * (pb @ a[j])
        info[:, 1:] += w[..., None] * pb
        const += w0 * first.const + (w * -0.5 * (np.einsum("bti,bti->bt", bias[:, :, j], pb) + np.linalg.slogdet(q[j])[1] + d * LOG_2PI)).sum(1)
    return GaussianFactors(diag, lower, info, const, lengths)


def _expected_steps(x: GaussianPosterior, mean0: np.ndarray, cov0: np.ndarray, a: np.ndarray, bias: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(B, T, K) expected log density of each step's initial or dynamics factor."""
    b, t, d = x.mean.shape
    k = len(a)
    out = np.zeros((b, t, k))

    def flat(m: np.ndarray) -> np.ndarray:
        return m.reshape(*m.shape[:2], d * d)

    for j in range(k):
        p0 = np.linalg.inv(cov0[j])
        e = x.mean[:, 0] - mean0[j]
        out[:, 0, j] = -0.5 * (((e @ p0) * e).sum(-1) + np.einsum("ij,bji->b", p0, x.cov[:, 0]) + np.linalg.slogdet(cov0[j])[1] + d * LOG_2PI)
        p = np.linalg.inv(q[j])
        e = x.mean[:, 1:] - x.mean[:, :-1] @ a[j].T - bias[:, :, j]
        pa = p @ a[j]
        spread = flat(x.cov[:, 1:]) @ p.ravel() - 2 * flat(x.cross) @ pa.T.ravel() + flat(x.cov[:, :-1]) @ (a[j].T @ pa).ravel()
        out[:, 1:, j] = -0.5 * (((e @ p) * e).sum(-1) + spread + np.linalg.slogdet(q[j])[1] + d * LOG_2PI)
    return out
