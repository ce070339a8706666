"""Gaussian priors over latent curves: random walks, gated random walks and zero-mean cubic Hermite curves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from driftline.operators import chains


@dataclass(frozen=True)
class RandomWalk:
    """x_0 ~ N(0, initial), x_t = x_t-1 + N(0, innovation)."""

    initial: np.ndarray
    innovation: np.ndarray

    def sample(self, rng: np.random.Generator, steps: int) -> np.ndarray:
        d = len(self.initial)
        moves = rng.standard_normal((steps, d)) @ np.linalg.cholesky(self.innovation).T
        moves[0] = rng.standard_normal(d) @ np.linalg.cholesky(self.initial).T
        return moves.cumsum(0)

    def factors(self, lengths: np.ndarray) -> chains.GaussianFactors:
        t, d, b = int(np.max(lengths)), len(self.initial), len(lengths)
        eye = np.broadcast_to(np.eye(d), (b, max(t - 1, 0), d, d))
        return chains.linear_factors(np.zeros(d), self.initial, eye, np.zeros((b, max(t - 1, 0), d)), np.broadcast_to(self.innovation, eye.shape), t, np.asarray(lengths))


@dataclass(frozen=True)
class GatedRandomWalk:
    """A random walk whose innovation covariance (K, D, D) is chosen by a gate at every step."""

    initial: np.ndarray
    innovations: np.ndarray

    def sample(self, rng: np.random.Generator, gates: np.ndarray) -> np.ndarray:
        d = len(self.initial)
        roots = np.linalg.cholesky(self.innovations)[np.asarray(gates)]
        moves = np.einsum("tij,tj->ti", roots, rng.standard_normal((len(gates), d)))
        moves[0] = rng.standard_normal(d) @ np.linalg.cholesky(self.initial).T
        return moves.cumsum(0)

    def factors(self, gates: np.ndarray, lengths: np.ndarray) -> chains.GaussianFactors:
        """``gates`` (B, T); gate t rules the move into step t."""
        b, t = gates.shape
        d = len(self.initial)
        eye = np.broadcast_to(np.eye(d), (b, max(t - 1, 0), d, d))
        return chains.linear_factors(np.zeros(d), self.initial, eye, np.zeros((b, max(t - 1, 0), d)), self.innovations[gates[:, 1:]], t, np.asarray(lengths))

    def soft_factors(self, weights: np.ndarray, lengths: np.ndarray) -> chains.GaussianFactors:
        """Log factors averaged over gates of probabilities ``weights`` (B, T, K); gate t rules the move into step t."""
        b, t, _ = weights.shape
        d = len(self.initial)
        lengths = np.asarray(lengths)
        pair = chains.valid(lengths, t)[:, 1:]
        w = weights[:, 1:] * pair[..., None]
        p = np.einsum("btk,kij->btij", w, np.linalg.inv(self.innovations))
        diag, first = np.zeros((b, t, d, d)), lengths > 0
        diag[:, 0] += np.linalg.inv(self.initial)
        diag[:, 1:] += p
        diag[:, :-1] += p
        const = -0.5 * first * (np.linalg.slogdet(self.initial)[1] + d * chains.LOG_2PI) - 0.5 * (w @ (np.linalg.slogdet(self.innovations)[1] + d * chains.LOG_2PI)).sum(1)
        return chains.GaussianFactors(diag, -p, np.zeros((b, t, d)), const, lengths)

    def expected_gate_log_probs(self, posterior: chains.GaussianPosterior) -> np.ndarray:
        """(B, T-1, K) expected log density of each move under each gate; 0 beyond a sequence."""
        move = posterior.mean[:, 1:] - posterior.mean[:, :-1]
        second = posterior.cov[:, 1:] + posterior.cov[:, :-1] - posterior.cross - chains.transpose(posterior.cross) + move[..., :, None] * move[..., None, :]
        unit = np.linalg.slogdet(self.innovations)[1] + len(self.initial) * chains.LOG_2PI
        out = -0.5 * (np.einsum("kij,btji->btk", np.linalg.inv(self.innovations), second) + unit)
        return np.where(chains.valid(posterior.lengths - 1, move.shape[1])[..., None], out, 0.0)

    def expected_gate_log_difference(self, posterior: chains.GaussianPosterior, active: int = 1, inactive: int = 0) -> np.ndarray:
        """(B, T-1) expected log factor of the active gate less that of the inactive one."""
        each = self.expected_gate_log_probs(posterior)
        return each[..., active] - each[..., inactive]

    def permute_gates(self, order: np.ndarray) -> GatedRandomWalk:
        return GatedRandomWalk(self.initial, self.innovations[np.asarray(order)])


@dataclass(frozen=True)
class HermiteBasis:
    """Cubic Hermite curves on [0, 1] with ``knots`` knots (value and slope at each), constrained to a zero integral."""

    knots: int

    def raw(self, at: np.ndarray, derivative: int = 0) -> np.ndarray:
        """(N, 2 * knots) values, or second derivatives, of the unconstrained basis."""
        h = 1 / (self.knots - 1)
        cell = np.clip((np.asarray(at) / h).astype(int), 0, self.knots - 2)
        s = np.asarray(at) / h - cell
        if derivative == 0:
            parts = [2 * s**3 - 3 * s**2 + 1, h * (s**3 - 2 * s**2 + s), -2 * s**3 + 3 * s**2, h * (s**3 - s**2)]
        elif derivative == 2:
            parts = [(12 * s - 6) / h**2, (6 * s - 4) / h, (6 - 12 * s) / h**2, (6 * s - 2) / h]
        else:
            raise ValueError(derivative)
        out = np.zeros((len(s), 2 * self.knots))
        for k, p in enumerate(parts):
            out[np.arange(len(s)), 2 * cell + k] = p
        return out

    def quadrature(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and weights that are exact for products of two cubics: four Gauss points a cell."""
        x, w = np.polynomial.legendre.leggauss(4)
        h = 1 / (self.knots - 1)
        left = np.arange(self.knots - 1) * h
        return (left[:, None] + (x + 1) / 2 * h).ravel(), np.tile(w / 2 * h, self.knots - 1)

    def coefficient_map(self) -> np.ndarray:
        """(2 * knots, 2 * knots - 1) orthonormal columns that span the coefficients of zero integral."""
        nodes, weights = self.quadrature()
        return np.linalg.svd((weights @ self.raw(nodes))[None])[2][1:].T

    def penalties(self) -> tuple[np.ndarray, np.ndarray]:
        """Gram matrices of values and of second derivatives in the constrained coefficients."""
        nodes, weights = self.quadrature()
        m = self.coefficient_map()
        a, c = self.raw(nodes) @ m, self.raw(nodes, 2) @ m
        return a.T @ (weights[:, None] * a), c.T @ (weights[:, None] * c)

    def values(self, steps: int) -> np.ndarray:
        """(steps, 2 * knots - 1) centred basis on a regular grid."""
        return self.raw(np.linspace(0, 1, steps)) @ self.coefficient_map()


@dataclass(frozen=True)
class HermiteCurves:
    """A Gaussian over curves: coefficients (P, D) with one covariance (P, P) for each of D variables."""

    basis: HermiteBasis
    mean: np.ndarray
    covariance: np.ndarray

    @staticmethod
    def prior(knots: int, variables: int, amplitude: float, smoothness: float) -> HermiteCurves:
        basis = HermiteBasis(knots)
        values, bends = basis.penalties()
        cov = np.linalg.inv(amplitude * values + smoothness * bends)
        return HermiteCurves(basis, np.zeros((len(cov), variables)), np.repeat(cov[None], variables, 0))

    def marginals(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(steps, D) means and variances."""
        b = self.basis.values(steps)
        return b @ self.mean, np.einsum("tp,dpq,tq->td", b, self.covariance, b)

    def sample(self, rng: np.random.Generator, steps: int) -> np.ndarray:
        noise = np.einsum("dpq,qd->pd", np.linalg.cholesky(self.covariance), rng.standard_normal(self.mean.shape))
        return self.basis.values(steps) @ (self.mean + noise)

    def potential(self, precision: np.ndarray, information: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Local Gaussian factors (T, D, D) and (T, D) as one over all coefficients, variable by variable."""
        b = self.basis.values(len(information))
        n = b.shape[1] * information.shape[1]
        return np.einsum("tp,tij,tq->ipjq", b, precision, b).reshape(n, n), np.einsum("tp,ti->ip", b, information).ravel()

    def infer(self, precision: np.ndarray, information: np.ndarray) -> CurvePosterior:
        """Posterior of the coefficients given local factors -x'Jx/2 + h'x of every step; no step leaves the prior."""
        p, d = self.mean.shape
        prior = np.zeros((d, p, d, p))
        for i in range(d):
            prior[i, :, i] = np.linalg.inv(self.covariance[i])
        prior = prior.reshape(d * p, d * p)
        j, h = prior, prior @ self.mean.T.ravel()
        if len(information):
            more = self.potential(precision, information)
            j, h = j + more[0], h + more[1]
        cov = chains.symmetric(np.linalg.inv(chains.symmetric(j)))
        return CurvePosterior(self.basis, (cov @ h).reshape(d, p).T, cov.reshape(d, p, d, p))


@dataclass(frozen=True)
class CurvePosterior:
    """Coefficients (P, D) with their joint covariance (D, P, D, P)."""

    basis: HermiteBasis
    mean: np.ndarray
    covariance: np.ndarray

    def marginals(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(steps, D) means and (steps, D, D) covariances."""
        b = self.basis.values(steps)
        return b @ self.mean, np.einsum("tp,ipjq,tq->tij", b, self.covariance, b)
