"""Distributions and affine maps as small NumPy values; parameters of a K-state model have a leading axis K."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOG_2PI = float(np.log(2 * np.pi))


@dataclass(frozen=True)
class Affine:
    """x -> coefficients x + bias."""

    coefficients: np.ndarray
    bias: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coefficients.T + self.bias

    def compose(self, inner: Affine) -> Affine:
        return Affine(self.coefficients @ inner.coefficients, self.coefficients @ inner.bias + self.bias)

    def inverse(self) -> Affine:
        w = np.linalg.inv(self.coefficients)
        return Affine(w, -w @ self.bias)

    def pseudoinverse(self) -> Affine:
        w = np.linalg.pinv(self.coefficients)
        return Affine(w, -w @ self.bias)

    def shift(self, center: np.ndarray) -> Affine:
        """The map of inputs measured from ``center``."""
        return Affine(self.coefficients, self.bias + self.coefficients @ center)

    def norm(self) -> np.ndarray:
        return np.sqrt((self.coefficients**2).sum(-1))

    @staticmethod
    def reorientation(signs: np.ndarray) -> Affine:
        return Affine(np.diag(np.asarray(signs, float)), np.zeros(len(signs)))

    @staticmethod
    def permutation(order: np.ndarray) -> Affine:
        return Affine(np.eye(len(order))[np.asarray(order)], np.zeros(len(order)))

    @staticmethod
    def offset(by: np.ndarray) -> Affine:
        return Affine(np.eye(len(by)), -np.asarray(by, float))


def as_matrix(noise: np.ndarray, diagonal: bool) -> np.ndarray:
    """Covariances of variances, where ``diagonal``."""
    return noise[..., :, None] * np.eye(noise.shape[-1]) if diagonal else noise


def floored(cov: np.ndarray, floor: float, reference: np.ndarray | None = None) -> np.ndarray:
    """Symmetrised covariance plus ``floor`` times the mean variance of ``reference`` (1 where that isn't positive)."""
    reference = cov if reference is None else reference
    scale = np.trace(reference, axis1=-2, axis2=-1) / reference.shape[-1]
    scale = np.where(scale > 0, scale, 1.0)
    return (cov + np.swapaxes(cov, -1, -2)) / 2 + floor * scale[..., None, None] * np.eye(cov.shape[-1])


@dataclass(frozen=True)
class Gaussian:
    """N(mean, covariance) for every leading index; ``diagonal`` keeps variances only."""

    mean: np.ndarray
    covariance: np.ndarray
    diagonal: bool = False

    @staticmethod
    def from_canonical(precision: np.ndarray, information: np.ndarray) -> Gaussian:
        cov = np.linalg.inv((precision + np.swapaxes(precision, -1, -2)) / 2)
        return Gaussian(np.einsum("...ij,...j->...i", cov, information), cov)

    def log_prob(self, y: np.ndarray) -> np.ndarray:
        """(..., K) log densities of (..., D)."""
        e = y[..., None, :] - self.mean
        inverse, logdet = np.linalg.inv(self.covariance), np.linalg.slogdet(self.covariance)[1]
        return -0.5 * (np.einsum("...ki,kij,...kj->...k", e, inverse, e) + logdet + y.shape[-1] * LOG_2PI)

    def entropy(self) -> np.ndarray:
        return 0.5 * (self.mean.shape[-1] * (1 + LOG_2PI) + np.linalg.slogdet(self.covariance)[1])

    def kl(self, other: Gaussian) -> np.ndarray:
        p = np.linalg.inv(other.covariance)
        e = other.mean - self.mean
        return 0.5 * (np.trace(p @ self.covariance, axis1=-2, axis2=-1) + np.einsum("...i,...ij,...j->...", e, p, e) - self.mean.shape[-1] + np.linalg.slogdet(other.covariance)[1] - np.linalg.slogdet(self.covariance)[1])

    def affine(self, f: Affine) -> Gaussian:
        return Gaussian(self.mean @ f.coefficients.T + f.bias, f.coefficients @ self.covariance @ f.coefficients.T)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return np.linalg.solve(np.linalg.cholesky(self.covariance), (y - self.mean)[..., None])[..., 0]

    def sample(self, rng: np.random.Generator, size: tuple[int, ...] = ()) -> np.ndarray:
        noise = rng.standard_normal((*size, *self.mean.shape))
        return self.mean + np.einsum("...ij,...j->...i", np.linalg.cholesky(self.covariance), noise)


@dataclass(frozen=True)
class Categorical:
    probs: np.ndarray

    def log_prob(self, z: np.ndarray) -> np.ndarray:
        return np.log(self.probs)[..., z]

    def entropy(self) -> np.ndarray:
        return -np.where(self.probs > 0, self.probs * np.log(np.where(self.probs > 0, self.probs, 1)), 0).sum(-1)


def log_factorial(y: np.ndarray) -> np.ndarray:
    """ln y! by table for counts up to the largest, exact to rounding."""
    y = np.asarray(y)
    top = int(y.max()) if y.size else 0
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    return table[np.clip(y, 0, None).astype(np.int64)]


@dataclass(frozen=True)
class Poisson:
    """Independent counts with ``log_rates`` (K, D)."""

    log_rates: np.ndarray

    def log_prob(self, y: np.ndarray) -> np.ndarray:
        rates = self.log_rates
        return (y[..., None, :] * rates - np.exp(rates) - log_factorial(y)[..., None, :]).sum(-1)

    def mean(self) -> np.ndarray:
        return np.exp(self.log_rates)


@dataclass(frozen=True)
class LinearGaussian:
    """y | x ~ N(coefficients x + bias, covariance); (K, D, P), (K, D), (K, D, D)."""

    coefficients: np.ndarray
    bias: np.ndarray
    covariance: np.ndarray
    diagonal: bool = False

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("kdp,...p->...kd", self.coefficients, x) + self.bias

    def log_prob(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        e = y[..., None, :] - self.mean(x)
        inverse, logdet = np.linalg.inv(self.covariance), np.linalg.slogdet(self.covariance)[1]
        return -0.5 * (np.einsum("...ki,kij,...kj->...k", e, inverse, e) + logdet + y.shape[-1] * LOG_2PI)


@dataclass(frozen=True)
class LinearPoisson:
    """y | x ~ Poisson(exp(coefficients x + bias)); (K, D, P), (K, D)."""

    coefficients: np.ndarray
    bias: np.ndarray

    def log_rates(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("kdp,...p->...kd", self.coefficients, x) + self.bias

    def log_prob(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        eta = self.log_rates(x)
        return (y[..., None, :] * eta - np.exp(eta) - log_factorial(y)[..., None, :]).sum(-1)
