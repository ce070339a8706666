"""Gaussian log factors -x'Jx/2 + h'x + c as values with any leading axes, and their algebra."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from driftline.functions.dists import LOG_2PI, Gaussian


@dataclass(frozen=True)
class Potential:
    """precision (..., D, D), information (..., D), const (...)."""

    precision: np.ndarray
    information: np.ndarray
    const: np.ndarray

    @staticmethod
    def from_moments(mean: np.ndarray, covariance: np.ndarray) -> Potential:
        """The log density of N(mean, covariance)."""
        p = np.linalg.inv(covariance)
        h = np.einsum("...ij,...j->...i", p, mean)
        const = -0.5 * (np.einsum("...i,...i->...", mean, h) + np.linalg.slogdet(covariance)[1] + mean.shape[-1] * LOG_2PI)
        return Potential(p, h, const)

    @staticmethod
    def from_linear_likelihood(y: np.ndarray, coefficients: np.ndarray, bias: np.ndarray, covariance: np.ndarray) -> Potential:
        """log N(y; coefficients x + bias, covariance) as a factor of x."""
        noise = Potential.from_moments(y - bias, covariance)
        back = np.swapaxes(coefficients, -1, -2)
        inner = back @ noise.precision @ coefficients
        h = np.einsum("...ij,...j->...i", back, noise.information)
        return Potential(np.broadcast_to(inner, (*h.shape, h.shape[-1])), h, noise.const)

    @staticmethod
    def from_linear_conditional(coefficients: np.ndarray, bias: np.ndarray, covariance: np.ndarray) -> Potential:
        """log N(z; coefficients x + bias, covariance) as a factor of the pair (x, z)."""
        eye = np.broadcast_to(np.eye(bias.shape[-1]), (*coefficients.shape[:-1], bias.shape[-1]))
        return Potential.from_linear_likelihood(np.zeros_like(bias), np.concatenate([-coefficients, eye], -1), -bias, covariance)

    @staticmethod
    def from_local_quadratic(at: np.ndarray, value: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> Potential:
        """The second-order model of a log factor at ``at``; ``curvature`` is the negative Hessian."""
        bent = np.einsum("...ij,...j->...i", curvature, at)
        const = value - np.einsum("...i,...i->...", gradient, at) - 0.5 * np.einsum("...i,...i->...", at, bent)
        return Potential(curvature, gradient + bent, const)

    def add(self, other: Potential) -> Potential:
        return Potential(self.precision + other.precision, self.information + other.information, self.const + other.const)

    def sub(self, other: Potential) -> Potential:
        return self.add(other.scale(-1.0))

    def scale(self, weight: np.ndarray | float) -> Potential:
        """Weights (...) may be 0 for factors that don't count."""
        w = np.asarray(weight, float)
        return Potential(w[..., None, None] * self.precision, w[..., None] * self.information, w * self.const)

    def weighted_sum(self, weight: np.ndarray, axis: int = -1) -> Potential:
        """The sum along a leading axis, factors times ``weight`` (...)."""
        scaled = self.scale(weight)
        axis = axis % scaled.const.ndim
        return Potential(scaled.precision.sum(axis), scaled.information.sum(axis), scaled.const.sum(axis))

    def value(self, x: np.ndarray) -> np.ndarray:
        return self.expected(x, np.zeros((*x.shape, x.shape[-1])))

    def expected(self, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
        """The mean of the log factor under N(mean, covariance)."""
        second = covariance + mean[..., :, None] * mean[..., None, :]
        return -0.5 * np.einsum("...ij,...ji->...", self.precision, second) + np.einsum("...i,...i->...", self.information, mean) + self.const

    def normalize(self) -> tuple[Gaussian, np.ndarray]:
        """The normal distribution in proportion to the factor, and the log of the factor's integral."""
        out = Gaussian.from_canonical(self.precision, self.information)
        log_det = np.linalg.slogdet(self.precision)[1]
        return out, self.const + 0.5 * (np.einsum("...i,...i->...", self.information, out.mean) - log_det + self.information.shape[-1] * LOG_2PI)
