"""Plane geometry and affine flows behind displays of dynamics: numbers only, no drawing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from driftline.functions.dists import Affine


def plane(basis: np.ndarray, origin: np.ndarray | None = None) -> Affine:
    """The map of plane coordinates into space; ``basis`` (D, 2)."""
    return Affine(np.asarray(basis, float), np.zeros(len(basis)) if origin is None else np.asarray(origin, float))


def orthonormal(embedding: Affine) -> Affine:
    q, r = np.linalg.qr(embedding.coefficients)
    return Affine(q * np.where(np.diag(r) < 0, -1, 1), embedding.bias)


def recentred(embedding: Affine, point: np.ndarray) -> Affine:
    """The parallel plane through ``point``."""
    return Affine(embedding.coefficients, np.asarray(point, float))


def coordinates(embedding: Affine, values: np.ndarray) -> np.ndarray:
    return embedding.pseudoinverse().apply(values)


def slice_dynamics(dynamics: Affine, embedding: Affine) -> Affine:
    """Dynamics within a plane: step from a plane point and project back."""
    return embedding.pseudoinverse().compose(dynamics).compose(embedding)


def fixed_point(dynamics: Affine) -> np.ndarray:
    """(I - A)^-1 b."""
    return np.linalg.solve(np.eye(len(dynamics.bias)) - dynamics.coefficients, dynamics.bias)


def displacement_gain(dynamics: Affine) -> float:
    """Spectral norm of A - I."""
    return float(np.linalg.norm(dynamics.coefficients - np.eye(len(dynamics.bias)), 2))


@dataclass(frozen=True)
class Flow:
    """Fractional powers of an affine map: position(1) is one step of it."""

    generator: np.ndarray

    @staticmethod
    def of(f: Affine, condition: float = 1e6, imaginary: float = 1e-6) -> Flow:
        """By the matrix logarithm of the map in homogeneous coordinates; raises ValueError where it has no real one."""
        d = len(f.bias)
        h = np.eye(d + 1)
        h[:d, :d], h[:d, d] = f.coefficients, f.bias
        values, vectors = np.linalg.eig(h)
        if np.linalg.cond(vectors) > condition or (np.abs(values) < 1e-12).any():
            raise ValueError("the map has no well-conditioned logarithm")
        out = vectors @ np.diag(np.log(values.astype(complex))) @ np.linalg.inv(vectors)
        if np.abs(out.imag).max() > imaginary:
            raise ValueError("the logarithm isn't real")
        return Flow(out.real)

    def positions(self, points: np.ndarray, times: np.ndarray) -> np.ndarray:
        """(T, N, D) points after each time."""
        values, vectors = np.linalg.eig(self.generator)
        inverse = np.linalg.inv(vectors)
        h = np.concatenate([points, np.ones((len(points), 1))], 1)
        return np.array([(h @ (vectors @ np.diag(np.exp(values * t)) @ inverse).real.T)[:, :-1] for t in times])
