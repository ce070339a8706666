"""Gaussian log factors against densities and sums."""

import numpy as np

from driftline.functions.dists import Gaussian
from driftline.functions.potentials import Potential

RNG = np.random.default_rng(0)


def covariance(*shape):
    a = RNG.normal(size=(*shape, shape[-1]))
    return a @ np.swapaxes(a, -1, -2) + np.eye(shape[-1])


def log_normal(x, mean, cov):
    return Gaussian(mean[None], cov[None]).log_prob(x)[..., 0]


def test_densities_as_factors():
    mean, cov, x = RNG.normal(size=(3, 2)), covariance(3, 2), RNG.normal(size=2)
    f = Potential.from_moments(mean, cov)
    np.testing.assert_allclose(f.value(np.tile(x, (3, 1))), [log_normal(x, m, c) for m, c in zip(mean, cov, strict=True)])
    back, total = f.normalize()
    np.testing.assert_allclose(back.mean, mean)
    np.testing.assert_allclose(back.covariance, cov)
    np.testing.assert_allclose(total, 0, atol=1e-12)

    c, d, r, y = RNG.normal(size=(4, 2)), RNG.normal(size=4), covariance(4), RNG.normal(size=(5, 4))
    f = Potential.from_linear_likelihood(y, c, d, r)
    np.testing.assert_allclose(f.value(np.tile(x, (5, 1))), [log_normal(v, c @ x + d, r) for v in y])
    a, b, q, z = RNG.normal(size=(2, 2)), RNG.normal(size=2), covariance(2), RNG.normal(size=2)
    np.testing.assert_allclose(Potential.from_linear_conditional(a, b, q).value(np.concatenate([x, z])), log_normal(z, a @ x + b, q))


def test_posterior_of_a_linear_likelihood():
    m, p, c, d, r, y = RNG.normal(size=2), covariance(2), RNG.normal(size=(3, 2)), RNG.normal(size=3), covariance(3), RNG.normal(size=3)
    post, evidence = Potential.from_moments(m, p).add(Potential.from_linear_likelihood(y, c, d, r)).normalize()
    gain = p @ c.T @ np.linalg.inv(c @ p @ c.T + r)
    np.testing.assert_allclose(post.mean, m + gain @ (y - c @ m - d))
    np.testing.assert_allclose(post.covariance, p - gain @ c @ p, atol=1e-10)
    np.testing.assert_allclose(evidence, log_normal(y, c @ m + d, c @ p @ c.T + r))


def test_algebra_and_expectations():
    f, g = (Potential.from_moments(RNG.normal(size=(4, 2)), covariance(4, 2)) for _ in range(2))
    x, w = RNG.normal(size=(4, 2)), np.array([0.2, 0.0, 1.5, 1.0])
    np.testing.assert_allclose(f.sub(g).value(x), f.value(x) - g.value(x))
    same = np.tile(x[0], (4, 1))
    np.testing.assert_allclose(f.weighted_sum(w).value(x[0]), (w * f.value(same)).sum())
    mean, cov = RNG.normal(size=2), covariance(2)
    draws = RNG.multivariate_normal(mean, cov, 400000)
    one = Potential(f.precision[0], f.information[0], f.const[0])
    sampled = -0.5 * np.einsum("ni,ij,nj->n", draws, one.precision, draws) + draws @ one.information + one.const
    np.testing.assert_allclose(one.expected(mean, cov), sampled.mean(), rtol=0.02)


def test_local_quadratic_of_a_poisson_factor():
    c, d, y, at = RNG.normal(size=(3, 2)) * 0.3, np.zeros(3), np.array([1.0, 2.0, 0.0]), RNG.normal(size=2)

    def factor(x):
        eta = c @ x + d
        return y @ eta - np.exp(eta).sum()

    rate = np.exp(c @ at + d)
    f = Potential.from_local_quadratic(at, factor(at), c.T @ (y - rate), c.T @ (rate[:, None] * c))
    np.testing.assert_allclose(f.value(at), factor(at))
    near = at + 1e-3
    np.testing.assert_allclose(f.value(near), factor(near), atol=1e-8)
