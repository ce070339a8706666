"""Curve priors, planes and flows."""

import numpy as np
import pytest

from driftline.functions import planes
from driftline.functions.dists import Affine
from driftline.functions.processes import GatedRandomWalk, HermiteBasis, HermiteCurves, RandomWalk
from driftline.operators import chains


def test_random_walk_factors_match_sums():
    walk = RandomWalk(np.eye(2), 0.5 * np.eye(2))
    post = chains.gaussian_chain(walk.factors(np.array([4, 2])))
    np.testing.assert_allclose(post.log_normalizer, 0, atol=1e-9)
    np.testing.assert_allclose(post.cov[0, :, 0, 0], [1, 1.5, 2, 2.5])
    gated = GatedRandomWalk(np.eye(2), np.array([0.5 * np.eye(2), 2 * np.eye(2)]))
    post = chains.gaussian_chain(gated.factors(np.array([[0, 1, 0, 1]]), np.array([4])))
    np.testing.assert_allclose(post.cov[0, :, 0, 0], [1, 3, 3.5, 5.5])
    assert gated.sample(np.random.default_rng(0), np.array([0, 1, 1])).shape == (3, 2)
    np.testing.assert_allclose(gated.permute_gates([1, 0]).innovations[0], 2 * np.eye(2))


def test_hermite_curves_have_zero_integral():
    basis = HermiteBasis(5)
    nodes, weights = basis.quadrature()
    np.testing.assert_allclose(weights @ basis.raw(nodes) @ basis.coefficient_map(), 0, atol=1e-12)
    values, bends = basis.penalties()
    fine = np.linspace(0, 1, 20001)
    dense = basis.raw(fine) @ basis.coefficient_map()
    np.testing.assert_allclose(np.trapezoid(dense[:, :, None] * dense[:, None, :], fine, axis=0), values, atol=1e-6)
    assert np.linalg.eigvalsh(bends).min() > -1e-9
    curves = HermiteCurves.prior(5, 2, 1.0, 1e-3)
    mean, variance = curves.marginals(30)
    draws = np.array([curves.sample(np.random.default_rng(k), 30) for k in range(400)])
    assert not mean.any() and np.allclose(draws.var(0).mean(), variance.mean(), rtol=0.2)


def test_planes_and_flows():
    rotation = np.array([[0.0, -1.0], [1.0, 0.0]])
    f = Affine(0.9 * rotation, np.array([1.0, 0.0]))
    flow = planes.Flow.of(f)
    x = np.array([[1.0, 2.0], [0.0, 0.5]])
    np.testing.assert_allclose(flow.positions(x, np.array([0.0, 1.0, 2.0])), [x, f.apply(x), f.apply(f.apply(x))], atol=1e-9)
    np.testing.assert_allclose(f.apply(planes.fixed_point(f)), planes.fixed_point(f))
    with pytest.raises(ValueError):
        planes.Flow.of(Affine(np.diag([-0.5, 0.3]), np.zeros(2)))
    e = planes.orthonormal(planes.plane(np.array([[1.0, 1.0], [0.0, 2.0], [0.0, 0.0]])))
    np.testing.assert_allclose(e.coefficients.T @ e.coefficients, np.eye(2), atol=1e-12)
    np.testing.assert_allclose(planes.coordinates(e, e.apply(x)), x, atol=1e-12)
    assert planes.displacement_gain(Affine(np.eye(2), np.zeros(2))) == 0


def test_soft_gates_and_expected_moves():
    rng = np.random.default_rng(3)
    gated = GatedRandomWalk(np.eye(2), np.array([0.5 * np.eye(2), [[2.0, 0.3], [0.3, 1.0]]]))
    gates = rng.integers(0, 2, (2, 5))
    lengths = np.array([5, 3])
    hard, soft = gated.factors(gates, lengths), gated.soft_factors(np.eye(2)[gates], lengths)
    inside = chains.valid(lengths, 5)[:, 1:, None, None]
    for a, b in ((hard.diag, soft.diag), (hard.lower * inside, soft.lower), (hard.const, soft.const)):
        np.testing.assert_allclose(a, b, atol=1e-12)
    assert gated.soft_factors(np.ones((1, 1, 2)) / 2, np.array([1])).diag.shape == (1, 1, 2, 2)

    y = rng.normal(size=(2, 5, 2))
    f = chains.add_gaussian_emissions(hard, y, np.ones((2, 5)), np.eye(2), np.zeros(2), np.eye(2))
    post = chains.gaussian_chain(f)
    each = gated.expected_gate_log_probs(post)
    assert not each[1, 2:].any()
    joint = np.linalg.inv(chains.GaussianFactors(f.diag, f.lower, f.info, f.const, lengths).dense_precision(0))
    draws = rng.multivariate_normal(post.mean[0].ravel(), joint, 200000).reshape(-1, 5, 2)
    moves = np.diff(draws, axis=1)
    for k, c in enumerate(gated.innovations):
        p = np.linalg.inv(c)
        sampled = -0.5 * (np.einsum("nti,ij,ntj->nt", moves, p, moves).mean(0) + np.linalg.slogdet(c)[1] + 2 * chains.LOG_2PI)
        np.testing.assert_allclose(each[0, :, k], sampled, atol=0.03)
    np.testing.assert_allclose(gated.expected_gate_log_difference(post), each[..., 1] - each[..., 0])


def test_curve_posterior_is_a_regression_on_the_basis():
    rng = np.random.default_rng(4)
    prior = HermiteCurves.prior(4, 2, 1.0, 1e-2)
    noise = np.array([[0.3, 0.1], [0.1, 0.2]])
    y = rng.normal(size=(25, 2))
    p = np.linalg.inv(noise)
    post = prior.infer(np.tile(p, (25, 1, 1)), y @ p)
    b = prior.basis.values(25)
    design = np.zeros((25, 2, 2, b.shape[1]))
    design[:, 0, 0], design[:, 1, 1] = b, b
    design = design.reshape(50, -1)
    before = np.kron(np.eye(2), np.linalg.inv(prior.covariance[0]))
    weight = np.kron(np.eye(25), p)
    cov = np.linalg.inv(before + design.T @ weight @ design)
    np.testing.assert_allclose(post.mean.T.ravel(), cov @ design.T @ weight @ y.ravel(), atol=1e-9)
    np.testing.assert_allclose(post.covariance.reshape(cov.shape), cov, atol=1e-9)
    assert post.marginals(7)[1].shape == (7, 2, 2)
    none = prior.infer(np.zeros((0, 2, 2)), np.zeros((0, 2)))
    np.testing.assert_allclose(none.covariance[0, :, 0], prior.covariance[0], atol=1e-9)
    np.testing.assert_allclose(none.mean, 0, atol=1e-12)
