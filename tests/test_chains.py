"""Kernels against enumeration, dense linear algebra and invariants."""

import itertools

import numpy as np
import pytest

from driftline.functions.observations import PoissonLikelihood
from driftline.operators import chains

PI = np.array([0.6, 0.4])
P = np.array([[0.7, 0.3], [0.2, 0.8]])
LOCAL = np.log([[0.9, 0.1], [0.2, 0.8], [0.6, 0.4]])


def enumerate_paths(initial, transition, local):
    t, k = local.shape
    gamma, xi, total, weights = np.zeros((t, k)), np.zeros((t - 1, k, k)), 0.0, []
    for path in itertools.product(range(k), repeat=t):
        lp = np.log(initial[path[0]]) + local[0, path[0]]
        for i in range(1, t):
            step = transition if transition.ndim == 2 else transition[i - 1]
            lp += np.log(step[path[i - 1], path[i]]) + local[i, path[i]]
        weights.append((path, lp))
    top = max(w for _, w in weights)
    z = sum(np.exp(w - top) for _, w in weights)
    entropy = 0.0
    for path, w in weights:
        p = np.exp(w - top) / z
        entropy -= p * np.log(p)
        for i in range(t):
            gamma[i, path[i]] += p
            if i:
                xi[i - 1, path[i - 1], path[i]] += p
    return gamma, xi, np.log(z) + top, entropy


@pytest.mark.parametrize("offset", [0.0, 1000.0])
def test_discrete_chain_against_enumeration(offset):
    out = chains.discrete_chain(PI, P, (LOCAL + offset)[None], np.array([3]))
    gamma, xi, logz, entropy = enumerate_paths(PI, P, LOCAL + offset)
    np.testing.assert_allclose(out.gamma[0], gamma, atol=1e-10)
    np.testing.assert_allclose(out.xi[0], xi, atol=1e-10)
    np.testing.assert_allclose(out.log_normalizer[0], logz, rtol=1e-12)
    np.testing.assert_allclose(out.entropy()[0], entropy, atol=1e-9)


def test_discrete_chain_time_varying_and_ragged():
    rng = np.random.default_rng(13)
    step = rng.dirichlet(np.ones(3), (2, 3, 3))
    local = rng.normal(size=(2, 4, 3))
    out = chains.discrete_chain(np.ones(3) / 3, step, local, np.array([4, 2]))
    for b, n in enumerate((4, 2)):
        gamma, xi, logz, _ = enumerate_paths(np.ones(3) / 3, step[b, : n - 1], local[b, :n])
        np.testing.assert_allclose(out.gamma[b, :n], gamma, atol=1e-10)
        np.testing.assert_allclose(out.xi[b, : n - 1], xi, atol=1e-10)
        np.testing.assert_allclose(out.log_normalizer[b], logz)
    assert not out.gamma[1, 2:].any()


def test_discrete_invariants_and_empty():
    rng = np.random.default_rng(1)
    out = chains.discrete_chain(PI, P, rng.normal(size=(3, 5, 2)), np.array([5, 1, 0]))
    np.testing.assert_allclose(out.gamma[0].sum(-1), 1)
    np.testing.assert_allclose(out.xi[0].sum(-1), out.gamma[0, :-1], atol=1e-12)
    np.testing.assert_allclose(out.xi[0].sum(-2), out.gamma[0, 1:], atol=1e-12)
    assert out.log_normalizer[2] == 0 and out.entropy()[2] == 0


def dense(f, t, d):
    j, h = np.zeros((t * d, t * d)), f.info[0, :t].ravel()
    for i in range(t):
        j[i * d : (i + 1) * d, i * d : (i + 1) * d] = f.diag[0, i]
        if i:
            j[i * d : (i + 1) * d, (i - 1) * d : i * d] = f.lower[0, i - 1]
            j[(i - 1) * d : i * d, i * d : (i + 1) * d] = f.lower[0, i - 1].T
    return j, h


def lds_factors(t, lengths, seed=3):
    rng = np.random.default_rng(seed)
    a, q = np.array([[0.9, 0.1], [0.0, 0.8]]), np.array([[0.5, 0.05], [0.05, 0.4]])
    b = len(lengths)
    prior = chains.linear_factors(np.array([0.5, -0.3]), np.array([[2, 0.2], [0.2, 1.5]]), np.broadcast_to(a, (b, t - 1, 2, 2)), rng.normal(size=(b, t - 1, 2)), np.broadcast_to(q, (b, t - 1, 2, 2)), t, np.array(lengths))
    y = rng.normal(size=(b, t, 2))
    w = np.ones((b, t))
    w[:, 1] = 0
    y[:, 1] = 1e6
    return prior, chains.add_gaussian_emissions(prior, y, w, np.eye(2), np.array([0.1, -0.2]), np.array([[1.5, 0.1], [0.1, 1.0]])), y, w


def test_gaussian_chain_against_dense():
    t, d = 4, 2
    _, f, _, _ = lds_factors(t, [t])
    out = chains.gaussian_chain(f)
    j, h = dense(f, t, d)
    cov = np.linalg.inv(j)
    np.testing.assert_allclose(out.mean[0].ravel(), cov @ h, atol=1e-10)
    for i in range(t):
        np.testing.assert_allclose(out.cov[0, i], cov[i * d : (i + 1) * d, i * d : (i + 1) * d], atol=1e-10)
        if i + 1 < t:
            np.testing.assert_allclose(out.cross[0, i], cov[i * d : (i + 1) * d, (i + 1) * d : (i + 2) * d], atol=1e-10)
    logz = f.const[0] + 0.5 * h @ cov @ h - 0.5 * np.linalg.slogdet(j)[1] + 0.5 * t * d * np.log(2 * np.pi)
    np.testing.assert_allclose(out.log_normalizer[0], logz)
    np.testing.assert_allclose(out.entropy()[0], 0.5 * (t * d * (1 + np.log(2 * np.pi)) + np.linalg.slogdet(cov)[1]))


def test_gaussian_chain_ragged_equals_alone_and_prior_normalises():
    prior, f, _, _ = lds_factors(5, [5, 3])
    both = chains.gaussian_chain(f)
    alone = chains.gaussian_chain(chains.GaussianFactors(f.diag[1:, :3], f.lower[1:, :2], f.info[1:, :3], f.const[1:], np.array([3])))
    np.testing.assert_allclose(both.mean[1, :3], alone.mean[0], atol=1e-10)
    np.testing.assert_allclose(both.log_normalizer[1], alone.log_normalizer[0])
    np.testing.assert_allclose(chains.gaussian_chain(prior).log_normalizer, 0, atol=1e-9)


def test_laplace_mode_has_no_slope():
    rng = np.random.default_rng(0)
    prior, _, _, w = lds_factors(6, [6, 4])
    c, d = rng.normal(size=(3, 2)), np.zeros(3)
    y = rng.poisson(2.0, (2, 6, 3)).astype(float)
    from driftline.functions.observations import PoissonLikelihood

    kind = PoissonLikelihood()
    post, mode = chains.laplace_chain(prior, y, w, c, d, kind)
    np.testing.assert_allclose(post.mean * chains.valid(np.array([6, 4]), 6)[..., None], mode * chains.valid(np.array([6, 4]), 6)[..., None], atol=1e-5)

    def objective(x):
        return prior.value(x) + (kind.terms(y, x @ c.T + d)[0] * (w * chains.valid(np.array([6, 4]), 6))[..., None]).sum((1, 2))

    for i in ((0, 2, 1), (1, 3, 0)):
        e = np.zeros_like(mode)
        e[i] = 1e-4
        assert abs((objective(mode + e) - objective(mode - e))[i[0]] / 2e-4) < 1e-3


def test_two_coordinates_need_no_factorization_a_step(monkeypatch):
    """Chains of one and two coordinates go by closed forms; before, every step called LAPACK twice."""
    rng = np.random.default_rng(4)
    for d in (1, 2):
        a, q = np.full((3, 6, d, d), 0.2) + 0.4 * np.eye(d), np.tile(0.5 * np.eye(d) + 0.1, (3, 6, 1, 1))
        f = chains.linear_factors(np.ones(d), np.eye(d), a, rng.normal(size=(3, 6, d)), q, 7, np.array([7, 4, 1]))
        calls = []
        with monkeypatch.context() as m:
            m.setattr(np.linalg, "inv", lambda x, g=np.linalg.inv: calls.append(1) or g(x))
            m.setattr(np.linalg, "slogdet", lambda x, g=np.linalg.slogdet: calls.append(1) or g(x))
            post = chains.gaussian_chain(f)
            entropy = post.entropy()
        assert not calls
        for i, n in enumerate((7, 4, 1)):
            cov = np.linalg.inv(f.dense_precision(i))
            np.testing.assert_allclose(post.mean[i, :n].ravel(), cov @ f.info[i, :n].ravel(), rtol=1e-10)
            np.testing.assert_allclose(post.cov[i, n - 1], cov[-d:, -d:], rtol=1e-10)
            np.testing.assert_allclose(entropy[i], 0.5 * (n * d * (1 + chains.LOG_2PI) + np.linalg.slogdet(cov)[1]), rtol=1e-10)


def test_done_sequences_leave_the_newton_steps():
    """Steps of one slow sequence don't move or cost the others of its batch."""
    rows = []

    class Counting(PoissonLikelihood):
        def terms(self, y, eta):
            rows.append(len(eta))
            return super().terms(y, eta)

    rng, n = np.random.default_rng(5), 40
    y = rng.poisson(1.0, (n, 5, 1)).astype(float)
    y[0] = 3e6  # far from the start
    a = np.full((n, 4, 1, 1), 0.8)
    prior = chains.linear_factors(np.zeros(1), np.eye(1), a, np.zeros((n, 4, 1)), np.ones((n, 4, 1, 1)), 5, np.full(n, 5))
    _, mode = chains.laplace_chain(prior, y, np.ones((n, 5)), np.eye(1), np.zeros(1), Counting())
    assert rows[-2] < n  # the last steps are those of the slow one
    for i in (0, 1, n - 1):
        _, alone = chains.laplace_chain(prior.of(np.array([i])), y[i : i + 1], np.ones((1, 5)), np.eye(1), np.zeros(1), PoissonLikelihood())
        np.testing.assert_allclose(mode[i], alone[0], rtol=1e-6, atol=1e-8)
