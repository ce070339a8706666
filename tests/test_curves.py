"""Curves against dense normal equations, gated walks against enumeration of gates."""

import itertools

import numpy as np
import pytest

from driftline.functions.processes import HermiteBasis
from driftline.operators import chains
from driftline.plans.curves import CurveModel
from driftline.plans.models import Model
from driftline.plans.walks import GatedWalk
from driftline.sources import sequences as source

RNG = np.random.default_rng


def dense_curve(m, y, seen):
    """Posterior mean and covariance of all coefficients, by dense algebra."""
    basis = HermiteBasis(m.knots)
    at = np.arange(len(y)) / max(len(y) - 1, 1)
    b = basis.raw(at)[seen]
    prior, integrals = m._prior()
    precision = prior - m.amplitude * np.outer(integrals, integrals) + b.T @ b / m.noise
    return np.linalg.solve(precision, b.T @ y[seen] / m.noise), np.linalg.inv(precision), basis.raw(at)


@pytest.mark.parametrize("knots", [2, 3, 7])
def test_curves_equal_dense_equations(spark, knots):
    rng = RNG(knots)
    m = CurveModel(knots, 0.7, 0.02, 0.3)
    y = [[rng.normal(size=(n, d)).cumsum(0) for n in (1, 2, 5, 40)] for d in (1, 2)]
    seen = [[rng.random(len(v)) > 0.25 for v in own] for own in y]
    seen[0][0][:] = True
    seen[1][1][:] = False  # nothing to fit
    e = source.from_arrays(spark, y, visible=seen)
    fits = m.fit(e)
    found = {(r["session"], r["seq"], r["variable"]): r for r in fits.collect()}
    values = {(r["session"], r["seq"], r["variable"], r["t"]): (r["mean"], r["variance"]) for r in m.values(e, fits).collect()}
    expected = {(s, n, v) for s, own in enumerate(y) for n, x in enumerate(own) for v in range(x.shape[1]) if seen[s][n].any()}
    assert set(found) == expected
    for s, n, v in expected:
        mean, cov, b = dense_curve(m, y[s][n][:, v], seen[s][n])
        np.testing.assert_allclose(found[s, n, v]["coefficients"], mean, atol=1e-6)
        for c in range(knots - 1):
            np.testing.assert_allclose(np.reshape(found[s, n, v]["covariance"][c], (4, 4)), cov[2 * c : 2 * c + 4, 2 * c : 2 * c + 4], rtol=1e-6, atol=1e-6)
        for t in range(len(y[s][n])):
            np.testing.assert_allclose(values[s, n, v, t], (b[t] @ mean, b[t] @ cov @ b[t]), rtol=1e-6, atol=1e-6)


def test_curves_keep_lines_and_refuse_odd_priors(spark):
    line = np.linspace(3, 5, 30)[:, None]
    m = CurveModel(5, 1e-9, 1.0, 1e-3)
    e = source.from_arrays(spark, [[line]])
    for r in m.values(e, m.fit(e)).collect():
        assert abs(r["mean"] - line[r["t"], 0]) < 1e-3
    assert m.fit(e.where("false")).count() == 0
    for odd in ((1, 1, 1, 1), (2, 0, 1, 1), (2, 1, 1, 0)):
        with pytest.raises(ValueError):
            CurveModel(*odd)


def walk(k=2, d=1):
    rng = RNG(1)
    return GatedWalk({"initial_probs": [0.6, 0.4], "transition_probs": [[0.8, 0.2], [0.3, 0.7]], "start_mean": np.zeros(d), "start_covariance": np.eye(d), "innovations": [0.01 * np.eye(d), 4.0 * np.eye(d)], "emissions": [{"coefficients": np.eye(d), "bias": rng.normal(size=d), "covariance": 0.2 * np.eye(d)}]})


def exact(m, y):
    """Log-likelihood and gate marginals by all paths of gates, the walk integrated out of each."""
    p, e, steps = m.params, m.params["emissions"][0], len(y)
    d = y.shape[1]
    total, gates = [], []
    for path in itertools.product(range(2), repeat=steps):
        q = p["dynamics_covariances"][list(path[1:])][None]
        f = chains.linear_factors(p["latent_initial_means"][0], p["latent_initial_covariances"][0], np.broadcast_to(np.eye(d), (1, steps - 1, d, d)), np.zeros((1, steps - 1, d)), q, steps, np.array([steps]))
        f = chains.add_gaussian_emissions(f, y[None], np.ones((1, steps)), e["coefficients"], e["bias"], e["covariance"])
        with np.errstate(divide="ignore"):
            own = np.log(p["initial_probs"][path[0]]) + sum(np.log(p["transition_probs"][a, b]) for a, b in zip(path, path[1:], strict=False))
        total.append(own + chains.gaussian_chain(f).log_normalizer[0])
        gates.append(path)
    w = np.exp(np.array(total) - max(total))
    return max(total) + np.log(w.sum()), (w[:, None] * np.array(gates)).sum(0) / w.sum()


def test_bounds_rise_below_the_enumerated_likelihood(spark):
    rng = RNG(2)
    y = [np.cumsum(rng.normal(size=(n, 1)) * np.where(rng.random((n, 1)) > 0.6, 2, 0.1), 0) for n in (2, 5, 8)]
    e, m = source.from_arrays(spark, [y]), walk()
    found = {}
    for r in m.bounds(e).collect():
        found.setdefault(r["seq"], {})[r["iteration"]] = r["bound"]
    for n, v in enumerate(y):
        trace = [found[n][i] for i in range(m.inference_iters)]
        like, _ = exact(m, v)
        assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] <= like + 1e-9
        assert like - trace[-1] < 2.5  # and not far below it


def test_gates_agree_with_enumeration_where_steps_tell_them_apart(spark):
    """Still and jumping steps a hundred times as wide, noise between: mean field finds the enumerated gates; the fixed gate is exact."""
    y = np.cumsum(np.array([0.0, 0.01, 12.0, 0.02, -15.0, 0.0, 0.01, 9.0]))[:, None]
    m = walk().replace(emissions=[{"coefficients": [[1.0]], "bias": [0.0], "covariance": [[0.001]]}], dynamics_covariances=[[[0.01]], [[100.0]]])
    like, gates = exact(m, y)
    got = sorted(m.infer(source.from_arrays(spark, [[y]])).collect(), key=lambda r: r["t"])
    np.testing.assert_allclose([r["gamma"][1] for r in got][1:], gates[1:], atol=0.02)
    still = m.replace(initial_probs=[1.0, 0.0], transition_probs=[[1.0, 0.0], [1.0, 0.0]])
    like = exact(still, y)[0]
    assert abs(still.objective(source.from_arrays(spark, [[y]])).first()["objective"] - like) < 1e-6 * abs(like)


def test_fits_stay_walks_and_rise(spark, tmp_path):
    rng = RNG(3)
    y = [np.cumsum(rng.normal(size=(60, 2)) * np.where(np.arange(60) % 20 < 10, 0.1, 2.0)[:, None], 0) for _ in range(4)]
    e, m = source.from_arrays(spark, [y]), walk(d=2)
    fit = m.fit(e, 4)
    # Mean field starts anew at every step, so a step may end in another local optimum; on the whole the bound rises.
    assert fit.trace[-1] > fit.trace[0] and all(b >= a - 0.05 * abs(a) for a, b in zip(fit.trace, fit.trace[1:], strict=False)), fit.trace
    p = fit.model.params
    assert isinstance(fit.model, GatedWalk) and (p["dynamics_coefficients"] == np.eye(2)).all() and not p["dynamics_bias"].any()
    assert np.trace(p["dynamics_covariances"][1]) > 10 * np.trace(p["dynamics_covariances"][0])
    fit.model.save(spark, str(tmp_path / "w"))
    back = Model.load(spark, str(tmp_path / "w"))
    assert isinstance(back, GatedWalk)
    np.testing.assert_allclose(back.params["dynamics_covariances"], p["dynamics_covariances"])
