"""Many models in the same jobs, and observations of one's own, against models one by one, enumeration and slopes."""

import uuid

import numpy as np
import pytest

from driftline.functions import observations as kinds
from driftline.operators import chains
from driftline.plans import collections
from driftline.plans.models import ARHMM, HMM, LDS, POISSON, SLDS, Model
from driftline.sources import sequences as source

RNG = np.random.default_rng


def counts(spark, sessions=3, dims=(1, 2, 1), seed=0):
    rng = RNG(seed)
    return source.from_arrays(spark, [[rng.poisson(2.0 + 3 * (rng.random((12, 1)) > 0.5), (12, dims[s])).astype(float) for _ in range(3)] for s in range(sessions)])


def jobs(spark, f):
    """What f returns, and how many Spark jobs it ran."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "count")
    try:
        return f(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def agree(a, b):
    np.testing.assert_allclose(a.trace, b.trace, rtol=1e-8)
    for k, v in a.model.params.items():
        if k != "emissions":
            np.testing.assert_allclose(v, b.model.params[k], atol=1e-6)
    for x, y in zip(a.model.params["emissions"], b.model.params["emissions"], strict=True):
        for k, v in x.items():
            np.testing.assert_allclose(v, y[k], atol=1e-6)


def start(family, d, seed):
    rng = RNG(seed)
    chain = {"initial_probs": [0.5, 0.5], "transition_probs": [[0.8, 0.2], [0.3, 0.7]]}
    if family == "hmm":
        return HMM(chain | {"emissions": [{"mean": rng.normal(size=(2, d)) * 3, "covariance": np.tile(4 * np.eye(d), (2, 1, 1))}]})
    if family == "arhmm":
        return ARHMM(chain | {"emissions": [{"coefficients": rng.normal(size=(2, d, d)) * 0.05, "bias": np.log(2 + rng.random((2, d)))}]}, POISSON)
    p = {"initial_mean": np.zeros(2), "initial_covariance": np.eye(2), "dynamics_coefficients": 0.8 * np.eye(2), "dynamics_bias": np.zeros(2), "dynamics_covariance": 0.3 * np.eye(2)}
    return LDS(p | {"emissions": [{"coefficients": rng.normal(size=(d, 2)) * 0.3, "bias": np.ones(d)}]}, POISSON)


@pytest.mark.parametrize("family", ["hmm", "arhmm", "lds"])
def test_sessions_side_by_side_equal_sessions_alone(spark, family):
    e = counts(spark)
    models = {s: start(family, d, s) for s, d in enumerate((1, 2, 1))}
    together = collections.Collection(models).fit(e, 2)
    for s, m in models.items():
        agree(together[s], m.fit(collections.session_rows(e, s), 2))


@pytest.mark.parametrize("family", ["hmm", "lds"])
def test_starts_side_by_side_equal_starts_alone(spark, family):
    e = collections.session_rows(counts(spark), 1)
    several = [start(family, 2, k) for k in range(3)]
    for got, m in zip(collections.Restarts.fit(e, several, 2).runs, several, strict=True):
        agree(got, m.fit(e, 2))


def test_jobs_dont_grow_with_models(spark):
    e = counts(spark, 6, (1,) * 6)
    few, n_few = jobs(spark, lambda: collections.SessionRestarts.fit(e, {0: [start("hmm", 1, 0)]}, 2))
    many, n_many = jobs(spark, lambda: collections.SessionRestarts.fit(e, {s: [start("hmm", 1, k) for k in range(5)] for s in range(6)}, 2))
    assert n_many == n_few
    agree(many.runs[0].runs[0], few.runs[0].runs[0])
    assert len(many.best().models) == 6
    assert all(many.runs[s].best().trace[-1] == max(f.trace[-1] for f in many.runs[s].runs) for s in range(6))


def test_converged_models_leave(spark):
    e = counts(spark)
    models = {s: start("hmm", d, s) for s, d in enumerate((1, 2, 1))}
    loose, exact = collections.Collection(models).fit(e, 12, tolerance=1e-2), collections.Collection(models).fit(e, 12)
    assert any(len(loose[s].trace) < 13 for s in models)
    for s in models:
        np.testing.assert_allclose(loose[s].trace, exact[s].trace[: len(loose[s].trace)], rtol=1e-9)


def test_collections_infer_in_one_pass(spark):
    e = counts(spark)
    c = collections.Collection({s: start("hmm", d, s) for s, d in enumerate((1, 2, 1))})
    got = {(r["session"], r["seq"], r["t"]): r["gamma"] for r in c.infer(e).collect()}
    for s in c.models:
        for r in c.get(s).infer(collections.session_rows(e, s)).collect():
            np.testing.assert_allclose(got[s, r["seq"], r["t"]], r["gamma"], atol=1e-12)
    split = collections.Collection.split(HMM.initialize(e, 2, POISSON, steps=3))
    assert sorted(split.models) == [0, 1, 2] and split.objective(e).count() == 9


# Observations of one's own


def test_categorical_chain_against_enumeration(spark):
    import itertools

    pi, p, probs = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])
    codes = [0, 2, 1, 2]
    e = source.from_arrays(spark, [[np.array(codes, float)[:, None]]], visible=[[np.array([True, True, False, True])]])
    m = HMM({"initial_probs": pi, "transition_probs": p, "emissions": [{"probs": probs}]}, kinds.CategoricalStates(3))
    total, gamma = 0.0, np.zeros((4, 2))
    for path in itertools.product(range(2), repeat=4):
        w = pi[path[0]] * np.prod([p[a, b] for a, b in zip(path, path[1:], strict=False)]) * np.prod([1.0 if t == 2 else probs[z, codes[t]] for t, z in enumerate(path)])
        total += w
        gamma[np.arange(4), path] += w
    gamma /= total
    assert abs(m.objective(e).first()["objective"] - np.log(total)) < 1e-10
    for r in m.infer(e).collect():
        np.testing.assert_allclose(r["gamma"], gamma[r["t"]], atol=1e-10)
    new = m.fit(e, 1).model.params["emissions"][0]["probs"]
    want = np.zeros((2, 3))
    for t in (0, 1, 3):
        want[:, codes[t]] += gamma[t]
    np.testing.assert_allclose(new[1], want[1] / want[1].sum(), atol=1e-6)


def test_categorical_models_start_sample_and_come_back(spark, tmp_path):
    kind = kinds.register(kinds.CategoricalStates(4))
    truth = HMM({"initial_probs": [0.5, 0.5], "transition_probs": [[0.9, 0.1], [0.1, 0.9]], "emissions": [{"probs": [[0.7, 0.1, 0.1, 0.1], [0.05, 0.05, 0.2, 0.7]]}]}, kind)
    drawn = truth.sample(spark, {0: [300] * 4}, seed=3)
    share = drawn.where("z = 0 and y[0] = 0").count() / drawn.where("z = 0").count()
    assert abs(share - 0.7) < 0.1
    fit = HMM.initialize(drawn, 2, kind).fit(drawn, 15)
    assert all(b >= a - 1e-6 for a, b in zip(fit.trace, fit.trace[1:], strict=False))
    fit.model.save(spark, str(tmp_path / "m"))
    back = Model.load(spark, str(tmp_path / "m"))
    assert back.kind is kind and abs(back.objective(drawn).first()["objective"] - fit.model.objective(drawn).first()["objective"]) < 1e-9
    unknown = source.from_arrays(spark, [[np.array([[9.0], [0.5]])]])
    assert truth.objective(unknown).count() == 1  # symbols that no state has


def test_a_kind_of_ones_own(spark):
    """A kind that the library doesn't have: absolute deviations from given centres, the scale of each state learnt."""
    centre = np.array([[-2.0], [2.0]])

    class Laplacian(kinds.StateObservations):
        name = "laplacian"

        def log_prob(self, e, y):
            return (-np.abs(y[..., None, :] - e["centre"]) / e["scale"] - np.log(2 * e["scale"])).sum(-1)

        def sums(self, w, y):
            return {"a": np.einsum("btk,btkd->kd", w, np.abs(y[:, :, None, :] - centre))}

        def maximise(self, sums, old, diagonal):
            return {"centre": old["centre"], "scale": sums["a"] / sums["n"][:, None]}

        def means(self, e):
            return e["centre"]

    rng = RNG(5)
    z = np.repeat([0, 1], 200)
    e = source.from_arrays(spark, [[(np.where(z, 2.0, -2.0) + rng.laplace(0, np.where(z, 0.3, 1.0)))[:, None]]])
    m = HMM({"initial_probs": [0.5, 0.5], "transition_probs": [[0.9, 0.1], [0.1, 0.9]], "emissions": [{"centre": centre, "scale": np.ones((2, 1))}]}, Laplacian())
    fit = m.fit(e, 10)
    assert all(b >= a - 1e-8 for a, b in zip(fit.trace, fit.trace[1:], strict=False))
    np.testing.assert_allclose(fit.model.params["emissions"][0]["scale"][:, 0], [1.0, 0.3], rtol=0.2)


LIKELIHOODS = [kinds.PoissonLikelihood(), kinds.BernoulliLikelihood(), kinds.NegativeBinomialLikelihood(2.5)]


@pytest.mark.parametrize("kind", LIKELIHOODS, ids=lambda k: k.name)
def test_slopes_and_curves_are_derivatives(kind):
    y, eta, h = np.array([0.0, 1.0, 1.0, 0.0]), np.array([-2.0, 0.3, 4.0, 1.5]), 1e-4
    value, slope, curve = kind.terms(y, eta)
    up, down = kind.terms(y, eta + h)[0], kind.terms(y, eta - h)[0]
    np.testing.assert_allclose(slope, (up - down) / (2 * h), atol=1e-6)
    np.testing.assert_allclose(curve, -(up - 2 * value + down) / h**2, atol=1e-5)


@pytest.mark.parametrize("kind", [LIKELIHOODS[0], LIKELIHOODS[2]], ids=lambda k: k.name)
def test_probabilities_of_counts_sum_to_one(kind):
    y = np.arange(4000.0)
    p = np.exp(kind.terms(y, np.full(4000, 1.3))[0])
    np.testing.assert_allclose([p.sum(), (p * y).sum()], [1.0, np.exp(1.3)], rtol=1e-9)
    np.testing.assert_allclose(kinds.Likelihood.expected(kind, np.array(3.0), np.array(0.4), np.array(0.5))[0], kind.expected(np.array(3.0), np.array(0.4), np.array(0.5))[0], rtol=1e-8)


@pytest.mark.parametrize("kind", LIKELIHOODS, ids=lambda k: k.name)
def test_expected_statistics_are_slopes_of_the_objective(kind):
    rng = RNG(6)
    x, w, y = rng.normal(size=(40, 2)), rng.random(40), (rng.random((40, 3)) > 0.5).astype(float)
    a = rng.normal(size=(40, 2, 2)) * 0.4
    spread, c, b = a @ np.swapaxes(a, 1, 2), rng.normal(size=(3, 2)) * 0.5, rng.normal(size=3) * 0.3
    for s in (None, spread):
        _, gradient, hessian = kind.statistics(c, b, y, x, w, s)
        for j in range(3):
            e = np.zeros((3, 3))
            e[:, j] = 1e-5
            ends = [kind.statistics(c + k * e[:, :2], b + k * e[:, 2], y, x, w, s)[0] for k in (1, -1)]
            np.testing.assert_allclose(gradient[:, j], (ends[0] - ends[1]) / 2e-5, rtol=1e-4, atol=1e-6)
        assert (np.linalg.eigvalsh(hessian) < 0).all()


@pytest.mark.parametrize("kind", LIKELIHOODS[1:], ids=lambda k: k.name)
def test_modes_have_no_slope_and_fits_rise(spark, kind):
    rng = RNG(7)
    x = np.cumsum(rng.normal(size=(5, 30, 1)) * 0.3, 1)
    eta = x * np.array([1.0, -0.8, 0.5])
    y = [[kind.sample(rng, v) for v in eta]]
    e = source.from_arrays(spark, y, visible=[[rng.random(30) > 0.2 for _ in range(5)]])
    m = LDS.initialize(e, 1, kind)
    p, em = m.params, m.params["emissions"][0]
    prior = chains.linear_factors(p["initial_mean"], p["initial_covariance"], np.broadcast_to(p["dynamics_coefficients"], (1, 29, 1, 1)), np.zeros((1, 29, 1)), np.broadcast_to(p["dynamics_covariance"], (1, 29, 1, 1)), 30, np.array([30]))
    found = {(r["seq"], r["t"]): r["mean"] for r in m.infer(e).collect()}
    seen = {(r["seq"], r["t"]): r["visible"] for r in e.collect()}
    for s in range(5):
        mode = np.array([found[s, t] for t in range(30)])[None]
        w = np.array([float(seen[s, t]) for t in range(30)])
        slope = (kind.terms(y[0][s], mode[0] @ em["coefficients"].T + em["bias"])[1] * w[:, None]) @ em["coefficients"]
        inner = prior.info[0] - np.einsum("tij,tj->ti", prior.diag[0], mode[0])
        inner[1:] -= np.einsum("tij,tj->ti", prior.lower[0], mode[0, :-1])
        inner[:-1] -= np.einsum("tji,tj->ti", prior.lower[0], mode[0, 1:])
        assert np.abs(slope + inner).max() < 1e-4
    fit = m.fit(e, 4)
    assert fit.trace[-1] > fit.trace[0] and all(np.isfinite(fit.trace))
    assert m.observation_mean(e).count() == m.elbo(e).count() * 30


def test_likelihoods_in_switching_systems_and_storage(spark, tmp_path):
    rng = RNG(8)
    e = source.from_arrays(spark, [[(rng.random((20, 2)) > 0.5).astype(float) for _ in range(3)]])
    kind = kinds.BernoulliLikelihood()
    m = SLDS.initialize(e, 2, 1, kind)
    assert m.infer(e).count() == 60 and np.isfinite([r["elbo"] for r in m.elbo(e).collect()]).all()
    m.save(spark, str(tmp_path / "s"))
    back = Model.load(spark, str(tmp_path / "s"))
    assert isinstance(back.likelihood, kinds.BernoulliLikelihood)
    assert m.sample(spark, {0: [5]}, seed=1).where("y[0] not in (0, 1)").count() == 0
    with pytest.raises(ValueError):
        LDS.initialize(e, 1, "unheard of")
    with pytest.raises(ValueError):
        HMM.initialize(e, 2, kind)
