"""Posteriors moved as columns against inference by the moved models; coordinate ascent against exhaustive search."""

import itertools

import numpy as np
import pytest

from driftline.functions.ascent import best_ascent, coordinate_ascent
from driftline.functions.dists import Affine
from driftline.operators import align, posteriors
from driftline.plans import starts
from driftline.plans.models import HMM, LDS, SLDS
from driftline.sources import sequences as source

RNG = np.random.default_rng


def rows(df, *columns):
    return {(r["session"], r["seq"], r["t"]): [None if r[c] is None else np.array(r[c], float) for c in columns] for r in df.collect()}


def agree(a, b, tolerance=1e-8):
    assert a.keys() == b.keys() and a
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None) == (y is None)
            if x is not None:
                np.testing.assert_allclose(x, y, atol=tolerance)


def table(spark, seed=0, dims=(2,), steps=(1, 2, 9)):
    rng = RNG(seed)
    return source.from_arrays(spark, [[rng.normal(size=(n, d)) for n in steps] for d in dims])


def lds(d=3, o=2):
    rng = RNG(1)
    a = rng.normal(size=(d, d)) * 0.3
    s = rng.normal(size=(d, d))
    return LDS({"initial_mean": rng.normal(size=d), "initial_covariance": np.eye(d) + s @ s.T, "dynamics_coefficients": a, "dynamics_bias": rng.normal(size=d), "dynamics_covariance": 0.5 * np.eye(d) + 0.1, "emissions": [{"coefficients": rng.normal(size=(o, d)), "bias": np.zeros(o), "covariance": np.eye(o)}]})


def slds():
    rng = RNG(2)
    return SLDS({
        "initial_probs": [0.5, 0.3, 0.2], "transition_probs": rng.dirichlet(np.ones(3), 3), "latent_initial_means": rng.normal(size=(3, 2)), "latent_initial_covariances": np.tile(np.eye(2), (3, 1, 1)),
        "dynamics_coefficients": rng.normal(size=(3, 2, 2)) * 0.4, "dynamics_bias": rng.normal(size=(3, 2)), "dynamics_covariances": np.tile(0.5 * np.eye(2), (3, 1, 1)), "emissions": [{"coefficients": np.eye(2), "bias": np.zeros(2), "covariance": np.eye(2)}],
    })


def test_aligned_latents_equal_inference_by_the_aligned_model(spark):
    e, m = table(spark), lds()
    f = Affine(RNG(3).normal(size=(3, 3)), np.array([1.0, -2.0, 0.5]))
    agree(rows(posteriors.aligned(m.infer(e), f), "mean", "cov", "cross_next"), rows(m.align(f).infer(e), "mean", "cov", "cross_next"))


def test_reordered_and_shifted_latents(spark):
    e, m = table(spark), lds()
    own = rows(m.infer(e), "mean", "cov", "cross_next")
    for k, (mean, cov, cross) in rows(posteriors.reordered(m.infer(e), [2, 0, 1], [1, -1, 1]), "mean", "cov", "cross_next").items():
        w = np.eye(3)[[2, 0, 1]] * np.array([1, -1, 1])[:, None]
        np.testing.assert_allclose(mean, w @ own[k][0])
        np.testing.assert_allclose(cov, w @ own[k][1] @ w.T)
        assert (cross is None) == (own[k][2] is None)
    for k, (mean,) in rows(posteriors.shifted(m.infer(e), [1.0, 2.0, 3.0]), "mean").items():
        np.testing.assert_allclose(mean, own[k][0] + [1, 2, 3])
    with pytest.raises(ValueError):
        posteriors.reordered(m.infer(e), [0, 0, 1])


def test_states_and_latents_of_switching_posteriors(spark):
    e, m, order = table(spark), slds(), [2, 0, 1]
    f = Affine(np.array([[0.8, 0.3], [-0.2, 1.1]]), np.array([0.5, -1.0]))
    agree(rows(posteriors.align(m.infer(e), order, f), "gamma", "state", "mean", "cov"), rows(m.permute_states(order).align(f).infer(e), "gamma", "state", "mean", "cov"), 1e-6)


def test_permuted_states_with_pairs(spark):
    e = table(spark, dims=(1,))
    m = HMM({"initial_probs": [0.5, 0.3, 0.2], "transition_probs": RNG(4).dirichlet(np.ones(3), 3), "emissions": [{"mean": [[-1.0], [0.0], [1.0]], "covariance": np.ones((3, 1, 1))}]})
    agree(rows(posteriors.permuted_states(m.infer(e), [1, 2, 0]), "gamma", "state", "xi_next"), rows(m.permute_states([1, 2, 0]).infer(e), "gamma", "state", "xi_next"))


def test_pairs_are_joint_covariances(spark):
    e, m = table(spark, steps=(5, 1)), lds(2)
    own = rows(m.infer(e), "mean", "cov", "cross_next")
    got = rows(posteriors.pairs(m.infer(e)), "mean", "cov")
    assert sorted(got) == [(0, 0, t) for t in range(4)]
    for (s, q, t), (mean, cov) in got.items():
        a, b = own[s, q, t], own[s, q, t + 1]
        np.testing.assert_allclose(mean, np.r_[a[0], b[0]])
        np.testing.assert_allclose(cov, np.block([[a[1], a[2]], [a[2].T, b[1]]]))


@pytest.mark.parametrize("factor", [1, 3])
def test_upsampled_marginals(spark, factor):
    e, m = table(spark, steps=(1, 2, 6)), lds(2)
    own = rows(m.infer(e), "mean", "cov")
    found = {}
    for r in posteriors.upsampled(m.infer(e), factor).collect():
        found.setdefault(r["seq"], {})[r["i"]] = r
    for q, n in enumerate((1, 2, 6)):
        assert sorted(found[q]) == list(range((n - 1) * factor + 1))
        for i, r in found[q].items():
            t, a = divmod(i, factor)
            a /= factor
            x, y = own[0, q, t], own[0, q, min(t + 1, n - 1)]
            np.testing.assert_allclose(r["mean"], (1 - a) * x[0] + a * y[0])
            np.testing.assert_allclose(r["cov"], (1 - a) * x[1] + a * y[1])
            assert abs(r["time"] - i / factor) < 1e-12
    with pytest.raises(ValueError):
        posteriors.upsampled(m.infer(e), 0)


# Coordinate ascent


def test_ascent_over_single_numbers():
    target = np.array([3, -1, 4, 1])
    state, best = coordinate_ascent([0, 0, 0, 0], 4, lambda s: -float(((np.array(s) - target) ** 2).sum()), lambda s, i: s[i], lambda s, i, v: [*s[:i], v, *s[i + 1 :]], lambda rng, f, v: max(range(-5, 6), key=f), [True, False, True, True])
    assert state == [3, 0, 4, 1] and best == -1
    nan, score = coordinate_ascent(1.0, 1, lambda s: s if s <= 1 else float("nan"), lambda s, i: s, lambda s, i, v: v, lambda rng, f, v: v + 1)
    assert (nan, score) == (1.0, 1.0)


def test_best_of_several_starts():
    hill = {0: 1.0, 1: 0.5, 2: 0.0, 3: 0.7, 4: 2.0}
    step = lambda rng, f, v: max((x for x in (v - 1, v + 1) if x in hill), key=f)
    args = (1, hill.__getitem__, lambda s, i: s, lambda s, i, v: v, step)
    assert coordinate_ascent(1, *args)[0] == 0
    assert best_ascent([1, 3], *args) == (4, 2.0)
    with pytest.raises(ValueError):
        best_ascent([], *args)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_alignment_of_sessions_equals_exhaustive_search(k):
    """Relabelled copies of one chain: the sweep finds the labels that no other choice beats."""
    rng = RNG(k)
    base = rng.dirichlet(np.ones(k) * 0.4, k) * 200
    orders = [rng.permutation(k) for _ in range(3)]
    transitions = np.array([base[np.ix_(p, p)] * (3 - i) for i, p in enumerate(orders)])
    initial = np.array([np.arange(1.0, k + 1)[p] for p in orders])
    found = align.align_markov_counts(initial, transitions)

    def score(perms):
        i = sum(initial[x][list(p)] for x, p in enumerate(perms)) + 1e-8
        t = sum(transitions[x][np.ix_(p, p)] for x, p in enumerate(perms)) + 1e-8
        return (i * np.log(i / i.sum())).sum() + (t * np.log(t / t.sum(-1, keepdims=True))).sum()

    every = list(itertools.permutations(range(k)))
    best = max(score((tuple(range(k)), a, b)) for a in every for b in every)
    assert abs(score([tuple(p) for p in found]) - best) < 1e-8
    silent = align.align_markov_counts(np.vstack([initial, np.zeros(k)]), np.concatenate([transitions, np.zeros((1, k, k))]))
    assert (silent[3] == np.arange(k)).all()


# Switching systems of several sessions


def test_slds_via_arhmm_pools_sessions_of_different_widths(spark):
    rng = RNG(9)
    x = [np.cumsum(rng.normal(size=(40, 2)) * 0.3, 0) for _ in range(6)]
    maps = [rng.normal(size=(3, 2)), rng.normal(size=(5, 2))]
    y = [[x[3 * s + n] @ maps[s].T + 0.05 * rng.normal(size=(40, len(maps[s]))) for n in range(3)] for s in range(2)]
    e = source.from_arrays(spark, y)
    m = starts.slds_via_arhmm(e, 2, 2, num_iters=2)
    assert {s: v["coefficients"].shape for s, v in m.params["emissions"].items()} == {0: (3, 2), 1: (5, 2)}
    assert m.params["dynamics_coefficients"].shape == (2, 2, 2)
    fit = m.fit(e, 2)
    assert all(np.isfinite(fit.trace)) and fit.trace[-1] > fit.trace[0]
    # The pooled start is that of one session which holds the projections of both.
    latents = starts.pseudo_latents(e, 2)
    one = latents.selectExpr("0 session", "seq + 100 * session seq", "t", "x", "x y", "u", "visible")
    from driftline.plans.models import ARHMM

    pooled = ARHMM.initialize(starts.as_observations(latents), 2, 1, pooled=True)
    alone = ARHMM.initialize(starts.as_observations(one), 2, 1)
    np.testing.assert_allclose(pooled.params["emissions"][0]["coefficients"], alone.params["emissions"][0]["coefficients"], atol=1e-8)


def test_slds_via_arhmm_takes_inputs(spark):
    rng = RNG(10)
    e = source.from_arrays(spark, [[rng.normal(size=(30, 3)).cumsum(0) for _ in range(3)]], [[rng.normal(size=(30, 1)) for _ in range(3)]])
    m = starts.slds_via_arhmm(e, 2, 2, num_iters=1)
    assert m.params["dynamics_input_coefficients"].shape == (2, 2, 1) and not m.params["dynamics_input_coefficients"].any()
    assert np.abs(m.fit(e, 1).model.params["dynamics_input_coefficients"]).max() > 0
