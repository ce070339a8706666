"""Model families over sequence tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import fits
from driftline.functions.dists import Affine
from driftline.operators import align
from driftline.plans.models import ARHMM, HMM, LDS, POISSON, SLDS, Model
from driftline.sources import sequences as source

HMM_PARAMS = {"initial_probs": [0.6, 0.4], "transition_probs": [[0.9, 0.1], [0.2, 0.8]], "emissions": [{"mean": [[0.0], [4.0]], "covariance": [[[1.0]], [[1.0]]]}]}
LDS_PARAMS = {"initial_mean": [0.0], "initial_covariance": [[1.0]], "dynamics_coefficients": [[0.9]], "dynamics_bias": [0.1], "dynamics_covariance": [[0.3]], "emissions": [{"coefficients": [[1.0], [0.5]], "bias": [0.0, 1.0], "covariance": np.eye(2) * 0.2}]}


def one_state(p):
    return {"initial_probs": [1.0], "transition_probs": [[1.0]], "latent_initial_means": [p["initial_mean"]], "latent_initial_covariances": [p["initial_covariance"]], "dynamics_coefficients": [p["dynamics_coefficients"]], "dynamics_bias": [p["dynamics_bias"]], "dynamics_covariances": [p["dynamics_covariance"]], "emissions": p["emissions"]}


def trace_rises(trace, slack=1e-3):
    return all(b >= a - slack * abs(a) * 1e-2 for a, b in zip(trace, trace[1:], strict=False))


def test_hidden_values_never_matter_and_keep_their_rows(spark):
    y = [[np.array([0.0, 1.0, 100.0, 4.0]), np.array([1.0, 2.0])]]
    seen = [[[True, True, False, True], [True, True]]]
    a = source.from_arrays(spark, y, visible=seen)
    b = a.withColumn("y", F.when(~F.col("visible"), F.array(F.lit(-7.0))).otherwise(F.col("y")))
    model = HMM(HMM_PARAMS)
    one, two = (model.infer(x).orderBy("seq", "t").toPandas() for x in (a, b))
    assert len(one) == 6 and one["gamma"].map(tuple).equals(two["gamma"].map(tuple))
    assert model.objective(a).agg(F.sum("objective")).first()[0] == pytest.approx(model.entropy(b).agg(F.sum("elbo")).first()[0])


def test_hmm_fit_sample_permute_and_save(spark, tmp_path):
    model = HMM(HMM_PARAMS)
    data = model.sample(spark, {0: [60] * 8}, seed=3).cache()
    fit = HMM.initialize(data.drop("z", "x"), 2).fit(data.drop("z", "x"), 6)
    assert len(fit.trace) == 7 and trace_rises(fit.trace)
    found = fit.model.match_states(np.array([[0.0], [4.0]]))
    np.testing.assert_allclose(found.params["emissions"][0]["mean"][:, 0], [0, 4], atol=0.4)
    truth = found.decode(data.drop("z", "x")).join(data.select("session", "seq", "t", "z"), ["session", "seq", "t"])
    assert truth.where("state = z").count() / truth.count() > 0.9
    path = str(tmp_path / "m")
    found.save(spark, path)
    with pytest.raises(Exception):  # noqa: B017  something is there
        found.save(spark, path)
    again = Model.load(spark, path)
    assert isinstance(again, HMM)
    np.testing.assert_array_equal(again.params["transition_probs"], found.params["transition_probs"])


def test_multi_session_with_different_sizes(spark):
    y = [[np.zeros((4, 1)), np.ones((3, 1))], [np.arange(6.0).reshape(3, 2)]]
    e = [HMM_PARAMS["emissions"][0], {"mean": [[0.0, 0.0], [4.0, 4.0]], "covariance": [np.eye(2), np.eye(2)]}]
    data = source.from_arrays(spark, y)
    source.validate(data)
    fit = HMM(HMM_PARAMS | {"emissions": e}).fit(data, 2)
    assert trace_rises(fit.trace)
    assert fit.model.params["emissions"][1]["mean"].shape == (2, 2)


def test_poisson_hmm(spark):
    model = HMM({"initial_probs": [0.5, 0.5], "transition_probs": [[0.9, 0.1], [0.1, 0.9]], "emissions": [{"log_rates": np.log([[1.0], [9.0]])}]}, POISSON)
    data = model.sample(spark, {0: [50] * 4}, seed=1).drop("z", "x").cache()
    fit = HMM.initialize(data, 2, POISSON).fit(data, 4)
    assert trace_rises(fit.trace)
    np.testing.assert_allclose(np.sort(np.exp(fit.model.params["emissions"][0]["log_rates"][:, 0])), [1, 9], rtol=0.4)


def test_arhmm_rejects_short_and_recovers(spark):
    p = {"initial_probs": [1.0], "transition_probs": [[1.0]], "emissions": [{"coefficients": [[[0.5, -0.3]]], "bias": [[0.2]], "covariance": [[[0.5]]]}]}
    model = ARHMM(p)
    data = model.sample(spark, {0: [200] * 6}, seed=5).drop("z", "x").cache()
    fit = model.fit(data, 1)
    e = fit.model.params["emissions"][0]
    np.testing.assert_allclose(e["coefficients"][0, 0], [0.5, -0.3], atol=0.1)
    short = source.from_arrays(spark, [[np.array([1.0, 2.0])]])
    with pytest.raises(Exception):  # noqa: B017
        model.infer(short).collect()


def test_arhmm_poisson_objective_rises(spark):
    p = {"initial_probs": [0.5, 0.5], "transition_probs": [[0.9, 0.1], [0.1, 0.9]], "emissions": [{"coefficients": [[[0.05]], [[-0.05]]], "bias": [[0.5], [1.5]]}]}
    model = ARHMM(p, POISSON)
    data = model.sample(spark, {0: [40] * 4}, seed=2).drop("z", "x").cache()
    assert trace_rises(model.fit(data, 2).trace)


def test_lds_bound_is_likelihood_and_one_state_slds_agrees(spark):
    model = LDS(LDS_PARAMS)
    data = model.sample(spark, {0: [12, 7]}, seed=4).drop("z", "x").cache()
    ll = [r[0] for r in model.objective(data).orderBy("seq").select("objective").collect()]
    np.testing.assert_allclose([r[0] for r in model.elbo(data).orderBy("seq").select("elbo").collect()], ll, rtol=1e-9)
    one = SLDS(one_state(LDS_PARAMS))
    np.testing.assert_allclose([r[0] for r in one.elbo(data).orderBy("seq").select("elbo").collect()], ll, rtol=1e-8)


def test_lds_em_rises_and_alignment_keeps_likelihood(spark):
    model = LDS(LDS_PARAMS)
    data = model.sample(spark, {0: [60] * 4}, seed=6).drop("z", "x").cache()
    assert trace_rises(LDS.initialize(data, 1).fit(data, 4).trace)
    before = model.objective(data).agg(F.sum("objective")).first()[0]
    for other in (model.align(Affine(np.array([[2.0]]), np.array([1.0]))), model.whiten()):
        assert other.objective(data).agg(F.sum("objective")).first()[0] == pytest.approx(before, rel=1e-9)
    assert model.whiten().params["dynamics_covariance"][0, 0] == pytest.approx(1)


def test_controlled_lds_with_everything_hidden(spark):
    """Inputs act on the move into their step; a hidden path has log-likelihood 0."""
    p = {"initial_mean": [0.0], "initial_covariance": [[1.0]], "dynamics_coefficients": [[1.0]], "dynamics_bias": [0.0], "dynamics_covariance": [[1.0]], "dynamics_input_coefficients": [[2.0]], "emissions": [{"coefficients": [[1.0]], "bias": [0.0], "covariance": [[1.0]]}]}
    data = source.from_arrays(spark, [[np.array([100.0, 100.0, 100.0])]], inputs=[[np.array([99.0, 1.0, 2.0])]], visible=[[[False] * 3]])
    assert [r[0][0] for r in LDS(p).infer(data).orderBy("t").select("mean").collect()] == pytest.approx([0, 2, 6])
    assert LDS(p).objective(data).first()["objective"] == pytest.approx(0, abs=1e-9)


def test_poisson_lds_and_slds(spark):
    shared = {k: v for k, v in LDS_PARAMS.items() if k != "emissions"}
    model = LDS(shared | {"emissions": [{"coefficients": [[0.5], [-0.4]], "bias": [1.0, 1.0]}]}, POISSON)
    data = model.sample(spark, {0: [30] * 3}, seed=8).drop("z", "x").cache()
    fit = model.fit(data, 2)
    assert len(fit.trace) == 3 and np.isfinite(fit.trace).all()
    assert model.elbo(data).agg(F.sum("elbo")).first()[0] <= model.objective(data).agg(F.sum("objective")).first()[0] + 1
    assert SLDS(one_state(model.params), POISSON).infer(data).count() == 90


def test_slds_fit_rises_and_permutes(spark):
    p = {"initial_probs": [0.7, 0.3], "transition_probs": [[0.9, 0.1], [0.2, 0.8]], "latent_initial_means": [[0.0], [0.0]], "latent_initial_covariances": [[[1.0]], [[1.0]]], "dynamics_coefficients": [[[0.8]], [[-0.5]]], "dynamics_bias": [[0.0], [1.0]], "dynamics_covariances": [[[0.5]], [[0.5]]], "emissions": [{"coefficients": [[1.0], [0.7]], "bias": [0.0, 0.0], "covariance": np.eye(2) * 0.3}]}
    model = SLDS(p)
    data = model.sample(spark, {0: [40] * 3}, seed=9).drop("z", "x").cache()
    assert trace_rises(model.fit(data, 3).trace)
    a, b = model.elbo(data).agg(F.sum("elbo")).first()[0], model.permute_states([1, 0]).elbo(data).agg(F.sum("elbo")).first()[0]
    assert a == pytest.approx(b, rel=1e-3)


def test_closed_form_fits():
    np.testing.assert_allclose(fits.categorical(np.array([0.8 + 0.5 + 0.1, 0.2 + 0.5 + 0.9])), [1.4 / 3, 1.6 / 3], atol=1e-7)
    np.testing.assert_allclose(fits.categorical(np.zeros((2, 2))), 0.5)
    np.testing.assert_allclose(np.exp(fits.poisson(np.array([1.5, 1.5]), np.array([[2.5], [6.5]]))), [[2.5 / 1.5], [6.5 / 1.5]])
    mean, _ = fits.gaussian(np.array([1.5, 0.5]), np.array([[1.0], [5.0]]), np.array([[[2.0]], [[60.0]]]), old=(np.array([[9.0], [8.0]]), np.ones((2, 1, 1))))
    np.testing.assert_allclose(mean, [[1 / 1.5], [8.0]])  # too little weight keeps the old mean


def test_alignment_helpers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    rotation = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    target = 2 * x @ rotation.T + 1
    np.testing.assert_allclose(align.procrustes(x, target).apply(x), target, atol=1e-9)
    np.testing.assert_allclose(align.affine_map(x, target).apply(x), target, atol=1e-9)
    order, signs = align.signed_permutation(x, np.stack([-x[:, 2], x[:, 0], x[:, 1]], 1))
    assert order.tolist() == [2, 0, 1] and signs.tolist() == [-1, 1, 1]
    counts = np.array([[[9.0, 1.0], [2.0, 8.0]], [[8.0, 2.0], [1.0, 9.0]]])
    assert align.align_markov_counts(np.array([[5.0, 1.0], [1.0, 5.0]]), counts)[1].tolist() == [1, 0]


def test_validation_counts(spark):
    good = source.from_arrays(spark, [[np.arange(3.0)]])
    assert not any(source.violations(good).first())
    bad = good.where("t <> 1").withColumn("y", F.array(F.lit(float("nan"))))
    found = source.violations(bad).first().asDict()
    assert found["gaps"] == 1 and found["not_finite"] == 2
    with pytest.raises(ValueError):
        source.validate(bad)


def test_collections_align_and_pool(spark):
    from driftline.plans.collections import Collection

    model = HMM(HMM_PARAMS | {"emissions": HMM_PARAMS["emissions"] * 2})
    data = model.sample(spark, {0: [40] * 3, 1: [30] * 3}, seed=11).drop("z", "x").cache()
    own = HMM(HMM_PARAMS)
    both = Collection({0: own, 1: own.permute_states([1, 0])})
    pooled = both.combine(data)
    means = [e["mean"][:, 0].tolist() for e in pooled.params["emissions"]]
    assert means[0] == means[1]
    assert both.infer(data).count() == data.count()
    assert both.get(1).params["emissions"][0]["mean"][0, 0] == 4
    with pytest.raises(ValueError):
        both.get()


def shifted(spark, ids):
    """Two sessions with identifiers ``ids``, the second with two coordinates on another scale."""
    rng = np.random.default_rng(31)
    rows = []
    for s, session in enumerate(ids):
        for seq in range(3):
            for t in range(40):
                rows.append((session, seq, t, [float(v) for v in rng.normal(4.0 * (t // 10 % 2) + 10 * s, 1.0, s + 1)], [], True))
    return spark.createDataFrame(rows, "session int, seq long, t int, y array<double>, u array<double>, visible boolean")


def test_sessions_go_by_identifier(spark, tmp_path):
    """Identifiers that don't begin at 0, or have gaps, give what sessions 0 and 1 give, in every family."""
    plain, moved = shifted(spark, [0, 1]), shifted(spark, [5, 9])
    for start in (lambda e: HMM.initialize(e, 2), lambda e: ARHMM.initialize(e, 2), lambda e: LDS.initialize(e, 1), lambda e: SLDS.initialize(e, 2, 1)):
        a, b = start(plain), start(moved)
        assert [s for s, _ in b.params["emissions"].items()] == [5, 9]
        fa, fb = a.fit(plain, 2), b.fit(moved, 2)
        np.testing.assert_allclose(fa.trace, fb.trace, rtol=1e-6)
        for k, v in fa.model.params["emissions"][1].items():
            np.testing.assert_allclose(v, fb.model.params["emissions"][9][k], rtol=1e-5, atol=1e-7)
    fb.model.save(spark, str(tmp_path / "m"))
    assert [s for s, _ in type(fb.model).load(spark, str(tmp_path / "m")).params["emissions"].items()] == [5, 9]
    with pytest.raises(Exception, match="no emissions of session"):
        a.infer(moved).collect()
    with pytest.raises(ValueError):
        HMM.initialize(plain.limit(0), 2)


@pytest.mark.parametrize("family", ["hmm", "arhmm", "lds", "slds"])
def test_diagonal_covariances(spark, tmp_path, family):
    """Fits keep zeros off the diagonal, raise the objective and are stored as such; variances are those of weighted sums."""
    rng = np.random.default_rng(32)
    rows = []
    for seq in range(4):
        x = np.cumsum(rng.normal(size=60)) * 0.3
        for t in range(60):
            rows.append((0, seq, t, [float(x[t] + rng.normal() * 0.5), float(2 * x[t] + rng.normal())], [], True))
    e = spark.createDataFrame(rows, "session int, seq long, t int, y array<double>, u array<double>, visible boolean")
    model = {"hmm": lambda: HMM.initialize(e, 2, diagonal=True), "arhmm": lambda: ARHMM.initialize(e, 2, diagonal=True), "lds": lambda: LDS.initialize(e, 2, diagonal=True), "slds": lambda: SLDS.initialize(e, 2, 2, diagonal=True)}[family]()
    fit = model.fit(e, 3)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(fit.trace, fit.trace[1:], strict=False)) or family == "slds"
    own = [fit.model.params["emissions"][0]["covariance"], *[fit.model.params[k] for k in fit.model.noises if k in fit.model.params]]
    assert all((np.abs(c * (1 - np.eye(2))) == 0).all() and (np.einsum("...ii->...i", c) > 0).all() for c in own)
    fit.model.save(spark, str(tmp_path / "m"))
    again = type(model).load(spark, str(tmp_path / "m"))
    assert again.diagonal and type(again) is type(model)
    if family == "hmm":
        gamma = np.array([r["gamma"] for r in model.infer(e).orderBy("seq", "t").collect()])
        y = np.array([r[3] for r in rows])
        one = model.fit(e, 1).model.params["emissions"][0]
        mean = gamma.T @ y / gamma.sum(0)[:, None]
        np.testing.assert_allclose(one["mean"], mean, rtol=1e-6)
        spread = np.array([(gamma[:, k, None] * (y - mean[k]) ** 2).sum(0) / gamma[:, k].sum() for k in range(2)])
        np.testing.assert_allclose(np.einsum("kii->ki", one["covariance"]), spread, rtol=1e-4)
        with pytest.raises(ValueError):
            HMM(model.params | {"emissions": [one | {"covariance": np.ones((2, 2, 2))}]}, diagonal=True)


def test_starts_of_many_sessions_take_as_many_jobs_as_one(spark):
    """Clusters of all sessions at once are those of each alone, and a session without a visible step is named."""
    from driftline.operators import cluster

    rng = np.random.default_rng(41)
    rows = [(s, 0, t, [float(v) for v in rng.normal(5.0 * (t % 2) + s, 0.3, 1 + s % 2)], [], True) for s in range(6) for t in range(30)]
    e = spark.createDataFrame(rows, "session int, seq long, t int, y array<double>, u array<double>, visible boolean").cache()
    together = HMM.initialize(e, 2, seed=3)
    for s in (0, 3, 5):
        own = e.where(F.col("session") == s)
        np.testing.assert_allclose(together.params["emissions"][s]["mean"], HMM.initialize(own, 2, seed=3).params["emissions"][s]["mean"])
        start = cluster.farthest_first(own, F.col("y"), 2, 3)
        np.testing.assert_allclose(cluster.spread_centers(e, 2, 3)[s], start)
        n, first, _ = cluster.partition(e, 2, 3)[s]
        np.testing.assert_allclose(first / n[:, None], cluster.kmeans(own, F.col("y"), start, 20))
    same = e.withColumn("y", F.array(F.lit(1.0)))
    n, first, _ = cluster.partition(same, 2)[0]
    assert n.tolist() == [30, 30] and first.tolist() == [[30.0], [30.0]]
    hidden = e.withColumn("visible", F.col("session") != 2)
    for start in (lambda: HMM.initialize(hidden, 2), lambda: ARHMM.initialize(hidden, 2), lambda: LDS.initialize(hidden, 1)):
        with pytest.raises(ValueError, match="2"):
            start()
