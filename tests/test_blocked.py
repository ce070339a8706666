"""Blocks of time against whole sequences, and the tree's elements against dense products."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import blocked, chains, learning
from driftline.plans.models import ARHMM, HMM, LDS, POISSON, SLDS
from driftline.sources import sequences as source

RNG = np.random.default_rng


def table(spark, lengths, dim=1, inputs=0, seed=0):
    rng = RNG(seed)
    y = [[rng.normal(size=(n, dim)) * 2 + rng.integers(0, 3, (n, 1)) for n in own] for own in lengths]
    u = [[rng.normal(size=(n, inputs)) for n in own] for own in lengths] if inputs else None
    seen = [[rng.random(n) > 0.2 for n in own] for own in lengths]
    return source.from_arrays(spark, y, u, seen)


def hmm(k=3, sessions=2, dim=1, seed=1):
    rng = RNG(seed)
    p = rng.dirichlet(np.ones(k), k)
    p[0] = np.eye(k)[0] * 0.7 + np.eye(k)[1] * 0.3  # some moves are impossible
    e = [{"mean": rng.normal(size=(k, dim)) * 2, "covariance": np.tile(np.eye(dim), (k, 1, 1))} for _ in range(sessions)]
    return HMM({"initial_probs": np.eye(k)[0], "transition_probs": p, "emissions": e})


def lds(inputs=0, sessions=2):
    rng = RNG(2)
    p = {"initial_mean": [0.3, -0.2], "initial_covariance": [[2, 0.2], [0.2, 1.5]], "dynamics_coefficients": [[0.9, 0.1], [0.0, 0.8]], "dynamics_bias": [0.1, 0.0], "dynamics_covariance": [[0.5, 0.05], [0.05, 0.4]]}
    if inputs:
        p["dynamics_input_coefficients"] = rng.normal(size=(2, inputs))
    return LDS(p | {"emissions": [{"coefficients": rng.normal(size=(1, 2)), "bias": [0.2], "covariance": [[0.8]]} for _ in range(sessions)]})


def rows(df, *columns):
    """{(session, seq, t): values as flat arrays}."""
    return {(r["session"], r["seq"], r["t"]): [None if r[c] is None else np.ravel(np.array(r[c], float)) for c in columns] for r in df.collect()}


def agree(a, b, tolerance=1e-8):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None) == (y is None), k
            if x is not None:
                np.testing.assert_allclose(x, y, atol=tolerance, rtol=tolerance)


LENGTHS = [[1, 2, 7, 8, 9, 16, 17, 40], [3, 33]]


def test_blocks_hold_their_steps_and_share_the_overlap(spark):
    e = table(spark, [[1, 8, 9, 20]])
    for size, overlap in ((4, 0), (4, 1), (3, 2), (1, 1), (100, 5)):
        found = {(r["seq"], r["block"]): (r["start"], [int(v[0] * 0) for v in r["y"]]) for r in blocked.blocks(e, size, overlap).collect()}
        for seq, n in enumerate((1, 8, 9, 20)):
            want = {b: min(n, (b + 1) * size + overlap) - b * size for b in range(n // size + 1) if b == 0 or n - b * size > overlap}
            assert {b: len(y) for (s, b), (_, y) in found.items() if s == seq} == want
    with pytest.raises(ValueError):
        blocked.blocks(e, 0)


@pytest.mark.parametrize(("size", "fan"), [(4, 2), (3, 64), (1, 3), (64, 64)])
def test_states_by_blocks_equal_whole_sequences(spark, size, fan, monkeypatch):
    monkeypatch.setattr(blocked.Blocked.__init__, "__defaults__", (blocked.SIZE, 0, fan, True))
    e, m = table(spark, LENGTHS), hmm()
    agree(rows(m.infer(e), "gamma", "state", "xi_next"), rows(m.infer(e, block=size), "gamma", "state", "xi_next"))
    whole = {(r["session"], r["seq"]): r["objective"] for r in m.objective(e).collect()}
    for r in m.objective(e, block=size).collect():
        assert abs(r["objective"] - whole[r["session"], r["seq"]]) < 1e-8


@pytest.mark.parametrize(("size", "fan", "inputs"), [(4, 2, 0), (3, 64, 2), (1, 3, 0), (64, 64, 1)])
def test_latents_by_blocks_equal_whole_sequences(spark, size, fan, inputs, monkeypatch):
    monkeypatch.setattr(blocked.Blocked.__init__, "__defaults__", (blocked.SIZE, 0, fan, True))
    e, m = table(spark, LENGTHS, inputs=inputs), lds(inputs)
    agree(rows(m.infer(e), "mean", "cov", "cross_next"), rows(m.infer(e, block=size), "mean", "cov", "cross_next"))
    whole = {(r["session"], r["seq"]): r["objective"] for r in m.objective(e).collect()}
    for r in m.objective(e, block=size).collect():
        assert abs(r["objective"] - whole[r["session"], r["seq"]]) < 1e-7


def test_autoregressive_states_by_blocks(spark):
    e = table(spark, [[5, 12, 31]])
    rng = RNG(4)
    m = ARHMM({"initial_probs": [0.6, 0.4], "transition_probs": [[0.8, 0.2], [0.3, 0.7]], "emissions": [{"coefficients": rng.normal(size=(2, 1, 2)) * 0.3, "bias": [[0.0], [1.0]], "covariance": [[[1.0]], [[2.0]]]}]})
    agree(rows(m.infer(e), "gamma", "xi_next"), rows(m.infer(e, block=5), "gamma", "xi_next"))
    agree_fits(m.fit(e, 2), m.fit(e, 2, block=5))


def agree_fits(a, b):
    np.testing.assert_allclose(a.trace, b.trace, rtol=1e-9)
    for k, v in a.model.params.items():
        if k != "emissions":
            np.testing.assert_allclose(v, b.model.params[k], atol=1e-8)
    for s, e in a.model.params["emissions"].items():
        for k, v in e.items():
            np.testing.assert_allclose(v, b.model.params["emissions"][s][k], atol=1e-8)


def test_fits_by_blocks_equal_fits_of_whole_sequences(spark):
    e = table(spark, LENGTHS)
    agree_fits(hmm().fit(e, 3), hmm().fit(e, 3, block=6))
    agree_fits(lds().fit(e, 3), lds().fit(e, 3, block=6))


def test_families_without_blocks_refuse_them(spark):
    e = table(spark, [[5, 5]])
    poisson = LDS(lds(sessions=1).params | {"emissions": [{"coefficients": [[1.0, 0.0]], "bias": [0.0]}]}, POISSON)
    one = SLDS({"initial_probs": [1.0], "transition_probs": [[1.0]], "latent_initial_means": [[0.0]], "latent_initial_covariances": [[[1.0]]], "dynamics_coefficients": [[[0.5]]], "dynamics_bias": [[0.0]], "dynamics_covariances": [[[1.0]]], "emissions": [{"coefficients": [[1.0]], "bias": [0.0], "covariance": [[1.0]]}]})
    for m in (poisson, one):
        with pytest.raises(TypeError):
            m.infer(e, block=2)


def test_an_empty_table_by_blocks(spark):
    e = table(spark, [[3]]).where("false")
    assert hmm().infer(e, block=2).count() == 0 and lds().infer(e, block=2).count() == 0


def test_far_impossible_and_extreme_steps():
    """Elements keep rows apart: a start that is out of question by far still gets its own filter."""
    rng = RNG(5)
    local = rng.normal(size=(1, 30, 3)) * 3
    local[0, 7] = [-5000.0, 0.0, -9000.0]
    local[0, 12] = [0.0, -7000.0, -np.inf]
    p, start = rng.dirichlet(np.ones(3), 3), np.array([0.0, 0.0, 1.0])
    scan = blocked.DiscreteScan(start, p)
    whole = chains.discrete_chain(start, p, local, np.array([30]))
    cut = [local[:, a : a + 10] for a in (0, 10, 20)]
    els = [scan.element(p, c, np.array([10])) for c in cut]
    before, ahead = [scan.start()[0][None]], [scan.start()[1][None]]
    for k in range(2):
        before.append(scan.forward(before[-1], els[k]))
        ahead.insert(0, scan.backward(els[2 - k], ahead[0]))
    parts = [chains.discrete_block(np.exp(before[k]), p, cut[k], np.array([10]), ahead[k]) for k in range(3)]
    np.testing.assert_allclose(np.concatenate([x.gamma for x in parts], 1), whole.gamma, atol=1e-10)
    np.testing.assert_allclose(sum(x.log_normalizer for x in parts), whole.log_normalizer)
    np.testing.assert_allclose(scan.combine(scan.combine(els[0], els[1]), els[2]), scan.combine(els[0], scan.combine(els[1], els[2])), rtol=1e-10)


def test_gaussian_elements_are_integrals_of_dense_factors():
    """An element is what the dense precision leaves of the ends; products are associative."""
    rng = RNG(6)
    d, t = 2, 6
    f = chains.linear_factors(np.zeros(d), np.eye(d), np.broadcast_to(0.7 * np.eye(d), (1, t - 1, d, d)), rng.normal(size=(1, t - 1, d)), np.broadcast_to(np.eye(d) * 0.4, (1, t - 1, d, d)), t, np.array([t]))
    scan = blocked.GaussianScan(d)
    j00, j01, j11, h0, h1, c = scan._pair(scan.element(f))
    dense, info = f.dense_precision(0), f.info[0].ravel()
    ends, inner = np.r_[0:d, (t - 1) * d : t * d], np.arange(d, (t - 1) * d)
    solved = np.linalg.solve(dense[np.ix_(inner, inner)], np.column_stack([dense[np.ix_(inner, ends)], info[inner]]))
    np.testing.assert_allclose(np.block([[j00[0], j01[0]], [j01[0].T, j11[0]]]), dense[np.ix_(ends, ends)] - dense[np.ix_(ends, inner)] @ solved[:, :-1], atol=1e-10)
    np.testing.assert_allclose(np.r_[h0[0], h1[0]], info[ends] - dense[np.ix_(ends, inner)] @ solved[:, -1], atol=1e-10)
    want = f.const[0] + 0.5 * info[inner] @ solved[:, -1] - 0.5 * np.linalg.slogdet(dense[np.ix_(inner, inner)])[1] + 0.5 * len(inner) * np.log(2 * np.pi)
    np.testing.assert_allclose(c[0], want)


def test_numbered_rows_are_gapless_over_many_ranges(spark):
    rng = RNG(7)
    values = [(int(v), i) for i, v in enumerate(rng.integers(0, 50, 997))]
    found = source.numbered(spark.createDataFrame(values, "v int, i int").repartition(7), ["v", "i"]).collect()
    assert [(r["v"], r["i"]) for r in sorted(found, key=lambda r: r["t"])] == sorted(values)
    assert sorted(r["t"] for r in found) == list(range(997))
    assert source.numbered(spark.createDataFrame([], "v int"), ["v"]).count() == 0


def test_batches_take_odd_rows(spark):
    """Null vectors, no inputs, sequences of very unlike lengths: arrays are as they were row by row."""
    e = table(spark, [[1, 50, 3]], dim=2).withColumn("y", F.when(F.col("visible"), F.col("y")))
    parts = learning.packed(e).coalesce(1).toArrow().combine_chunks().to_batches()
    got = list(learning.batches(iter(parts)))
    assert sum(len(b.seq) for b in got) == 3 and {b.u.shape[-1] for b in got} == {0}
    want = {(r["seq"], r["t"]): r for r in e.collect()}
    for b in got:
        for i, s in enumerate(b.seq):
            for t in range(b.lengths[i]):
                r = want[s, t]
                assert b.weight[i, t] == float(r["visible"])
                np.testing.assert_allclose(b.y[i, t], r["y"] if r["visible"] else [0.0, 0.0])


@pytest.mark.parametrize("axis", [0, 1, 2, 3])
def test_log_sums_over_every_axis(axis):
    x = RNG(8).normal(size=(2, 3, 4, 5)) * 300
    x[0, 0, 0] = -np.inf
    x[:, 1, 2, 3] = -np.inf
    np.testing.assert_allclose(chains._log_sum(x, axis), np.logaddexp.reduce(x, axis))


def test_scan_steps_are_sums_over_paths():
    """Products and messages of several elements at once, of as many elements as states and not, against dense matrices."""
    rng = RNG(9)
    for n in (1, 3, 4):
        p, a, b = rng.dirichlet(np.ones(3), 3), rng.random((n, 3, 3)), rng.random((n, 3, 3))
        before, ahead = rng.dirichlet(np.ones(3), n), rng.random((n, 3))
        scan = blocked.DiscreteScan(np.ones(3) / 3, p)
        flat = lambda x: np.log(x).reshape(n, -1)
        np.testing.assert_allclose(scan.combine(flat(a), flat(b)), flat(a @ p @ b))
        after = (before[:, None] @ a @ p)[:, 0]
        np.testing.assert_allclose(np.exp(scan.forward(np.log(before), flat(a))), after / after.sum(1, keepdims=True))
        for beyond, message in ((ahead @ p.T, np.log(ahead)), (np.ones((n, 3)), np.full((n, 3), np.nan))):
            back = (a @ beyond[..., None])[..., 0]
            np.testing.assert_allclose(np.exp(scan.backward(flat(a), message)), back / back.max(1, keepdims=True))


@pytest.mark.parametrize("frames", [0, 1, 3])
def test_rows_take_list_columns_of_several_frames(spark, frames):
    def make(b):
        each = [pd.DataFrame({"session": np.int32(b.session), "seq": b.seq, "x": learning.held(learning.nested(b.y[:, 0] + k))}) for k in range(frames)]
        return pd.concat(each) if each else pd.DataFrame({"session": [], "seq": [], "x": []})

    e = table(spark, [[3, 1, 2]])
    got = sorted((r["seq"], r["x"]) for r in learning.rows(learning.packed(e), "session int, seq long, x array<double>", make).collect())
    first = {r["seq"]: r["y"][0] if r["visible"] else 0.0 for r in e.where("t = 0").collect()}
    assert [s for s, _ in got] == [s for s in range(3) for _ in range(frames)]
    for i, (s, x) in enumerate(got):
        assert np.isclose(x[0], first[s] + i % frames) or first[s] == 0.0
