"""Random walks whose steps are as wide as a hidden gate says: mean field between the chain of gates and the walk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from driftline.functions.observations import GAUSSIAN
from driftline.operators import chains, learning
from driftline.operators.learning import Batch
from driftline.plans.models import SLDS


class GatedWalk(SLDS):
    """x_t = x_t-1 + N(0, innovations[z_t]), with gates z_t a Markov chain, observed as C x + d + N(0, R) or by a likelihood.

    Params: initial_probs, transition_probs, start_mean (D,), start_covariance (D, D), innovations (K, D, D); emissions as LDS.
    Gates choose innovations only, so of the dynamics fits learn these alone.
    """

    family = "walk"
    inference_iters = 8
    even_start = True

    def __init__(self, params: dict, observations=GAUSSIAN, diagonal: bool = False):
        p = {k: np.asarray(v, float) for k, v in params.items() if k not in ("emissions", "innovations", "start_mean", "start_covariance")}
        q = np.asarray(params["innovations"] if "innovations" in params else params["dynamics_covariances"], float)
        k, d = q.shape[:2]
        if "start_mean" in params:
            p |= {"latent_initial_means": np.tile(params["start_mean"], (k, 1)), "latent_initial_covariances": np.tile(params["start_covariance"], (k, 1, 1))}
        p |= {"dynamics_coefficients": np.tile(np.eye(d), (k, 1, 1)), "dynamics_bias": np.zeros((k, d)), "dynamics_covariances": q}
        super().__init__(p | {"emissions": params["emissions"]}, observations, diagonal)

    def _maximise(self, sums: learning.Sums, newer: dict) -> GatedWalk:
        """Walks stay walks: innovations are the mean squares of steps, and all gates share one start."""
        found = super()._maximise(sums, newer).params
        add = {k: sum(s[k] for s in sums.values()) for k in ("tn", "tq", "xn", "xs", "xq", "all_n", "all_s", "all_q")}
        d = len(self.params["dynamics_bias"][0])
        q, n = add["tq"], np.maximum(add["tn"], np.finfo(float).tiny)[:, None, None]
        steps = (q[:, :d, :d] + q[:, -d:, -d:] - q[:, :d, -d:] - q[:, -d:, :d]) / n
        if self.diagonal:
            steps = steps * np.eye(d)
        steps = np.where((add["tn"] < 1.0)[:, None, None], self.params["dynamics_covariances"], steps + 1e-12 * np.eye(d))
        total = max(add["xn"].sum(), 1.0)
        mean = add["xs"].sum(0) / total
        cov = add["xq"].sum(0) / total - np.outer(mean, mean)
        floor = 1e-6 * np.trace(add["all_q"] / max(float(add["all_n"]), 1.0)) / d
        return self.replace(
            initial_probs=found["initial_probs"], transition_probs=found["transition_probs"], emissions=found["emissions"], dynamics_covariances=steps,
            latent_initial_means=np.tile(mean, (len(steps), 1)), latent_initial_covariances=np.tile(chains.symmetric(cov) + floor * np.eye(d), (len(steps), 1, 1)),
        )

    def bounds(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, iteration, bound): the lower bound of each sequence's log-likelihood after every round of mean field."""

        def make(b: Batch) -> pd.DataFrame:
            post, _ = self._infer(b)
            rounds, n = post.trace.shape[1], len(b.seq)
            return pd.DataFrame({"session": np.int32(b.session), "seq": np.repeat(b.seq, rounds), "iteration": np.tile(np.arange(rounds, dtype=np.int32), n), "bound": post.trace.ravel()})

        return learning.rows(learning.packed(sequences), "session int, seq long, iteration int, bound double", make)
