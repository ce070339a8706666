"""Models in the labels and coordinates of known states and latents, from sums over the joined steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import fits
from driftline.functions.dists import Affine
from driftline.operators import align, moments
from driftline.plans.models import LDS, SLDS

KEYS = ["session", "seq", "t"]


def latent_map(posterior: DataFrame, targets: DataFrame) -> Affine:
    """The least-squares map of posterior means onto ``targets`` (session, seq, t, x)."""
    rows = posterior.select(*KEYS, "mean").join(targets.select(*KEYS, "x"), KEYS)
    sums = moments.vector_sums(rows.select(F.lit(0).alias("k"), F.concat("mean", "x").alias("v")), "v", "k")
    if not sums:
        raise ValueError("posterior and targets have no step in common")
    d = len(posterior.select("mean").first()[0])
    n, first, second = sums[0]
    mean, cov = fits.moments(np.asarray(n), first, second)
    w = (np.linalg.pinv(cov[:d, :d]) @ cov[:d, d:]).T
    return Affine(w, mean[d:] - w @ mean[:d])


def state_order(posterior: DataFrame, truth: DataFrame) -> np.ndarray:
    """For each true state of ``truth`` (session, seq, t, z), the posterior state that meets it most."""
    k = len(posterior.select("gamma").first()[0])
    rows = posterior.select(*KEYS, "gamma").join(truth.select(*KEYS, "z"), KEYS)
    met = np.zeros((k, k))
    for r in rows.groupBy("z").agg(*[F.sum(F.col("gamma")[i]).alias(f"g{i}") for i in range(k)]).collect():
        if not 0 <= r["z"] < k:
            raise ValueError(f"state {r['z']} of {k}")
        met[:, r["z"]] = [r[f"g{i}"] for i in range(k)]
    return align.match_to_truth(met)


def align_to_latents(model: LDS, sequences: DataFrame, targets: DataFrame) -> LDS:
    """The model in the coordinates in which its posterior means lie closest to ``targets``."""
    return model.align(latent_map(model.infer(sequences), targets))


def align_to_truth(model: SLDS, sequences: DataFrame, truth: DataFrame) -> SLDS:
    """States first, by ``z``, then coordinates, by ``x``, under the posterior of the relabelled model."""
    return align_to_latents(model.permute_states(state_order(model.infer(sequences), truth)), sequences, truth)
