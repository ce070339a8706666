"""Starting points of latent models: pseudo-latents by principal components, what follows from known latents, and switching
systems from AR-HMMs of pseudo-latents.

Tables with latents are sequence tables with one more column, ``x`` (array<double>). Statistics of all sessions come from one
aggregation; what reaches the driver has the size of the parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import fits
from driftline.functions.dists import Affine, floored
from driftline.operators import chains, cluster, learning, moments
from driftline.operators.structure import interpolated, order
from driftline.functions.observations import GAUSSIAN, POISSON, Likelihood, likelihood_kind
from driftline.plans.models import ARHMM, LDS, SLDS, Emissions, _sessions, fit_models, regress_counts

#: Fixed value: counts below it are raised to it before the logarithm.
COUNT_FLOOR = 0.1


def link(y: Column, observations: str | Likelihood, count_floor: float = COUNT_FLOOR) -> Column:
    """Observations as principal components see them: counts by their floored logarithm, others by their likelihood's link."""
    if observations == POISSON:
        return F.transform(y, lambda v: F.log(F.greatest(v, F.lit(count_floor))))
    kind = likelihood_kind(observations)
    return y if kind is None else F.transform(y, kind.link)


def projections(sequences: DataFrame, latent_dim: int, observations: str = GAUSSIAN) -> dict[int, Affine]:
    """The centred projection of each session onto its leading components; sessions share no coordinates.

    ValueError where a session has fewer coordinates than ``latent_dim``, or fewer than ``latent_dim + 1`` visible steps.
    """
    rows = sequences.where("visible").withColumn("y", link(F.col("y"), observations))
    sums = moments.vector_sums(rows, "y", "session")
    out = {}
    for session in _sessions(sequences):
        n, first, second = sums.get(session, (0.0, np.zeros(0), np.zeros((0, 0))))
        if n < latent_dim + 1:
            raise ValueError(f"session {session} has {n:.0f} visible steps; {latent_dim + 1} are needed")
        if not 1 <= latent_dim <= len(first):
            raise ValueError(f"{latent_dim} latents of {len(first)} coordinates")
        mean, cov = fits.moments(np.asarray(n), first, second)
        w = cluster.leading(cov, latent_dim)[0].T
        out[session] = Affine(w, -w @ mean)
    return out


def pseudo_latents(sequences: DataFrame, latent_dim: int, observations: str = GAUSSIAN) -> DataFrame:
    """Adds ``x``, the projection of each visible step (zeros where hidden)."""
    maps = [(s, f.coefficients.tolist(), f.bias.tolist()) for s, f in projections(sequences, latent_dim, observations).items()]
    table = sequences.sparkSession.createDataFrame(maps, "session int, _w array<array<double>>, _b array<double>")
    y = link(F.col("y"), observations)

    def coordinate(row: Column, bias: Column) -> Column:
        return F.aggregate(F.zip_with(row, y, lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v) + bias

    x = F.when(F.col("visible"), F.zip_with("_w", "_b", coordinate)).otherwise(F.transform("_b", lambda _: F.lit(0.0)))
    # Broadcast, as a join with a constant session would be a product of all partitions of both sides.
    return sequences.join(F.broadcast(table), "session").withColumn("x", x).drop("_w", "_b")


def as_observations(rows: DataFrame) -> DataFrame:
    """The latents as a sequence table of their own, without inputs."""
    return rows.select("session", "seq", "t", F.col("x").alias("y"), F.array().cast("array<double>").alias("u"), "visible")


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Sizes of latents and inputs."""
    first = rows.select(F.size("x").alias("x"), F.size("u").alias("u")).first()
    if first is None:
        raise ValueError("a table without sequences has nothing to start a model from")
    return first["x"], max(first["u"], 0)


def emissions_from_latents(rows: DataFrame, observations: str = GAUSSIAN, diagonal: bool = False) -> Emissions:
    """Regressions of each session's visible observations on its latents; ValueError where a session has no visible step."""
    d, _ = _sizes(rows)
    seen = rows.where("visible")
    sums = moments.vector_sums(seen.withColumn("v", F.concat("x", "y")), "v", "session")
    missing = sorted(set(_sessions(rows)) - set(sums))
    if missing:
        raise ValueError(f"no visible step in sessions {missing}")
    if observations == GAUSSIAN:
        out = {}
        for session, (n, first, second) in sums.items():
            w, b, c = fits.regression(np.asarray(n), first, second, d, floor=fits.INIT_FLOOR, diagonal=diagonal)
            out[session] = {"coefficients": w, "bias": b, "covariance": c}
        return Emissions(out)
    table = seen.select("session", F.array(F.lit(1.0)).alias("w"), "x", "y", F.array().cast("array<double>").alias("spread")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        begin = {s: (np.zeros((len(first) - d, d)), fits.poisson(np.asarray(n), first[d:]) if observations == POISSON else np.zeros(len(first) - d)) for s, (n, first, _) in sums.items()}
        return Emissions({s: {"coefficients": w, "bias": b} for s, (w, b) in regress_counts(table, begin, 20, likelihood_kind(observations).statistics).items()})
    finally:
        table.unpersist()


def lds_from_latents(rows: DataFrame, emissions: Emissions, observations: str = GAUSSIAN, diagonal: bool = False) -> LDS:
    """Initial state of visible sequence starts and dynamics of adjacent visible steps, all sessions together.

    One visible start alone has the covariance of all latents. ValueError without a visible start, or with fewer than two
    adjacent pairs.
    """
    d, inputs = _sizes(rows)
    parts = moments.joint_sums(rows.where("visible").withColumn("_start", F.col("t") == 0), F.col("x"), F.lit(1.0), d, ["_start"])
    if (True,) not in parts:
        raise ValueError("no sequence has a visible start")
    n, first, second = parts[True,]
    mean, cov = fits.moments(np.asarray(n), first, second)
    _, spread = fits.moments(*[np.asarray(sum(p[i] for p in parts.values())) for i in range(3)])
    before = {"_x": F.lag("x").over(order()), "_v": F.lag("visible").over(order())}
    pairs = rows.withColumns(before).where("visible and _v").select(F.concat("_x", "u", "x").alias("v"))
    tn, ts, tq = moments.joint_sums(pairs, F.col("v"), F.lit(1.0), 2 * d + inputs, [])[()]
    if tn < 2:
        raise ValueError("fewer than two adjacent visible steps")
    w, b, q = fits.regression(np.asarray(tn), ts, tq, d + inputs, floor=fits.INIT_FLOOR, diagonal=diagonal)
    shared = {"initial_mean": mean, "initial_covariance": floored(cov if n > 1 else spread, fits.INIT_FLOOR, spread), "dynamics_coefficients": w[:, :d], "dynamics_bias": b, "dynamics_covariance": q}
    if inputs:
        shared["dynamics_input_coefficients"] = w[:, d:]
    return LDS(shared | {"emissions": emissions}, observations, diagonal)


def lds_via_pca(sequences: DataFrame, latent_dim: int, observations: str = GAUSSIAN, diagonal: bool = False) -> LDS:
    """Pseudo-latents, and the emissions and dynamics that follow from them."""
    rows = pseudo_latents(sequences, latent_dim, observations).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return lds_from_latents(rows, emissions_from_latents(rows, observations, diagonal), observations, diagonal)
    finally:
        rows.unpersist()


def slds_from_arhmm(arhmm: ARHMM, latents: DataFrame, emissions: Emissions, observations: str = GAUSSIAN, diagonal: bool = False) -> SLDS:
    """A switching system whose chain and dynamics are those of an AR-HMM of one lag over ``latents`` (:func:`as_observations`).

    State occupancy gives the initial probabilities, and latents that count give each state's initial Gaussian; states
    with too little weight take the Gaussian of all. All sessions of ``latents`` are pooled: dynamics are shared, so the AR-HMM
    has the regression of one session, which stands for all.
    """
    if arhmm.offset != 1 or arhmm.observations != GAUSSIAN or len(arhmm.params["emissions"]) != 1:
        raise ValueError("an AR-HMM of one lag, Gaussian observations and one session is needed")

    def statistics(b: learning.Batch) -> dict[str, np.ndarray]:
        b = b.as_session(own)
        gamma = arhmm._infer(b)[0].gamma
        y, _, w, lengths = arhmm.windows(b)
        y = np.where(w[..., None] > 0, y, 0.0)
        g = gamma * w[..., None]
        on = chains.valid(lengths, y.shape[1])
        return {"counts": (gamma * on[..., None]).sum((0, 1)), "n": g.sum((0, 1)), "s": np.einsum("btk,btd->kd", g, y), "q": np.einsum("btk,btd,bte->kde", g, y, y)}

    own = next(s for s, _ in arhmm.params["emissions"].items())
    with learning.Packed(latents) as data:
        sums = list(data.sums(statistics).values())
    counts, n, s, q = (sum(x[k] for x in sums) for k in ("counts", "n", "s", "q"))
    k = len(counts)
    pooled = fits.gaussian(n.sum(), s.sum(0), q.sum(0), floor=fits.INIT_FLOOR)
    means, covs = fits.gaussian(n, s, q, (np.tile(pooled[0], (k, 1)), np.tile(pooled[1], (k, 1, 1))), floor=fits.INIT_FLOOR)
    e = next(iter(arhmm.params["emissions"]))
    noise = e["covariance"] * np.eye(means.shape[-1]) if diagonal else e["covariance"]
    return SLDS({
        "initial_probs": fits.categorical(counts), "transition_probs": arhmm.params["transition_probs"], "latent_initial_means": means, "latent_initial_covariances": covs,
        "dynamics_coefficients": e["coefficients"], "dynamics_bias": e["bias"], "dynamics_covariances": noise, "emissions": emissions,
    }, observations, diagonal)


def slds_via_arhmm(sequences: DataFrame, num_states: int, latent_dim: int, observations: str = GAUSSIAN, num_iters: int = 10, seed: int = 0, diagonal: bool = False) -> SLDS:
    """Pseudo-latents, an AR-HMM of them fitted for ``num_iters`` steps, and the switching system it gives.

    Sessions are projected each by itself and then pooled, whatever their widths. Inputs have no part in the AR-HMM; their
    coefficients start at zero, and fits of the system learn them. Every sequence needs two steps.
    """
    rows = pseudo_latents(sequences, latent_dim, observations).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _, inputs = _sizes(rows)
        latents = as_observations(rows)
        start = ARHMM.initialize(latents, num_states, 1, seed=seed, pooled=True)
        with learning.Packed(latents) as data:
            arhmm = fit_models({0: start}, data, num_iters, {s: [0] for s in data.sessions})[0].model
        found = slds_from_arhmm(arhmm, latents, emissions_from_latents(rows, observations, diagonal), observations, diagonal)
        return found.replace(dynamics_input_coefficients=np.zeros((num_states, latent_dim, inputs))) if inputs else found
    finally:
        rows.unpersist()


def initial_latents(model: LDS, sequences: DataFrame, refinements: int = 3, count_floor: float = COUNT_FLOOR) -> DataFrame:
    """(session, seq, t, x): latents whose emission means come closest to the observations, hidden ones completed.

    Gaps are interpolated, sequences without a visible step take the mean at zero latents, and each refinement replaces
    hidden steps by what the latents so far predict.
    """
    full = interpolated(sequences).withColumn("y", F.col("completed")).drop("completed")
    counts = model.observations == POISSON

    def make(b: learning.Batch) -> pd.DataFrame:
        e = model.params["emissions"][b.session]
        there = Affine(e["coefficients"], e["bias"])
        back = there.pseudoinverse()

        def predicted(y: np.ndarray) -> np.ndarray:
            eta = there.apply(inverted(y))
            return np.exp(eta) if counts else eta

        def inverted(y: np.ndarray) -> np.ndarray:
            return back.apply(np.log(np.maximum(y, count_floor)) if counts else y)

        seen = b.weight[..., None] > 0
        y = np.where(seen.any(1, keepdims=True), b.y, np.exp(e["bias"]) if counts else e["bias"])
        for _ in range(refinements):
            y = np.where(seen, b.y, predicted(y))
        return learning.step_rows(b, {"x": inverted(y)})

    return learning.rows(learning.packed(full), "session int, seq long, t int, x array<double>", make)
