"""Gaussian mass on rectangular grids: cell masses by tensor Gauss-Legendre quadrature."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.dists import Gaussian


def cell_masses(mean: np.ndarray, cov: np.ndarray, edges: Sequence[np.ndarray], order: int = 3) -> np.ndarray:
    """(N, cells...) mass of N normals (N, D) in the cells between ``edges`` (up to three dimensions)."""
    if len(edges) > 3:
        raise ValueError("at most three dimensions")
    nodes, weights = np.polynomial.legendre.leggauss(order)
    points, masses = [], []
    for e in edges:
        e = np.asarray(e, float)
        half = np.diff(e) / 2
        points.append(((e[:-1] + half)[:, None] + half[:, None] * nodes).ravel())
        masses.append((half[:, None] * weights).ravel())
    mesh = np.stack(np.meshgrid(*points, indexing="ij"), -1)
    weight = masses[0]
    for m in masses[1:]:
        weight = weight[..., None] * m
    shape = [x for e in edges for x in (len(e) - 1, order)]
    inner = tuple(range(2, 2 * len(edges) + 1, 2))
    out = []
    for m, c in zip(mean, cov, strict=True):  # one density at a time keeps memory at one grid
        density = np.exp(Gaussian(m[None], c[None]).log_prob(mesh.reshape(-1, len(edges)))[:, 0]).reshape(weight.shape)
        out.append((density * weight).reshape(shape).sum(tuple(i - 1 for i in inner)))
    return np.array(out)


def density(mass: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    volume = np.diff(edges[0])
    for e in edges[1:]:
        volume = volume[..., None] * np.diff(e)
    return mass / volume


def outside(mass: np.ndarray, dims: int) -> np.ndarray:
    """What lies beyond the grid, not clipped."""
    return 1 - mass.sum(tuple(range(-dims, 0)))


def occupancy(posterior: DataFrame, edges: Sequence[np.ndarray], variables: Sequence[int], order: int = 3) -> DataFrame:
    """(session, seq, cell, mass): time-averaged mass of each cell from posterior rows (mean, cov).

    Partial sums are made within Arrow batches, so what is shuffled has the size of grids, not of steps times grids.
    """
    at = list(variables)

    def run(frames):
        for frame in frames:
            for (session, seq), own in frame.groupby(["session", "seq"]):
                mean = np.array(own["mean"].tolist())[:, at]
                cov = np.array([np.vstack(c) for c in own["cov"]])[:, at][:, :, at]
                mass = cell_masses(mean, cov, edges, order).sum(0)
                yield pd.DataFrame({"session": session, "seq": seq, "cell": [list(i) for i in np.ndindex(mass.shape)], "mass": mass.ravel(), "n": len(own)})

    parts = posterior.select("session", "seq", "mean", "cov").mapInPandas(run, "session int, seq long, cell array<int>, mass double, n long")
    return parts.groupBy("session", "seq", "cell").agg((F.sum("mass") / F.sum("n")).alias("mass"))


def per_step(posterior: DataFrame, edges: Sequence[np.ndarray], variables: Sequence[int], order: int = 3) -> DataFrame:
    """(session, seq, t, cell, mass): the mass of each cell at each step; its average over a sequence is :func:`occupancy`."""
    at = list(variables)

    def run(frames):
        for frame in frames:
            for own in (frame.iloc[i : i + 64] for i in range(0, len(frame), 64)):  # a bounded number of grids at once
                mean = np.array(own["mean"].tolist())[:, at]
                cov = np.array([np.vstack(c) for c in own["cov"]])[:, at][:, :, at]
                mass = cell_masses(mean, cov, edges, order)
                cells = mass[0].size
                out = {k: np.repeat(own[k].to_numpy(), cells) for k in ("session", "seq", "t")}
                yield pd.DataFrame(out | {"cell": [list(i) for i in np.ndindex(mass.shape[1:])] * len(own), "mass": mass.ravel()})

    return posterior.select("session", "seq", "t", "mean", "cov").mapInPandas(run, "session int, seq long, t int, cell array<int>, mass double")
