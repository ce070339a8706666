"""Smooth curves fitted to the values of every sequence: cubic Hermite pieces under a function-space prior.

A sequence's steps lie evenly on [0, 1]. Its curve g has a value and a slope at each knot; the prior weighs
amplitude * int (g - mean of g)^2 + smoothness * int g''^2, so a curve's level is free, and observations have the variance ``noise``.

Spark adds up the normal equations: each step touches the two knots of its cell, so a sequence is (knots - 1) groups of sums
whatever its length, combined before they move. Knots then form a chain of 2 x 2 blocks that is eliminated knot by knot, for
many sequences at once; the level is a border of one unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.processes import HermiteBasis
from driftline.operators import chains
from driftline.operators.blocked import _listed

KEYS = ["session", "seq"]


def _basis(u: Column, h: float) -> list[Column]:
    """Value and slope at the left knot, value and slope at the right one, at place ``u`` in [0, 1] of a cell of width ``h``."""
    return [(u * 2 - 3) * u * u + 1, ((u - 2) * u + 1) * u * h, (u * -2 + 3) * u * u, (u - 1) * u * u * h]


@dataclass(frozen=True)
class CurveModel:
    """A prior over curves with ``knots`` knots, and the variance of observations."""

    knots: int
    amplitude: float
    smoothness: float
    noise: float

    def __post_init__(self) -> None:
        if self.knots < 2 or min(self.amplitude, self.smoothness, self.noise) <= 0:
            raise ValueError("a curve needs two knots, and positive weights and noise")

    def _placed(self, sequences: DataFrame) -> DataFrame:
        """Adds cell and _b, the four basis values of each step; a sequence of one step lies at 0."""
        last = sequences.groupBy(*KEYS).agg(F.max("t").alias("_last"))
        at = F.when(F.col("_last") > 0, F.col("t") / F.col("_last")).otherwise(0.0) * (self.knots - 1)
        rows = sequences.join(last, KEYS).withColumn("_at", at)
        rows = rows.withColumn("cell", F.least(F.floor("_at"), F.lit(self.knots - 2)).cast("int"))
        return rows.withColumn("_b", F.array(*_basis(F.col("_at") - F.col("cell"), 1 / (self.knots - 1)))).drop("_at", "_last")

    def _equations(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, cells, sums): for each cell n, the 10 products of its basis values, and theirs with each observation."""
        b = [F.col("_b")[i] for i in range(4)]
        products = [F.sum(b[i] * b[j]) for i in range(4) for j in range(i, 4)]
        # Observations differ in size by session: their products are kept by coordinate, one row each.
        rows = self._placed(sequences).where("visible").select(*KEYS, "cell", "_b", F.posexplode("y").alias("variable", "_y"))
        sums = rows.groupBy(*KEYS, "variable", "cell").agg(F.array(F.count(F.lit(1)).cast("double"), *products, *[F.sum(x * F.col("_y")) for x in b]).alias("sums"))
        cells = F.sort_array(F.collect_list(F.struct("cell", "sums")))  # no more than there are cells
        return sums.groupBy(*KEYS, "variable").agg(cells.alias("c")).select(*KEYS, F.col("variable").cast("int").alias("variable"), F.col("c.cell").alias("cells"), F.col("c.sums").alias("sums"))

    def _prior(self) -> tuple[np.ndarray, np.ndarray]:
        """(precision (2 knots, 2 knots) of values about a known level, integrals (2 knots,) of the basis)."""
        basis = HermiteBasis(self.knots)
        nodes, weights = basis.quadrature()
        values, bends = basis.raw(nodes), basis.raw(nodes, 2)
        return self.amplitude * values.T @ (weights[:, None] * values) + self.smoothness * bends.T @ (weights[:, None] * bends), weights @ values

    def fit(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, variable, coefficients, covariance): value and slope at every knot, and their posterior covariance within each
        cell, 4 x 4 flat. Sequences without a visible step have no row."""
        k, noise, amplitude = self.knots, self.noise, self.amplitude
        prior, integrals = self._prior()
        names = [*KEYS, "variable", "coefficients", "covariance"]
        upper = [(i, j) for i in range(4) for j in range(i, 4)]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if not part.num_rows:
                    continue
                counts = np.asarray(part.column(3).value_lengths(), np.int64)
                row, cell = np.repeat(np.arange(len(counts)), counts), np.asarray(part.column(3).flatten(), np.int64)
                sums = part.column(4).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
                diag, lower, info = _blocks(prior, len(counts), k)
                local = np.zeros((len(row), 4, 4))
                for m, (i, j) in enumerate(upper):
                    local[:, i, j] = local[:, j, i] = sums[:, 1 + m] / noise
                np.add.at(diag, (row, cell), local[:, :2, :2])
                np.add.at(diag, (row, cell + 1), local[:, 2:, 2:])
                np.add.at(lower, (row, cell), local[:, 2:, :2])
                np.add.at(info, (row, cell), sums[:, 11:13] / noise)
                np.add.at(info, (row, cell + 1), sums[:, 13:15] / noise)
                whole = np.full(len(counts), k)
                given = chains.gaussian_chain(chains.GaussianFactors(diag, lower, info, np.zeros(len(counts)), whole))
                # The level: a border of one unknown that the amplitude ties to the curve.
                tie = np.broadcast_to((amplitude * integrals).reshape(k, 2), info.shape)
                pull = chains.gaussian_chain(chains.GaussianFactors(diag, lower, tie, np.zeros(len(counts)), whole)).mean
                left = amplitude - np.einsum("bki,bki->b", tie, pull)
                level = np.einsum("bki,bki->b", tie, given.mean) / left
                mean = given.mean + pull * level[:, None, None]
                joint = np.block([[given.cov[:, :-1], given.cross], [chains.transpose(given.cross), given.cov[:, 1:]]])
                both = np.concatenate([pull[:, :-1], pull[:, 1:]], -1)
                joint = joint + both[..., :, None] * both[..., None, :] / left[:, None, None, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * (k - 1)), _listed(joint.reshape(-1, 16)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], _listed(mean.reshape(len(counts), -1)), flat], names)

        return self._equations(sequences).mapInArrow(run, "session int, seq long, variable int, coefficients array<double>, covariance array<array<double>>")

    def values(self, sequences: DataFrame, fits: DataFrame) -> DataFrame:
        """(session, seq, t, variable, mean, variance) of the fitted curves at every step, hidden ones too."""
        rows = self._placed(sequences).select(*KEYS, "t", "cell", "_b").join(fits, KEYS)
        b = [F.col("_b")[i] for i in range(4)]
        mean = reduce(lambda x, y: x + y, [b[i] * F.col("coefficients")[F.col("cell") * 2 + i] for i in range(4)])
        variance = reduce(lambda x, y: x + y, [b[i] * b[j] * F.col("covariance")[F.col("cell")][4 * i + j] for i in range(4) for j in range(4)])
        return rows.select(*KEYS, "t", "variable", mean.alias("mean"), variance.alias("variance"))


def _blocks(prior: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prior's 2 x 2 blocks for every row, and room for what the rows add."""
    cut = prior.reshape(k, 2, k, 2)
    diag = np.array([cut[i, :, i] for i in range(k)])
    lower = np.array([cut[i + 1, :, i] for i in range(k - 1)])
    return np.tile(diag, (rows, 1, 1, 1)), np.tile(lower, (rows, 1, 1, 1)), np.zeros((rows, k, 2))
