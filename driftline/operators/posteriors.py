"""Stored posteriors in other coordinates, labels and time steps, without inferring anew: column expressions that stay in the JVM.

Rows are those of ``infer``: gamma, state and xi_next of states, mean, cov and cross_next of latents; what a table doesn't
have is left alone. Neighbouring steps meet by a join on (session, seq, t), so one long sequence is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import columns
from driftline.functions.dists import Affine


def _weighted(weights, terms: list[Column]) -> Column:
    kept = [t if w == 1 else t * float(w) for w, t in zip(weights, terms, strict=True) if w]
    return reduce(lambda a, b: a + b, kept) if kept else F.lit(0.0)


def congruence(matrix: Column, w: np.ndarray) -> Column:
    """W M W' of a matrix column; null stays null."""
    out, size = w.shape
    left = F.array(*[F.array(*[_weighted(w[i], [matrix[k][j] for k in range(size)]) for j in range(size)]) for i in range(out)])
    # ``transform`` over an array of one binds W M, which every entry uses.
    full = F.transform(F.array(left), lambda m: F.array(*[F.array(*[_weighted(w[j], [m[i][k] for k in range(size)]) for j in range(out)]) for i in range(out)]))[0]
    return F.when(matrix.isNotNull(), full)


def aligned(posterior: DataFrame, f: Affine) -> DataFrame:
    """Latents x as f(x): means, covariances and cross covariances of neighbouring steps."""
    w = np.asarray(f.coefficients, float)
    made = {"mean": columns.affine(F.col("mean"), w, np.asarray(f.bias, float))}
    made |= {c: congruence(F.col(c), w) for c in ("cov", "cross_next") if c in posterior.columns}
    return posterior.withColumns(made)


def shifted(posterior: DataFrame, shift: np.ndarray) -> DataFrame:
    """Latents x as x + shift."""
    return posterior.withColumn("mean", F.array(*[F.col("mean")[i] + float(v) for i, v in enumerate(shift)]))


def reordered(posterior: DataFrame, order: np.ndarray, signs: np.ndarray | None = None) -> DataFrame:
    """New coordinate i is old coordinate order[i], times signs[i]."""
    n = len(order)
    w = np.zeros((n, n))
    w[np.arange(n), _permutation(order)] = 1.0 if signs is None else np.asarray(signs, float)
    return aligned(posterior, Affine(w, np.zeros(n)))


def _with_next(posterior: DataFrame) -> DataFrame:
    """Adds _mean and _cov of the next step, null at the end."""
    later = posterior.select("session", "seq", (F.col("t") - 1).alias("t"), F.col("mean").alias("_mean"), F.col("cov").alias("_cov"))
    return posterior.join(later, ["session", "seq", "t"], "left")


def _permutation(order) -> np.ndarray:
    order = np.asarray(order, int)
    if sorted(order.tolist()) != list(range(len(order))):
        raise ValueError(f"not a permutation: {order.tolist()}")
    return order


def permuted_states(posterior: DataFrame, order: np.ndarray) -> DataFrame:
    """New state k is old state order[k]; the state of a step stays the likeliest one, the lowest of equal ones."""
    order = _permutation(order).tolist()
    gamma = F.array(*[F.col("gamma")[k] for k in order])
    made = {"gamma": gamma}
    if "state" in posterior.columns:
        made["state"] = columns.argmax(gamma)
    if "xi_next" in posterior.columns:
        xi = F.col("xi_next")
        made["xi_next"] = F.when(xi.isNotNull(), F.array(*[F.array(*[xi[i][j] for j in order]) for i in order]))
    return posterior.withColumns(made)


def align(posterior: DataFrame, order: np.ndarray | None = None, f: Affine | None = None) -> DataFrame:
    """States first, then latents: a posterior under ``model.permute_states(order).align(f)``."""
    out = posterior if order is None else permuted_states(posterior, order)
    return out if f is None else aligned(out, f)


def pairs(posterior: DataFrame) -> DataFrame:
    """(session, seq, t, mean, cov) of (x_t, x_t+1) stacked, for every step with a next one."""
    rows = _with_next(posterior).where("cross_next is not null")

    def stacked(cov: Column, cross: Column, later: Column) -> Column:
        upper = F.zip_with(cov, cross, lambda a, b: F.concat(a, b))
        back = F.transform(F.sequence(F.lit(0), F.size(cross) - 1), lambda j: F.transform(cross, lambda row: row[j]))
        return F.concat(upper, F.zip_with(back, later, lambda a, b: F.concat(a, b)))

    return rows.select("session", "seq", "t", F.concat("mean", "_mean").alias("mean"), stacked(F.col("cov"), F.col("cross_next"), F.col("_cov")).alias("cov"))


def upsampled(posterior: DataFrame, factor: int) -> DataFrame:
    """(session, seq, i, time, mean, cov): ``factor`` - 1 steps between neighbours, so L steps give (L - 1) * factor + 1.

    Step i lies at time i / factor; means and covariances run linearly from step to step (a display of marginals, not a posterior
    between steps).
    """
    if factor < 1:
        raise ValueError(f"a factor of {factor}")
    rows = _with_next(posterior.select("session", "seq", "t", "mean", "cov"))
    steps = F.when(F.col("_mean").isNull(), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(factor))))
    rows = rows.withColumn("_j", F.explode(steps)).withColumn("_a", F.col("_j") / F.lit(float(factor)))

    def between(a: Column, b: Column) -> Column:
        return a * (1 - F.col("_a")) + b * F.col("_a")

    mean = F.when(F.col("_j") == 0, F.col("mean")).otherwise(F.zip_with("mean", "_mean", between))
    cov = F.when(F.col("_j") == 0, F.col("cov")).otherwise(F.zip_with("cov", "_cov", lambda p, q: F.zip_with(p, q, between)))
    return rows.select("session", "seq", (F.col("t").cast("long") * factor + F.col("_j")).alias("i"), (F.col("t") + F.col("_a")).alias("time"), mean.alias("mean"), cov.alias("cov"))
