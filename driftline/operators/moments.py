"""Distributed sufficient statistics and the fits that follow from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import fits
from driftline.operators import learning


def weighted_moments(rows: DataFrame, values: list[Column], weight: Column, keys: list[str]) -> DataFrame:
    """keys, n, m0.. (means) and c0_0.. (population covariances) by partial aggregation; weightless values don't count."""
    safe = [F.when(weight != 0, v) for v in values]
    d = range(len(values))
    sums = rows.groupBy(*keys).agg(
        F.sum(weight).alias("n"), *[F.sum(weight * safe[i]).alias(f"s{i}") for i in d], *[F.sum(weight * safe[i] * safe[j]).alias(f"q{i}_{j}") for i in d for j in d if j >= i]
    )
    means = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in d]
    covs = [(F.col(f"q{i}_{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")).alias(f"c{i}_{j}") for i in d for j in d if j >= i]
    return sums.select(*keys, "n", *means, *covs)


def weighted_poisson(rows: DataFrame, count: Column, weight: Column, keys: list[str]) -> DataFrame:
    """keys, n, log_rate."""
    sums = rows.groupBy(*keys).agg(F.sum(weight).alias("n"), F.sum(F.when(weight != 0, weight * count)).alias("s"))
    return sums.select(*keys, "n", F.log(F.greatest(F.col("s") / F.col("n"), F.lit(fits.MIN_RATE))).alias("log_rate"))


def joint_sums(rows: DataFrame, vector: Column, weight: Column, size: int, keys: list[str]) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
    """(n, first, second) of an array column for each key: numbers of a size that doesn't depend on the rows."""
    d = range(size)
    got = rows.groupBy(*keys).agg(F.sum(weight).alias("n"), *[F.sum(weight * vector[i]).alias(f"s{i}") for i in d], *[F.sum(weight * vector[i] * vector[j]).alias(f"q{i}_{j}") for i in d for j in d if j >= i]).collect()
    out = {}
    for r in got:
        second = np.zeros((size, size))
        for i in d:
            for j in range(i, size):
                second[i, j] = second[j, i] = r[f"q{i}_{j}"] or 0.0
        out[tuple(r[k] for k in keys)] = (r["n"] or 0.0, np.array([r[f"s{i}"] or 0.0 for i in d]), second)
    return out


def vector_sums(rows: DataFrame, vector: str, key: str) -> dict[object, tuple[float, np.ndarray, np.ndarray]]:
    """(n, first, second) of all coordinates of an array column for each key, as joint_sums gives them for short vectors.

    A task sums its batches by matrix products; its sums are added up by coordinate before they reach the driver. Rows
    whose key, vector or any coordinate is null aren't summed; all vectors have to be of one size.
    """
    whole = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        kept = None
        for batch in batches:
            kept, coded = batch.schema, batch.column("k").dictionary_encode()
            which = coded.indices.to_numpy()
            for at, k in enumerate(coded.dictionary.to_pylist()):
                own = batch.column("x") if len(coded.dictionary) == 1 else batch.column("x").take(pa.array(np.flatnonzero(which == at)))
                if len(np.unique(own.value_lengths())) != 1:
                    raise ValueError(f"vectors of several sizes under {k!r}")
                x = learning.matrix(own)
                x = np.hstack([np.ones((len(x), 1)), x])
                sums[k] = sums.get(k, 0.0) + x.T @ x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), kept.field("k").type), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))], ["k", "s"])

    kind = rows.schema[key].dataType.simpleString()
    parts = whole.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, f"k {kind}, s array<double>")
    added = parts.select("k", F.posexplode("s").alias("at", "v")).groupBy("k", "at").agg(F.sum("v").alias("v"))
    out = {}
    for r in added.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s")).collect():
        joint = np.array([v for _, v in r["s"]])
        joint = joint.reshape(math.isqrt(len(joint)), -1)
        out[r["k"]] = (float(joint[0, 0]), joint[0, 1:], joint[1:, 1:])
    return out


def regression(rows: DataFrame, inputs: Column, outputs: Column, sizes: tuple[int, int], weight: Column | None = None, keys: tuple[str, ...] = ()) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ridge regression of outputs on inputs for each key: (coefficients, bias, residual covariance)."""
    weight = F.lit(1.0) if weight is None else weight
    sums = joint_sums(rows, F.concat(inputs, outputs), weight, sum(sizes), list(keys))
    return {k: fits.regression(n, first, second, sizes[0]) for k, (n, first, second) in sums.items()}


def zscore(rows: DataFrame, value: str, keys: list[str], out: str = "z") -> DataFrame:
    """Adds (value - mean) / population deviation within keys; the statistics are a small table that joins back."""
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    joined = rows.join(F.broadcast(stats), keys) if not keys else rows.join(stats, keys)
    return joined.withColumn(out, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")
