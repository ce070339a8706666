"""Column builders: densities, affine maps and small-state recursions that stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.dists import log_factorial as _log_factorial

LOG_2PI = math.log(2 * math.pi)


def constant(values) -> Column:
    """A constant array<double>."""
    return F.array(*[F.lit(float(v)) for v in values])


def _add(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def gaussian_log_prob(y: Column, mean: Sequence[float], variance: Sequence[float]) -> Column:
    """Log density of array ``y`` under independent normals."""
    terms = [(y[i] - float(m)) * (y[i] - float(m)) / float(v) + (math.log(v) + LOG_2PI) for i, (m, v) in enumerate(zip(mean, variance, strict=True))]
    return _add(terms) * -0.5


def full_gaussian_log_prob(y: Column, mean: Sequence[float], covariance: np.ndarray) -> Column:
    """Log density of array ``y`` under a normal with a full covariance."""
    p, logdet = np.linalg.inv(covariance), np.linalg.slogdet(covariance)[1]
    e = [y[i] - float(m) for i, m in enumerate(mean)]
    terms = [e[i] * e[j] * float(p[i, j]) for i in range(len(e)) for j in range(len(e))]
    return (_add(terms) + (float(logdet) + len(e) * LOG_2PI)) * -0.5


def log_factorial(count: Column) -> Column:
    """ln y! of a count; it depends on data alone, so it is computed once for a data set."""

    @F.pandas_udf("double")
    def run(counts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in counts:
            yield pd.Series(_log_factorial(np.nan_to_num(batch.to_numpy(float))))

    return run(count)


def poisson_log_prob(count: Column, log_rate: float, log_count_factorial: Column) -> Column:
    return count * float(log_rate) - math.exp(log_rate) - log_count_factorial


def affine(values: Column, coefficients: np.ndarray, bias: Sequence[float]) -> Column:
    """W v + b of an array column."""
    rows = [_add([values[j] * float(w) for j, w in enumerate(row)] + [F.lit(float(b))]) for row, b in zip(np.asarray(coefficients), bias, strict=True)]
    return F.array(*rows)


def argmax(values: Column) -> Column:
    """Index of the largest element, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_sum_exp(terms: Sequence[Column]) -> Column:
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return top + F.log(_add([F.exp(x - top) for x in terms]))


def forward(local: Column, initial: Sequence[float], transition: np.ndarray) -> Column:
    """Filtered state probabilities and log-likelihood of a packed array of log factors (array<array<double>>).

    A struct (steps array<array<double>>, log_likelihood double): for few states, the whole recursion is one fold.
    """
    k = len(initial)
    p = np.asarray(transition, float)
    start = F.struct(F.array().cast("array<double>").alias("a"), F.array().cast("array<array<double>>").alias("steps"), F.lit(0.0).alias("ll"))

    def step(acc: Column, ell: Column) -> Column:
        before = F.when(F.size(acc["a"]) == 0, constant(initial)).otherwise(F.array(*[_add([acc["a"][i] * float(p[i, j]) for i in range(k)]) for j in range(k)]))
        top = F.array_max(ell)
        joint = F.zip_with(before, ell, lambda a, e: a * F.exp(e - top))
        total = F.greatest(F.aggregate(joint, F.lit(0.0), lambda a, b: a + b), F.lit(float(np.finfo(float).tiny)))
        # ``transform`` over an array of one binds an intermediate once.
        return F.transform(F.array(F.struct(joint.alias("j"), total.alias("z"), top.alias("m"))), lambda s: _next(acc, s))[0]

    def _next(acc: Column, s: Column) -> Column:
        filtered = F.transform(s["j"], lambda x: x / s["z"])
        return F.struct(filtered.alias("a"), F.concat(acc["steps"], F.array(filtered)).alias("steps"), (acc["ll"] + F.log(s["z"]) + s["m"]).alias("ll"))

    return F.aggregate(local, start, step, lambda acc: F.struct(acc["steps"].alias("steps"), acc["ll"].alias("log_likelihood")))


def pack_local(rows: DataFrame, local: Column) -> DataFrame:
    """(session, seq, ts, ell) with the log factors of a sequence in order of t."""
    s = F.sort_array(F.collect_list(F.struct("t", local.alias("ell"))))
    return rows.groupBy("session", "seq").agg(s.alias("s")).select("session", "seq", F.col("s.t").alias("ts"), F.col("s.ell").alias("ell"))
