"""K-means and principal components as distributed sums with driver-side solves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators import learning
from driftline.operators.moments import joint_sums


def assign(y: Column, centers: np.ndarray) -> Column:
    """Index of the nearest center, the first of equally near ones."""
    distances = []
    for c in np.asarray(centers, float):
        terms = [(y[i] - float(v)) * (y[i] - float(v)) for i, v in enumerate(c)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        distances.append(total)
    d = F.array(*distances)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def kmeans(rows: DataFrame, y: Column, centers: np.ndarray, steps: int = 20) -> np.ndarray:
    """Centers after exactly ``steps`` Lloyd steps; an empty cluster keeps its center. Each step is one partial aggregation."""
    centers = np.asarray(centers, float)
    d = centers.shape[1]
    table = rows.select(y.alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(steps):
            got = table.groupBy(assign(F.col("y"), centers).alias("k")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("y")[i]).alias(f"s{i}") for i in range(d)]).collect()
            moved = centers.copy()
            for r in got:
                moved[r["k"]] = [r[f"s{i}"] / r["n"] for i in range(d)]
            still, centers = np.array_equal(moved, centers), moved
            if still:  # the steps left would not move a center either
                break
    finally:
        table.unpersist()
    return centers


def farthest_first(rows: DataFrame, y: Column, k: int, seed: int = 0) -> np.ndarray:
    """``k`` centers of k-means++ kind: each is the row of the largest squared distance to those before, weighed by a random power.

    A row's chance is proportional to its squared distance: log(u) / d2 is largest for one drawn that way.
    """
    table = rows.select(y.alias("y"))
    d2, centers = F.lit(1.0), []
    for i in range(k):
        u = (F.pmod(F.xxhash64("y", F.lit(seed), F.lit(i)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        key = F.when(d2 > 0, F.log(u) / d2)
        best = table.select("y", key.alias("key")).agg(F.max_by("y", "key")).first()[0]
        if best is None:
            best = table.agg(F.max_by("y", u)).first()[0]
        centers.append(best)
        d2 = None
        for c in centers:
            total = None
            for j, v in enumerate(c):
                term = (F.col("y")[j] - float(v)) * (F.col("y")[j] - float(v))
                total = term if total is None else total + term
            d2 = total if d2 is None else F.least(d2, total)
    return np.array(centers, float)


def spread_centers(rows: DataFrame, k: int, seed: int = 0) -> dict[int, np.ndarray]:
    """:func:`farthest_first` of every session of rows (session, y) at once: ``k`` aggregations, however many sessions there are.

    A session with fewer different rows than ``k`` has repeated centers.
    """
    centers: dict[int, list[np.ndarray]] = {}
    for i in range(k):
        u = (F.pmod(F.xxhash64("y", F.lit(seed), F.lit(i)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)

        def run(frames: Iterator[pd.DataFrame], now: dict[int, list[np.ndarray]] = dict(centers)) -> Iterator[pd.DataFrame]:  # noqa: B006
            for frame in frames:
                for session, own in frame.groupby("session"):
                    y, chance = np.vstack(own["y"].to_numpy()).astype(float), own["u"].to_numpy()
                    d2 = np.ones(len(y)) if session not in now else np.min([((y - c) ** 2).sum(1) for c in now[session]], axis=0)
                    with np.errstate(divide="ignore"):
                        key = np.where(d2 > 0, np.log(chance) / d2, -np.inf)
                    best = np.lexsort((chance, key))[-1]
                    yield pd.DataFrame({"session": [session], "y": [y[best]], "key": [key[best]], "u": [chance[best]]})

        picked = rows.select("session", "y", u.alias("u")).mapInPandas(run, "session int, y array<double>, key double, u double")
        for r in picked.groupBy("session").agg(F.max_by("y", F.struct("key", "u")).alias("y")).collect():
            centers[r["session"]] = [*centers.get(r["session"], []), np.array(r["y"], float)]
    return {s: np.array(c) for s, c in centers.items()}


def cluster_sums(rows: DataFrame, centers: dict[int, np.ndarray], second: bool = True) -> dict[int, dict[str, np.ndarray]]:
    """n (K,), s (K, D) and q (K, D, D) of the rows (session, y) nearest to each center of their session."""

    def pieces(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            for session, own in part.to_pandas().groupby("session"):
                y = np.vstack(own["y"].to_numpy()).astype(float)
                nearest = np.argmin([((y - c) ** 2).sum(1) for c in centers[session]], axis=0)
                parts = [y[nearest == k] for k in range(len(centers[session]))]
                found = {"n": np.array([float(len(v)) for v in parts]), "s": np.array([v.sum(0) for v in parts])}
                yield 0, session, found | ({"q": np.array([v.T @ v for v in parts])} if second else {})

    return learning.total(rows.select("session", "y"), pieces).get(0, {})


def partition(rows: DataFrame, k: int, seed: int = 0, steps: int = 20, centers: dict[int, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n, s, q) of the K-means clusters of every session; one aggregation a step for all. Empty clusters have the sums of all rows."""
    found = spread_centers(rows, k, seed) if centers is None else {s: np.asarray(c, float) for s, c in centers.items()}
    for _ in range(steps):
        sums = cluster_sums(rows, found, second=False)
        moved = {s: np.where(g["n"][:, None] > 0, g["s"] / np.maximum(g["n"], 1)[:, None], found[s]) for s, g in sums.items()}
        still = all(np.array_equal(c, found[s]) for s, c in moved.items())
        found |= moved
        if still:  # the steps left would not move a center either
            break
    out = {}
    for session, got in cluster_sums(rows, found).items():
        empty = got["n"] == 0
        out[session] = tuple(np.where(empty.reshape(-1, *[1] * (v.ndim - 1)), v.sum(0), v) for v in (got["n"], got["s"], got["q"]))
    return out


def pca(rows: DataFrame, y: Column, size: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components (D, C), variances), each component's largest entry positive."""
    n, first, second = joint_sums(rows, y, F.lit(1.0), size, [])[()]
    mean = first / n
    vectors, values = leading(second / n - np.outer(mean, mean), components)
    return mean, vectors, values


def leading(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions (D, C), variances) of a covariance, largest first, each direction's largest entry positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return vectors * np.where(signs == 0, 1, signs), values[order]
