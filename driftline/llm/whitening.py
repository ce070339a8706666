"""Whitening of vectors by their leading principal components, found by LOBPCG.

Vectors are put on a whole-number grid, x = floor(scale * c) + offset, so sums over all rows are exact. The covariance is
never formed: each step multiplies it with a block of directions in one pass over the rows, each row centred first, and
Spark adds the blocks' products. On the driver stand the iterate X, its residuals R and the previous directions P,
dimension x block numbers each; a Rayleigh-Ritz step on [X, R, P] gives the next X. Steps go on until every wanted
component's residual ||V v - e v||, measured with a fresh product, is at most ``tolerance`` of the largest eigenvalue.

Defined results: null vectors and vectors with a null or non-finite entry are left out, and vectors whose size isn't the most frequent
one (the larger of equally frequent ones) as well; entries beyond 2^40 on the grid count as 2^40; repeated rows
and null identifiers are rows of their own; directions with an eigenvalue of 0 (constant tables, one row, fewer rows than
components) give no component; ``deviation`` is null where it exceeds 2^63 - 1; equal eigenvalues may share any basis of
their space; an empty table gives an empty table; only the key and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch

#: Directions beyond the wanted ones that the iterate carries.
GUARD = 8
#: Residual of a component, as a share of the largest eigenvalue.
TOLERANCE = 1e-12
#: Steps after which a table without certified components raises.
MAX_STEPS = 300
#: Rows that are multiplied or written at once.
ROWS = 2048
#: Largest size of an entry on the grid.
LARGEST = 1 << 40


def grid(column: pa.Array, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sizes, entries): the rows whose vectors count, their sizes, and their entries on the grid one after the other."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
    bad = np.zeros(len(sizes), bool)
    bad[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)]] = True
    bad |= np.asarray(column.is_null())
    good = ~np.repeat(bad, sizes)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(scale * flat[good]) + offset, -LARGEST, LARGEST).astype(np.int64)
    rows = np.flatnonzero(~bad)
    return rows, sizes[rows], x


@dataclass
class Grid:
    """The grid of a table: ``n`` vectors of ``size`` entries count, with whole sums ``sums``."""

    scale: float
    offset: int
    n: int
    size: int
    sums: np.ndarray

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(keys, n * x - sums) of the vectors that count, at most ROWS at once."""
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                rows, sizes, x = grid(part.column(1), self.scale, self.offset)
                own = sizes == self.size
                if own.any():
                    x = x[np.repeat(own, sizes)].reshape(-1, self.size)
                    yield part.column(0).take(pa.array(rows[own])), self._moved(x)

    def _moved(self, x: np.ndarray) -> np.ndarray:
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums.tolist()), default=0) >= 1 << 62:
            x = x.astype(object)
        return x * self.n - self.sums


@dataclass
class Points:
    """Rows (key, vector) and their grid."""

    rows: DataFrame
    grid: Grid

    def total(self, make) -> dict[int, float]:
        """Sums of the arrays that ``make`` returns for the centred rows of each block, by flat place."""
        own = self.grid

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for _, moved in own.blocks(batches):
                found = make((moved / own.n).astype(float))
                held = found if held is None else held + found
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size, dtype=np.int32)), pa.array(held.ravel())], ["place", "value"])

        rows = self.rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
        return {r["place"]: r["value"] for r in rows.collect()}  # as many as the array has places

    def product(self, directions: np.ndarray) -> np.ndarray:
        """Covariance times directions (size, block)."""
        found = self.total(lambda centred: centred.T @ (centred @ directions))
        return np.array([found[i] for i in range(directions.size)]).reshape(directions.shape) / self.grid.n


def points(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> Points:
    """Counts the vectors and adds up their entries."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            _, sizes, x = grid(batch.column(1), scale, offset)
            for size in np.unique(sizes).tolist():
                own = sizes == size
                part = np.concatenate([[own.sum()], x[np.repeat(own, sizes)].reshape(own.sum(), size).sum(0)])
                held[size] = held[size] + part if size in held else part
        for size, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), size, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part)], ["size", "place", "value"])

    sums = rows.mapInArrow(run, "size int, place int, value long").groupBy("size", "place").agg(F.sum("value").alias("value"))
    sums = Scratch(table.sparkSession, "whitening").write("sums", sums)
    most = sums.where("place = 0").orderBy(F.desc("value"), F.desc("size")).first()
    if most is None:
        return Points(rows, Grid(scale, offset, 0, 0, np.zeros(0, np.int64)))
    found = {r["place"]: r["value"] for r in sums.where(F.col("size") == most["size"]).collect()}
    return Points(rows, Grid(scale, offset, most["value"], most["size"], np.array([found[i + 1] for i in range(most["size"])], np.int64)))


def _beside(block: np.ndarray, iterate: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the span of the orthonormal ``iterate``."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - iterate @ (iterate.T @ block)
        if not block.shape[1]:
            break
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return block


def lobpcg(product, size: int, wanted: int, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(directions (size, wanted), eigenvalues, residuals, steps) of the symmetric map ``product``, by falling eigenvalue."""
    block = min(size, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(size, block)))[0]
    ax, fresh, before = product(x), True, np.zeros((size, 0))
    for step in range(1, max_steps + 1):
        inner = x.T @ ax
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values, kind="stable")
        x, ax, values = x @ turn[:, order], ax @ turn[:, order], values[order]
        rest = ax - x * values
        residuals = np.linalg.norm(rest[:, :wanted], axis=0)
        if (residuals <= tolerance * max(values[0], 0.0)).all():
            if fresh:
                return x[:, :wanted], values[:wanted], residuals, step
            # Products made of earlier ones lose digits: the certificate takes a new one.
            x, before = np.linalg.qr(x)[0], np.zeros((size, 0))
            ax, fresh = product(x), True
            continue
        new = _beside(np.concatenate([rest, before], 1), x)
        if not new.shape[1]:
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            continue
        basis, image = np.concatenate([x, new], 1), np.concatenate([ax, product(new)], 1)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn = turn[:, np.argsort(-values, kind="stable")[:block]]
        x, ax, before, fresh = basis @ turn, image @ turn, new @ turn[x.shape[1] :], False
    raise ArithmeticError(f"no certified components after {max_steps} steps: residuals up to {residuals.max():.3g}")


@dataclass
class Whitening:
    """Fitted directions (size, K) with their eigenvalues, certified residuals, and the error of the whitened covariance."""

    points: Points
    directions: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    steps: int
    identity_error: float

    def transform(self) -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each vector and component."""
        g, k, error = self.points.grid, len(self.values), self.identity_error
        scaled, explained = self.directions / np.sqrt(self.values), self.values / self.trace if k else self.values
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, moved in g.blocks(batches):
                rows = len(moved)
                every = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    keys.take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, g.n)), deviations(moved).take(every),
                    pa.array(((moved / g.n).astype(float) @ scaled).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return self.points.rows.mapInArrow(run, schema) if k else self.points.rows.sparkSession.createDataFrame([], schema)


def deviations(moved: np.ndarray) -> pa.Array:
    """Exact sums of squares of each row; null beyond the whole numbers of 64 bits."""
    top = int(np.abs(moved).max(initial=0))
    if moved.dtype == np.int64 and moved.shape[1] * top * top < 1 << 63:
        return pa.array((moved * moved).sum(1))
    exact = [sum(int(v) ** 2 for v in row) for row in moved.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def fit(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, scale: float = 64.0, offset: int = 1_000_000, tolerance: float = TOLERANCE) -> Whitening:
    """Leading components of all vectors of ``table``."""
    p = points(table, key, vector, scale, offset)
    n, size = p.grid.n, p.grid.size
    none = Whitening(p, np.zeros((size, 0)), np.zeros(0), 0.0, np.zeros(0), 0, 0.0)
    if n < 2 or not size:
        return none
    trace = p.total(lambda centred: np.array([(centred * centred).sum()]))[0] / n
    if not trace:
        return none
    directions, values, residuals, steps = lobpcg(p.product, size, min(components, size), tolerance)
    live = values > size * np.finfo(float).eps * values[0]
    directions, values, residuals = directions[:, live], values[live], residuals[live]
    scaled, k = directions / np.sqrt(values), len(values)

    def spread(centred: np.ndarray) -> np.ndarray:
        z = centred @ scaled
        return z.T @ z

    found = p.total(spread)
    covariance = np.array([found[i] for i in range(k * k)]).reshape(k, k) / n
    return Whitening(p, directions, values, trace, residuals, steps, float(np.abs(covariance - np.eye(k)).max()))
