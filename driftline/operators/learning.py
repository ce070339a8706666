"""Distributed inference and expectation steps: packed sequences go through NumPy kernels in Arrow batches.

A step yields either posterior rows, or sums of sufficient statistics as (run, session, name, place, value) rows that Spark
adds up, so what reaches the driver has the size of the parameters. ``run`` numbers models that are learnt side by side.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.sources.sequences import packed

SUMS = "run int, session int, name string, place int, value double"
#: Sequences that the kernels work on at once, and steps that they may have together.
BATCH_SEQUENCES = 512
BATCH_STEPS = 1 << 17

Sums = dict[int, dict[str, np.ndarray]]


@dataclass
class Batch:
    """Right-padded sequences of one session: y (B, T, D), u (B, T, U), weight (B, T), lengths (B,).

    Where sequences come in blocks of time (see :mod:`driftline.operators.blocked`), ``block`` numbers them, from step
    ``start`` on, and ``before`` and ``ahead`` are what the steps before and after a block say about its ends.
    """

    session: int
    seq: np.ndarray
    lengths: np.ndarray
    y: np.ndarray
    u: np.ndarray
    weight: np.ndarray
    block: np.ndarray | None = None
    start: np.ndarray | None = None
    before: np.ndarray | None = None
    ahead: np.ndarray | None = None

    @property
    def steps(self) -> int:
        return self.y.shape[1]

    def as_session(self, session: int) -> Batch:
        return replace(self, session=session)


def _nested(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, step, size, values) of a list of lists, null inner lists being empty; values stand one after the other."""
    counts = np.asarray(column.value_lengths().fill_null(0), np.int64)
    inner = column.flatten()
    sizes = np.asarray(inner.value_lengths().fill_null(0), np.int64)
    values = inner.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, step, sizes, values


def _padded(column: pa.Array, steps: int) -> np.ndarray:
    """(B, steps, width) of lists of vectors; missing vectors are zeros."""
    row, step, sizes, values = _nested(column)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(column), steps, width))
    full = sizes == width
    if width and (full | (sizes == 0)).all():
        out[row[full], step[full]] = values.reshape(-1, width)
    elif width:
        raise ValueError(f"vectors of {np.unique(sizes[sizes > 0]).tolist()} entries in one session")
    return out


def nested(values: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    """Rows (N, ...) of an array as lists, or lists of lists; null where they aren't ``present``."""
    values = np.asarray(values, float)
    if values.ndim == 1:
        return pa.array(values)
    n, width = values.shape[:2]
    inner = nested(values.reshape(n * width, *values.shape[2:]))
    mask = None if present is None else pa.array(~np.asarray(present, bool))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), inner, mask=mask)


def vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """(steps, width) of each list of vectors; None where there is no list, ValueError where vectors differ in size."""
    sizes = np.asarray(column.flatten().value_lengths().fill_null(0), np.int64)
    values = column.flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
    counts = column.value_lengths().to_pylist()
    at = begin = 0
    for n in counts:
        if n is None:
            yield None
            continue
        own = sizes[at : at + n]
        width = int(own[0]) if n else 0
        if (own != width).any():
            raise ValueError(f"vectors of {np.unique(own).tolist()} entries in one sequence")
        yield values[begin : begin + n * width].reshape(n, width)
        at, begin = at + n, begin + n * width


def held(values: pa.Array) -> pd.arrays.ArrowExtensionArray:
    """An Arrow array as a column of a data frame, as it is."""
    return pd.arrays.ArrowExtensionArray(values)


def matrix(column: pa.Array) -> np.ndarray:
    """(N, width) of a column of lists of one size."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1 if len(column) else 0)


def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Sequences of one session each, of like lengths, so that padding stays small."""
    for part in parts:
        names = part.schema.names
        column = {n: part.column(i) for i, n in enumerate(names)}
        sessions, every = np.asarray(column["session"]), np.asarray(column["length"], np.int64)
        order = np.lexsort((every, sessions))
        begin = 0
        while begin < len(order):
            session, end = sessions[order[begin]], begin
            while end < len(order) and sessions[order[end]] == session and end - begin < BATCH_SEQUENCES and (end - begin + 1) * every[order[end]] <= max(BATCH_STEPS, every[order[end]]):
                end += 1
            own, begin = np.sort(order[begin:end]), end
            take = pa.array(own)
            lengths = every[own]
            steps = int(lengths.max())
            weight = np.zeros((len(own), steps))
            visible = column["visible"].take(take)
            counts = np.asarray(visible.value_lengths(), np.int64)
            row = np.repeat(np.arange(len(own)), counts)
            weight[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = visible.flatten().to_numpy(zero_copy_only=False).astype(float)
            more = {n: np.asarray(column[n].take(take)) for n in ("block", "start") if n in column}
            more |= {n: np.asarray(column[n].take(take).flatten(), float).reshape(len(own), -1) for n in ("before", "ahead") if n in column}
            yield Batch(int(session), np.asarray(column["seq"].take(take), np.int64), lengths, _padded(column["y"].take(take), steps), _padded(column["u"].take(take), steps), weight, **more)


class Packed:
    """Packed sequences, held in memory for repeated passes."""

    def __init__(self, sequences: DataFrame):
        self.spark = sequences.sparkSession
        self.table = packed(sequences).persist(StorageLevel.MEMORY_AND_DISK)
        self.sessions = sorted(r[0] for r in self.table.select("session").distinct().collect())

    def __enter__(self) -> Packed:
        return self

    def __exit__(self, *_) -> None:
        self.table.unpersist()

    def sums(self, statistics: Callable[[Batch], dict[str, np.ndarray]]) -> Sums:
        """Sums over all batches of a session, by name."""
        return self.all_sums(lambda b: [(0, b.session, statistics(b))]).get(0, {})

    def all_sums(self, statistics: Callable[[Batch], Iterable[tuple[int, int, dict[str, np.ndarray]]]]) -> dict[int, Sums]:
        """Sums of (run, session, named arrays) over all batches."""

        def pieces(parts: Iterator[pa.RecordBatch]):
            for b in batches(parts):
                yield from statistics(b)

        return total(self.table, pieces)


def total(table: DataFrame, pieces: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, dict[str, np.ndarray]]]]) -> dict[int, Sums]:
    """Adds (run, session, named arrays) of all Arrow batches, by run and session."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[tuple[int, int, str], np.ndarray] = {}
        for number, session, found in pieces(parts):
            for name, value in found.items():
                value = np.asarray(value, float)
                key = (number, session, f"{name}|{','.join(map(str, value.shape))}")
                added[key] = added[key] + value if key in added else value
        for (number, session, name), value in added.items():
            n = value.size
            columns = [np.full(n, number, np.int32), np.full(n, session, np.int32), np.full(n, name, object), np.arange(n, dtype=np.int32), value.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) if c.dtype != object else pa.array(c, pa.string()) for c in columns], ["run", "session", "name", "place", "value"])

    rows = table.mapInArrow(run, SUMS).groupBy("run", "session", "name", "place").agg(F.sum("value").alias("value")).collect()
    out: dict[int, Sums] = defaultdict(lambda: defaultdict(dict))
    for r in rows:
        name, _, shape = r["name"].partition("|")
        own = out[r["run"]][r["session"]]
        if name not in own:
            own[name] = np.zeros(tuple(int(x) for x in shape.split(",") if x))
        own[name].flat[r["place"]] = r["value"]
    return {k: dict(v) for k, v in out.items()}


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a list of "name type" pairs."""
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split(" ") for c in schema.split(", "))])


def rows(table: DataFrame, schema: str, make: Callable[[Batch], pd.DataFrame]) -> DataFrame:
    """A table of what ``make`` returns for each batch."""
    arrow = arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            made = make(batch)
            if len(made):  # a column of several frames has as many chunks, and an empty one may have no list type
                yield from pa.Table.from_pandas(made, arrow, preserve_index=False).to_batches()

    return table.mapInArrow(run, schema)


def step_rows(batch: Batch, columns: dict[str, np.ndarray], offset: int = 0, lengths: np.ndarray | None = None) -> pd.DataFrame:
    """One row for each valid step; arrays (B, T, ...) become nested lists."""
    lengths = batch.lengths if lengths is None else lengths
    steps = next(iter(columns.values())).shape[1]
    on = np.arange(steps)[None, :] < lengths[:, None]
    b, t = np.nonzero(on)
    out = {"session": np.full(len(b), batch.session, np.int32), "seq": batch.seq[b], "t": (t + offset + (0 if batch.start is None else batch.start[b])).astype(np.int32)}
    for name, value in columns.items():
        picked = value[b, t]
        out[name] = held(nested(picked)) if picked.ndim > 1 else picked
    return pd.DataFrame(out)
