"""Chain inference over blocks of time: no sequence has to fit one task.

Every block of steps is reduced to one element of an associative product: for a discrete chain the log weights from its first state
to its last, for a Gaussian chain a log factor over its two ends (what Schur complements leave of the steps between). Elements
are multiplied on a tree, ``FAN`` children a node, one shuffle a level; then the tree is walked down, and each node tells
its children what the steps before and after them say about their ends. With these two messages a block is inferred by itself.

Groups hold at most ``size`` + overlap steps, or ``FAN`` elements, whatever the length of a sequence; elements have the size
of the parameters' squares. A hot sequence (one that holds most rows) is many blocks, so it is spread like many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import chains, learning
from driftline.operators.chains import LOG_2PI, _log_sum, symmetric, transpose

#: Steps of a block, and children of a node of the tree.
SIZE = 2048
FAN = 64
NODE = ["session", "seq", "node"]


def blocks(sequences: DataFrame, size: int = SIZE, overlap: int = 0) -> DataFrame:
    """(session, seq, block, start, length, y, u, visible): steps block * size to (block + 1) * size + overlap, packed.

    Blocks that would hold nothing but steps of the block before them are left out.
    """
    if size < 1 or overlap < 0:
        raise ValueError("a block has steps")
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - overlap - size + 1) / size)).cast("long")
    at = F.explode(F.sequence(first, F.floor(F.col("t") / size).cast("long")))
    steps = F.sort_array(F.collect_list(F.struct("t", "y", "u", "visible")))
    rows = sequences.withColumn("block", at).groupBy("session", "seq", "block").agg(steps.alias("s")).where((F.col("block") == 0) | (F.size("s") > overlap))
    return rows.select("session", "seq", "block", (F.col("block") * size).alias("start"), F.size("s").alias("length"), F.col("s.y").alias("y"), F.col("s.u").alias("u"), F.col("s.visible").alias("visible"))


class DiscreteScan:
    """Elements (K, K): log weight of all paths from a state at a block's first step to one at its last, both steps' factors included.

    ``before`` is the log probability of the first step's states given all steps before it; ``ahead`` the log weight of the
    states of the step behind the block, its factor and all later ones included, or NaN at the end.
    """

    def __init__(self, initial: np.ndarray, transition: np.ndarray):
        self.k = len(initial)
        with np.errstate(divide="ignore"):
            self.initial, self.move = np.log(np.asarray(initial, float)), np.log(np.asarray(transition, float))

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return self.initial, np.full(self.k, np.nan)

    def _matrix(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(-1, self.k, self.k)

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left = _log_sum(self._matrix(a)[:, :, :, None] + self.move[None, None], 2)
        return _log_sum(left[:, :, :, None] + self._matrix(b)[:, None], 2).reshape(len(a), -1)

    def forward(self, before: np.ndarray, a: np.ndarray) -> np.ndarray:
        last = _log_sum(before[:, :, None] + self._matrix(a), 1)
        after = _log_sum(last[:, :, None] + self.move, 1)
        return after - _log_sum(after, 1)[:, None]

    def backward(self, a: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        beyond = np.where(np.isnan(ahead).all(1)[:, None], 0.0, _log_sum(self.move + np.where(np.isnan(ahead), 0.0, ahead)[:, None, :], 2))
        out = _log_sum(self._matrix(a) + beyond[:, None, :], 2)
        return out - out.max(1, keepdims=True)

    @staticmethod
    def element(transition: np.ndarray, local: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(B, K * K) of local log factors (B, T, K): one filter from each first state."""
        b, steps, k = local.shape
        top = local.max(-1)
        top = np.where(np.isfinite(top), top, 0.0)
        scaled = np.exp(local - top[..., None])
        rows, score = np.tile(np.eye(k), (b, 1, 1)), local[:, 0].copy()
        for t in range(1, steps):
            on = (t < lengths)[:, None]
            moved = (rows @ transition) * scaled[:, t, None, :]
            total = moved.sum(-1)
            alive = total > 0
            moved = np.where(alive[..., None], moved / np.where(alive, total, 1.0)[..., None], 0.0)
            rows = np.where(on[..., None], moved, rows)
            score = np.where(on, np.where(alive, score + np.log(np.where(alive, total, 1.0)) + top[:, t, None], -np.inf), score)
        with np.errstate(divide="ignore"):
            return (np.log(rows) + score[..., None]).reshape(b, -1)


class GaussianScan:
    """Elements: log factors -z'Jz/2 + h'z + c over z = (a block's first latent, its last), flat. Neighbouring blocks share a step,
    whose own factors belong to the earlier one; messages are log factors over one latent, ``ahead`` NaN at the end."""

    def __init__(self, size: int):
        self.d = size

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        one = self.d * self.d + self.d + 1
        return np.zeros(one), np.full(one, np.nan)

    def _pair(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(J00, J01, J11, h0, h1, c)."""
        d, n = self.d, 2 * self.d
        j, h = x[:, : n * n].reshape(-1, n, n), x[:, n * n : n * n + n]
        return j[:, :d, :d], j[:, :d, d:], j[:, d:, d:], h[:, :d], h[:, d:], x[:, -1]

    def pack_pair(self, j00, j01, j11, h0, h1, c) -> np.ndarray:
        j = np.concatenate([np.concatenate([j00, j01], 2), np.concatenate([transpose(j01), j11], 2)], 1)
        return np.concatenate([j.reshape(len(j), -1), h0, h1, c[:, None]], 1)

    def _one(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = self.d
        return x[:, : d * d].reshape(-1, d, d), x[:, d * d : d * d + d], x[:, -1]

    def _pack_one(self, j, h, c) -> np.ndarray:
        return np.concatenate([symmetric(j).reshape(len(j), -1), h, c[:, None]], 1)

    def _integral(self, s: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Log integral of exp(-x's x/2 + m'x)."""
        return 0.5 * np.einsum("bi,bi->b", m, np.linalg.solve(s, m[..., None])[..., 0]) - 0.5 * np.linalg.slogdet(s)[1] + 0.5 * self.d * LOG_2PI

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a00, a01, a11, ha0, ha1, ca = self._pair(a)
        b00, b01, b11, hb0, hb1, cb = self._pair(b)
        s, m = symmetric(a11 + b00), ha1 + hb0
        solved = np.linalg.solve(s, np.concatenate([transpose(a01), b01, m[..., None]], 2))
        d = self.d
        sa, sb, sm = solved[..., :d], solved[..., d : 2 * d], solved[..., -1]
        apply = lambda x, v: np.einsum("bij,bj->bi", x, v)
        return self.pack_pair(symmetric(a00 - a01 @ sa), -a01 @ sb, symmetric(b11 - transpose(b01) @ sb), ha0 - apply(a01, sm), hb1 - apply(transpose(b01), sm), ca + cb + self._integral(s, m))

    def forward(self, before: np.ndarray, a: np.ndarray) -> np.ndarray:
        f, g, c = self._one(before)
        j00, j01, j11, h0, h1, own = self._pair(a)
        s, m = symmetric(f + j00), g + h0
        solved = np.linalg.solve(s, np.concatenate([j01, m[..., None]], 2))
        return self._pack_one(j11 - transpose(j01) @ solved[..., :-1], h1 - np.einsum("bij,bi->bj", j01, solved[..., -1]), c + own + self._integral(s, m))

    def backward(self, a: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        f, g, c = self._one(np.where(np.isnan(ahead), 0.0, ahead))
        j00, j01, j11, h0, h1, own = self._pair(a)
        s, m = symmetric(j11 + f), h1 + g
        solved = np.linalg.solve(s, np.concatenate([transpose(j01), m[..., None]], 2))
        return self._pack_one(j00 - j01 @ solved[..., :-1], h0 - np.einsum("bij,bj->bi", j01, solved[..., -1]), c + own + self._integral(s, m))

    def element(self, f: chains.GaussianFactors) -> np.ndarray:
        """Eliminates all but the first and the last step of chains of two steps and more; others are zeros and are never multiplied."""
        b, steps, d = f.info.shape
        lengths = np.asarray(f.lengths)
        if steps < 2:
            return np.zeros((b, 4 * d * d + 2 * d + 1))
        j00, j01, j11 = f.diag[:, 0], transpose(f.lower[:, 0]), f.diag[:, 1]
        h0, h1, c = f.info[:, 0], f.info[:, 1], f.const.copy()
        for t in range(2, steps):
            on = t < lengths
            s = np.where(on[:, None, None], symmetric(j11), np.eye(d))
            low = f.lower[:, t - 1]
            solved = np.linalg.solve(s, np.concatenate([transpose(j01), transpose(low), h1[..., None]], 2))
            sa, sb, sm = solved[..., :d], solved[..., d : 2 * d], solved[..., -1]
            some = on[:, None, None]
            c = c + np.where(on, self._integral(s, h1), 0.0)
            h0 = np.where(on[:, None], h0 - np.einsum("bij,bj->bi", j01, sm), h0)
            h1 = np.where(on[:, None], f.info[:, t] - np.einsum("bij,bj->bi", low, sm), h1)
            j00 = np.where(some, symmetric(j00 - j01 @ sa), j00)
            j01 = np.where(some, -j01 @ sb, j01)
            j11 = np.where(some, symmetric(f.diag[:, t] - low @ sb), j11)
        out = self.pack_pair(j00, j01, j11, h0, h1, c)
        return np.where((lengths > 1)[:, None], out, 0.0)

    def with_messages(self, f: chains.GaussianFactors, before: np.ndarray, ahead: np.ndarray) -> chains.GaussianFactors:
        """A block's factors with what is known from outside added at its ends."""
        diag, info, const = f.diag.copy(), f.info.copy(), f.const.copy()
        rows, last = np.arange(len(const)), np.maximum(np.asarray(f.lengths) - 1, 0)
        for message, at in ((before, np.zeros_like(last)), (np.where(np.isnan(ahead), 0.0, ahead), last)):
            j, h, c = self._one(message)
            diag[rows, at] += j
            info[rows, at] += h
            const += c
        return chains.GaussianFactors(diag, f.lower, info, const, f.lengths)


def _flat(column: pa.Array) -> np.ndarray:
    """(rows, entries) of a list column whose lists have one size."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _children(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(elements (B, M, E), counts (B,)) of a column of lists of elements."""
    counts = np.asarray(column.value_lengths(), np.int64)
    own = _flat(column.flatten())
    out = np.zeros((len(counts), int(counts.max(initial=0)), own.shape[1]))
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = own
    return out, counts


def sweep(leaves: DataFrame, scan, fan: int = FAN, keep: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """(session, seq, node, before, ahead) of every leaf (session, seq, node, element), and the tables of its levels, held in memory with ``keep``."""
    held, current = [], leaves
    top = leaves.agg(F.max("node")).first()[0] or 0
    first, last = (x.tolist() for x in scan.start())

    def products(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                kids, counts = _children(part.column(3))
                out = kids[:, 0]
                for i in range(1, kids.shape[1]):
                    on = counts > i
                    out[on] = scan.combine(out[on], kids[on, i])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], _listed(out)], [*NODE, "element"])

    def down(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            kids, counts = _children(part.column(3))
            before, ahead = (np.repeat(_flat(part.column(c))[:, None], kids.shape[1], 1) for c in (4, 5))
            for i in range(1, kids.shape[1]):
                on = counts > i
                before[on, i] = scan.forward(before[on, i - 1], kids[on, i - 1])
            for i in range(kids.shape[1] - 2, -1, -1):
                on = counts > i + 1
                ahead[on, i] = scan.backward(kids[on, i + 1], ahead[on, i + 1])
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            node = np.asarray(part.column(2), np.int64)[row] * fan + place
            keys = [part.column(c).take(pa.array(row)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(node), _listed(before[row, place]), _listed(ahead[row, place])], [*NODE, "before", "ahead"])

    while top > 0:
        pairs = F.sort_array(F.collect_list(F.struct("node", "element")))
        kids = current.groupBy("session", "seq", F.floor(F.col("node") / fan).alias("up")).agg(pairs.alias("c")).select("session", "seq", F.col("up").alias("node"), F.col("c.element").alias("kids"))
        held.append(kids.persist(StorageLevel.MEMORY_AND_DISK) if keep else kids)
        current = kids.mapInArrow(products, "session int, seq long, node long, element array<double>")
        top //= fan
    constant = lambda x: F.array(*[F.lit(float(v)) for v in x])
    messages = current.select(*NODE, constant(first).alias("before"), constant(last).alias("ahead"))
    for kids in reversed(held):
        messages = kids.join(messages, NODE).select(*NODE, "kids", "before", "ahead").mapInArrow(down, "session int, seq long, node long, before array<double>, ahead array<double>")
    return messages, held


class Blocked:
    """Sequences in blocks of time under one model, each block with its messages; a stand-in for ``learning.Packed``.

    The model gives ``scan()`` and ``elements(batch)``. What steps need again is held in memory with ``keep``.
    """

    def __init__(self, sequences: DataFrame, size: int = SIZE, overlap: int = 0, fan: int = FAN, keep: bool = True):
        self.fan, self.keep = fan, keep
        self.plain, self.held, self.table, self.sessions = blocks(sequences, size, overlap), [], None, []
        if keep:
            self.plain = self.plain.persist(StorageLevel.MEMORY_AND_DISK)
            self.sessions = sorted(r[0] for r in self.plain.select("session").distinct().collect())

    def __enter__(self) -> Blocked:
        return self

    def __exit__(self, *_) -> None:
        for table in (self.plain, *self.held):
            table.unpersist()

    sums, all_sums = learning.Packed.sums, learning.Packed.all_sums

    def under(self, model) -> DataFrame:
        """The blocks with their messages under ``model``."""

        def reduced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in learning.batches(parts):
                n = len(b.seq)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.session, np.int32)), pa.array(b.seq), pa.array(b.block), _listed(model.elements(b))], [*NODE, "element"])

        for table in self.held:
            table.unpersist()
        leaves = self.plain.mapInArrow(reduced, "session int, seq long, node long, element array<double>")
        if self.keep:
            leaves = leaves.persist(StorageLevel.MEMORY_AND_DISK)
        messages, self.held = sweep(leaves, model.scan(), self.fan, self.keep)
        self.held = [leaves, *self.held]
        self.table = self.plain.join(messages.withColumnRenamed("node", "block"), ["session", "seq", "block"])
        return self.table
