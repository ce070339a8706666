"""Quality classifier: naive Bayes support vectors.

A text's features are the presence of hashed byte 4-grams of its whole UTF-8 text. Each is scaled by the log-count ratio
of its bucket between the classes; a linear model with hinge loss is fitted by dual coordinate descent on a bounded
sample of labelled rows, and a logistic curve fitted to its margins turns a margin into a score.

Defined results: null, empty and very short texts have no 4-grams and get the score of the bias alone; repeated rows get
equal results; an empty table gives an empty table; with labels of one class only, every score is that class; result
columns replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of byte 4-grams, labelled rows to learn from at most (about), passes of the descent.
BITS = 18
FIT_ROWS = 6000
PASSES = 12
#: Cost of a violation, added count of a bucket.
COST = 1.0
SMOOTHING = 1.0
THRESHOLD = 0.3
#: Texts whose 4-grams are sorted at once.
CHUNK = 100
RESULT = ("score", "predicted")


def buckets(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct 4-gram of each text, sorted."""
    raws = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    if len(data) < 4:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = data[:-3].astype(np.uint32)
    for k in range(1, 4):
        gram |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    row = np.repeat(np.arange(len(raws)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(gram)]
    own = np.arange(len(gram)) + 4 <= ends  # within one text
    hashed = (gram * np.uint32(2654435761)) >> np.uint32(32 - bits)
    both = np.unique((row[: len(gram)][own].astype(np.int64) << bits) | hashed[own])
    return both >> bits, both & ((1 << bits) - 1)


def bucket_lists(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct buckets of each text."""
    held = []
    for i in range(0, len(texts), CHUNK):  # few texts at a time: sorting 4-grams takes many times their size
        part = texts[i : i + CHUNK]
        row, bucket = buckets(part)
        starts = np.searchsorted(row, np.arange(len(part) + 1))
        held += [bucket[a:b].astype(np.int32) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return held


@dataclass
class NaiveBayesSvm:
    """``weights`` are those of the linear model times the log-count ratios."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    ratio2: np.ndarray | None = None

    @classmethod
    def fit(cls, texts: list[str | None], labels: list[int], seed: int = 0) -> NaiveBayesSvm:
        return cls.fit_buckets(bucket_lists(texts), labels, seed)

    @classmethod
    def fit_buckets(cls, held: list[np.ndarray], labels: list[int], seed: int = 0) -> NaiveBayesSvm:
        """``held``: the distinct buckets of each text."""
        y = np.where(np.array(labels) == 1, 1.0, -1.0)
        if not len(y) or (y == y[0]).all():
            return cls(np.zeros(1 << BITS), 0.0, 0.0, 20.0 if len(y) and y[0] > 0 else -20.0 if len(y) else 0.0)
        apart = np.arange(len(y)) % 4 == 3  # the curve is fitted on rows that the model hasn't seen
        if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
            apart = np.zeros(len(y), bool)
        model = cls._descend(held, y, np.flatnonzero(~apart), seed)
        judged = apart if apart.any() else ~apart
        margin = np.array([model._margins(np.zeros(len(held[i]), np.int64), held[i], 1)[0] for i in np.flatnonzero(judged)])
        y = y[judged]
        slope, shift = 4.0, 0.0
        weight = len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))  # classes weigh the same
        for _ in range(50):  # Newton steps of a logistic fit, with a little ridge
            p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
            off, q = weight * (p - (y > 0)), weight * p * (1 - p) + 1e-6
            g = np.array([(off * margin).sum() + 1e-2 * slope, off.sum()])
            h = np.array([[(q * margin**2).sum() + 1e-2, (q * margin).sum()], [(q * margin).sum(), q.sum()]])
            move = np.linalg.solve(h, g)
            slope, shift = slope - np.clip(move[0], -2, 2), shift - np.clip(move[1], -2, 2)
        model.slope, model.shift = float(slope), float(shift)
        return model

    @classmethod
    def _descend(cls, held: list[np.ndarray], y: np.ndarray, rows: np.ndarray, seed: int) -> NaiveBayesSvm:
        """The linear model of ``rows`` by dual coordinate descent."""
        seen = [np.full(1 << BITS, SMOOTHING) for _ in range(2)]
        for i in rows:
            seen[0 if y[i] > 0 else 1][held[i]] += 1
        ratio = np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum())
        norm = {i: 1 / np.sqrt(max(1e-9, (ratio[held[i]] ** 2).sum())) for i in rows}  # rows of length one: long texts count as short ones
        w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
        # Classes weigh the same in total.
        cost = COST * len(rows) / 2 / np.where(y > 0, (y[rows] > 0).sum(), (y[rows] < 0).sum())
        order = np.random.default_rng(seed)
        for _ in range(PASSES):
            for i in order.permutation(rows):
                x, at = ratio[held[i]] * norm[i], held[i]
                gradient = y[i] * (w[at] @ x + bias) - 1
                new = min(max(alpha[i] - gradient / 2, 0.0), cost[i])  # a row and its bias have length one each
                if new != alpha[i]:
                    w[at] += (new - alpha[i]) * y[i] * x
                    bias += (new - alpha[i]) * y[i]
                    alpha[i] = new
        return cls(w * ratio, bias, 1.0, 0.0, ratio**2)

    def _margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        if not len(row):
            return np.full(n, self.bias)
        length = np.sqrt(np.maximum(np.bincount(row, self.ratio2[bucket], n), 1e-9))
        return np.bincount(row, self.weights[bucket], n) / length + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.slope:
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        margin = self._margins(*buckets(texts), len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

    def transform(self, df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """Adds score (0 to 1, higher: better) and predicted for every whole text."""
        model = df.sparkSession.sparkContext.broadcast(self)  # of a fixed size: 2^BITS numbers

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield pd.Series(np.concatenate([model.value.score(batch.iloc[i : i + CHUNK].tolist()) for i in range(0, len(batch), CHUNK)] or [np.empty(0)]))

        out = df.select(*[c for c in df.columns if c not in RESULT], score(F.col(text)).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> NaiveBayesSvm:
    """Fits on about ``fit_rows`` labelled rows at most, chosen by a hash of ``key``; null labels are left out."""
    known = labels.where(F.col(label).isNotNull()).select(key, F.col(label).alias("_y"))
    place = F.pmod(F.xxhash64(F.col(key), F.lit("fit")), F.lit(1 << 30))
    share = min(1.0, fit_rows / max(1, known.count()))


    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(bucket_lists(texts.tolist()))

    # The driver gets bucket numbers, 2^BITS for a row at most, whatever the length of its text.
    rows = documents.select(key, text).join(known.where(place < share * (1 << 30)), key).select(found(F.col(text)).alias("b"), "_y", place.alias("p")).collect()
    rows.sort(key=lambda r: (r["p"], len(r["b"]), r["b"][:64]))
    return NaiveBayesSvm.fit_buckets([np.array(r["b"], np.int32) for r in rows], [r["_y"] for r in rows])
