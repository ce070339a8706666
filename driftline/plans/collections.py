"""Independent models, one for each session, and their alignment and pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import fits
from driftline.operators import align, learning
from driftline.operators.learning import Batch, Packed
from driftline.plans.models import HMM, Fit, Model, fit_models


def session_rows(sequences: DataFrame, session: int) -> DataFrame:
    """Rows of one session, numbered 0 as its own model sees it."""
    return sequences.where(F.col("session") == session).withColumn("session", F.lit(0).cast("int"))


class Collection:
    """``models`` by session; each has emissions of one session only. All models go through the same jobs, however many there are."""

    def __init__(self, models: dict[int, Model]):
        self.models = dict(sorted(models.items()))

    @classmethod
    def from_sessions(cls, sequences: DataFrame, make: Callable[[DataFrame], Model]) -> Collection:
        """``make`` builds the model of one session's rows; it runs once a session."""
        sessions = [r[0] for r in sequences.select("session").distinct().collect()]
        return cls({s: make(session_rows(sequences, s)) for s in sessions})

    @classmethod
    def split(cls, model: Model) -> Collection:
        """A model of several sessions as one model for each: all share the start, and are independent from here on."""
        return cls({s: model.replace(emissions=[e]) for s, e in model.params["emissions"].items()})

    def get(self, session: int | None = None) -> Model:
        if session is None and len(self.models) != 1:
            raise ValueError("name a session: there isn't exactly one")
        return self.models[next(iter(self.models)) if session is None else session]

    def map(self, f: Callable[[int, Model], Model]) -> Collection:
        return Collection({s: f(s, m) for s, m in self.models.items()})

    def _own(self, sequences: DataFrame) -> DataFrame:
        """Rows of the sessions that have models."""
        return sequences.where(F.col("session").isin(list(self.models)))

    def _rows(self, sequences: DataFrame, schema: str, make: Callable[[Model, Batch], pd.DataFrame]) -> DataFrame:
        models = self.models

        def each(b: Batch) -> pd.DataFrame:
            return make(models[b.session], b.as_session(0)).assign(session=np.int32(b.session))

        return learning.rows(learning.packed(self._own(sequences)), schema, each)

    def infer(self, sequences: DataFrame) -> DataFrame:
        """Posterior rows of every session under its own model, in one pass."""
        schema = next(iter(self.models.values())).posterior_schema
        return self._rows(sequences, f"session int, seq long, t int, {schema}", lambda m, b: m._posterior(b, m._infer(b)[0]))

    def objective(self, sequences: DataFrame) -> DataFrame:
        make = lambda m, b: pd.DataFrame({"session": np.int32(0), "seq": b.seq, "objective": m._infer(b)[1]})
        return self._rows(sequences, "session int, seq long, objective double", make)

    def fit(self, sequences: DataFrame, num_iters: int = 10, tolerance: float | None = None) -> dict[int, Fit]:
        """Each session's model on its own rows; a step is one aggregation for all sessions. With ``tolerance`` converged ones leave."""
        with Packed(self._own(sequences)) as data:
            return fit_models(self.models, data, num_iters, {s: [s] for s in self.models}, tolerance)

    def permute_states(self, orders: dict[int, np.ndarray]) -> Collection:
        return self.map(lambda s, m: m.permute_states(orders[s]))

    # Hidden Markov models only

    def _counts(self, sequences: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Expected initial (S, K) and transition counts (S, K, K) of each session under its own model."""
        if not all(isinstance(m, HMM) for m in self.models.values()):
            raise TypeError("states of chains only can be aligned")
        models = self.models
        with Packed(self._own(sequences)) as data:
            sums = data.sums(lambda b: _chain_counts(models[b.session], b.as_session(0)))
        return np.array([sums[s]["first"] for s in models]), np.array([sums[s]["pairs"] for s in models])

    def align_states(self, sequences: DataFrame, restarts: int = 10, seed: int = 0) -> Collection:
        """States relabelled so that the sessions' pooled Markov chain is likeliest."""
        orders = align.align_markov_counts(*self._counts(sequences), seed=seed, restarts=restarts)
        return self.permute_states(dict(zip(self.models, orders, strict=True)))

    def compose(self, sequences: DataFrame) -> HMM:
        """One model: chain from pooled counts, emissions of each session."""
        first, pairs = self._counts(sequences)
        some = next(iter(self.models.values()))
        params = {"initial_probs": fits.categorical(first.sum(0)), "transition_probs": fits.categorical(pairs.sum(0)), "emissions": {s: next(iter(m.params["emissions"])) for s, m in self.models.items()}}
        return type(some)(params, some.observations)

    def combine(self, sequences: DataFrame, restarts: int = 10, seed: int = 0) -> HMM:
        """Alignment, then pooling."""
        return self.align_states(sequences, restarts, seed).compose(sequences)


def _chain_counts(model: HMM, batch: Batch) -> dict[str, np.ndarray]:
    post = model._infer(batch)[0]
    return {"first": post.gamma[:, 0].sum(0), "pairs": post.xi.sum((0, 1))}


@dataclass
class Restarts:
    """Fits of one table from several starts."""

    runs: list[Fit]

    @classmethod
    def fit(cls, sequences: DataFrame, starts: Iterable[Model], num_iters: int = 10, tolerance: float | None = None) -> Restarts:
        """All starts side by side: a step is one aggregation, however many there are."""
        models = dict(enumerate(starts))
        with Packed(sequences) as data:
            return cls(list(fit_models(models, data, num_iters, tolerance=tolerance).values()))

    def is_valid(self) -> list[bool]:
        """Whether each objective is a number throughout."""
        return [not np.isnan(f.trace).any() for f in self.runs]

    def best_index(self) -> int:
        """The first valid fit of the highest last objective."""
        valid = [i for i, v in enumerate(self.is_valid()) if v]
        if not valid:
            raise ValueError("no fit has an objective without NaN")
        return max(valid, key=lambda i: (self.runs[i].trace[-1], -i))

    def get(self, index: int) -> Fit:
        return self.runs[index]

    def best(self) -> Fit:
        return self.runs[self.best_index()]


@dataclass
class SessionRestarts:
    """Fits of several starts for every session, each session by itself."""

    runs: dict[int, Restarts]

    @classmethod
    def fit(cls, sequences: DataFrame, starts: dict[int, list[Model]], num_iters: int = 10, tolerance: float | None = None) -> SessionRestarts:
        """``starts`` has the models of each session; all sessions and starts go through the same jobs."""
        numbered = [(s, m) for s, own in sorted(starts.items()) for m in own]
        owners: dict[int, list[int]] = {}
        for r, (s, _) in enumerate(numbered):
            owners.setdefault(s, []).append(r)
        with Packed(sequences.where(F.col("session").isin(list(owners)))) as data:
            fits_ = fit_models({r: m for r, (_, m) in enumerate(numbered)}, data, num_iters, owners, tolerance)
        return cls({s: Restarts([fits_[r] for r in own]) for s, own in owners.items()})

    def best(self) -> Collection:
        """The best fit of every session."""
        return Collection({s: r.best().model for s, r in self.runs.items()})
