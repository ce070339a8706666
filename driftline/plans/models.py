"""Model families over sequence tables: HMM, AR-HMM, LDS and SLDS, each with Gaussian or Poisson observations; HMM, LDS and SLDS
with observations of one's own too (:mod:`driftline.functions.observations`).

Sessions share latent and dynamics parameters; emissions are one set for each session. Parameters are plain dictionaries
of arrays (``params``); inference returns DataFrames; fitting runs exactly ``num_iters`` steps and keeps a trace with the
initial objective first. With ``block``, chains of states and Gaussian chains go through blocks of that many steps, so that
a sequence of any length is spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import fits, observations as kinds
from driftline.functions.dists import Affine, LinearGaussian, LinearPoisson
from driftline.functions.observations import GAUSSIAN, POISSON
from driftline.operators import align, blocked, chains, cluster, learning, moments
from driftline.operators.learning import Batch, Packed
from driftline.operators.structure import lagged
from driftline.sources import params as storage

SAMPLED = "session int, seq long, t int, z int, x array<double>, y array<double>, u array<double>, visible boolean"
#: Steps that a batch of drawn sequences has, about.
SAMPLED_STEPS = 1 << 14


@dataclass
class Fit:
    """A fitted model and its objective before and after every step."""

    model: Model
    trace: list[float]

    def trace_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(map(float, self.trace))), "iter int, objective double")


class Emissions:
    """Emission parameters by session identifier; a list stands for sessions 0, 1, and so on. Iteration gives the parameters."""

    def __init__(self, given):
        pairs = given.items() if isinstance(given, dict | Emissions) else enumerate(given)
        self._own = {int(s): {k: np.asarray(v, float) for k, v in e.items()} for s, e in pairs}
        if not self._own:
            raise ValueError("no session has emissions")

    def __getitem__(self, session: int) -> dict[str, np.ndarray]:
        if int(session) not in self._own:
            raise KeyError(f"no emissions of session {session}; there are {sorted(self._own)}")
        return self._own[int(session)]

    def __iter__(self):
        return iter(self._own.values())

    def __len__(self) -> int:
        return len(self._own)

    def items(self):
        return self._own.items()

    def map(self, change: Callable[[dict], dict]) -> Emissions:
        return Emissions({s: change(e) for s, e in self._own.items()})


class Model:
    """What the families share. ``params`` holds shared arrays and ``emissions`` (see :class:`Emissions`).

    With ``diagonal``, fits of Gaussian observations and of the dynamics noise estimate variances only; covariances are
    stored as matrices without off-diagonal entries, and given ones that have some raise ValueError.
    """

    family = ""
    offset = 0
    noises = ("dynamics_covariance", "dynamics_covariances")

    def __init__(self, params: dict, observations: str | kinds.StateObservations | kinds.Likelihood = GAUSSIAN, diagonal: bool = False):
        self._of(observations)
        self.params = {k: (v if k == "emissions" else np.asarray(v, float)) for k, v in params.items()}
        self.params["emissions"] = Emissions(params["emissions"])
        self.observations, self.diagonal = observations, diagonal
        if diagonal:
            for c in [*(self.params[k] for k in self.noises if k in self.params), *(e["covariance"] for e in self.params["emissions"] if "covariance" in e)]:
                if (np.abs(c * (1 - np.eye(c.shape[-1]))) > 0).any():
                    raise ValueError("a diagonal covariance has off-diagonal entries")

    def _of(self, observations) -> None:
        """Refuses observations that the family doesn't know."""
        if observations not in (GAUSSIAN, POISSON):
            raise ValueError(observations)

    @classmethod
    def from_params(cls, params: dict, observations: str = GAUSSIAN, diagonal: bool = False) -> Model:
        return cls(params, observations, diagonal)

    def to_params(self) -> dict:
        return self.params

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        kind = f"{getattr(self.observations, 'name', self.observations)}-{self.family}{'-diagonal' if self.diagonal else ''}"
        storage.save_params(spark, path, kind, self.params | {"emissions": {str(s): e for s, e in self.params["emissions"].items()}}, overwrite)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        name, params = storage.load_params(spark, path)
        observations, family, *more = name.split("-")
        return _families()[family](params, kinds.KINDS.get(observations, observations), "diagonal" in more)

    # What a family defines

    def _infer(self, batch: Batch):
        """(posterior, objective (B,))."""
        raise NotImplementedError

    def _statistics(self, batch: Batch, posterior) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def _maximise(self, sums: learning.Sums, newer: dict) -> Model:
        """The next model from the sums of each session; ``newer`` has regressions (coefficients, bias) of those that need Newton steps."""
        raise NotImplementedError

    def _regresses(self) -> Callable | None:
        """What measures the regressions of emissions, where they aren't closed."""
        return None

    def _posterior(self, batch: Batch, posterior) -> pd.DataFrame:
        raise NotImplementedError

    posterior_schema = ""

    def _check(self, sequences: DataFrame) -> DataFrame:
        return sequences

    # Facade

    def _table(self, sequences: DataFrame, block: int | None) -> DataFrame:
        if block is None:
            return learning.packed(self._check(sequences))
        return blocked.Blocked(self._check(sequences), block, self._overlap(), keep=False).under(self)

    def _overlap(self) -> int:
        """Steps that a block of time shares with the next one; TypeError where a family can't go by blocks."""
        raise TypeError(f"{self.family} with these observations has no inference by blocks")

    def infer(self, sequences: DataFrame, block: int | None = None) -> DataFrame:
        """Posterior rows for every step of every sequence."""
        return learning.rows(self._table(sequences, block), f"session int, seq long, t int, {self.posterior_schema}", lambda b: self._posterior(b, self._infer(b)[0]))

    def objective(self, sequences: DataFrame, block: int | None = None) -> DataFrame:
        """(session, seq, objective): exact log-likelihood, Laplace normalizer or lower bound, by family."""
        found = learning.rows(self._table(sequences, block), "session int, seq long, objective double", lambda b: pd.DataFrame({"session": np.int32(b.session), "seq": b.seq, "objective": self._infer(b)[1]}))
        return found if block is None else found.groupBy("session", "seq").agg(F.sum("objective").alias("objective"))

    def fit(self, sequences: DataFrame, num_iters: int = 10, block: int | None = None) -> Fit:
        """Exactly ``num_iters`` steps of (variational, Laplace) expectation-maximization."""
        data = Packed(self._check(sequences)) if block is None else blocked.Blocked(self._check(sequences), block, self._overlap())
        with data:
            return fit_models({0: self}, data, num_iters)[0]

    def sample(self, spark: SparkSession, lengths: dict[int, list[int]] | None = None, seed: int = 0, inputs: DataFrame | None = None, history: np.ndarray | None = None) -> DataFrame:
        """Sequences of the model with the lengths of each session, and their latent truth; one random stream a sequence.

        ``inputs`` (session, seq, t, u) drive the dynamics, and set the lengths in place of ``lengths``. ``history`` (L, D),
        most recent first, is what an AR-HMM continues; without one it starts from zeros.
        """
        if (lengths is None) == (inputs is None):
            raise ValueError("either lengths or inputs")
        if history is not None:
            history = np.asarray(history, float)
            if self.offset == 0 or history.ndim != 2 or len(history) != self.offset:
                raise ValueError(f"a history has {self.offset} steps here")

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                sessions, seqs, every = (np.asarray(part.column(c), np.int64).tolist() for c in ("session", "seq", "steps"))
                drives = learning.vectors(part.column("u"))
                drawn, rows = [], 0
                for session, seq, steps, u in zip(sessions, seqs, every, drives, strict=True):
                    u = np.zeros((steps, 0)) if u is None else u
                    drawn.append((session, seq, steps, u, *self._sample(np.random.default_rng([seed, session, seq]), session, steps, u, history)))
                    rows += steps
                    if rows >= SAMPLED_STEPS:
                        yield _drawn(drawn)
                        drawn, rows = [], 0
                if drawn:
                    yield _drawn(drawn)

        if inputs is None:
            plan = [(s, n, t, None) for s, ts in lengths.items() for n, t in enumerate(ts)]
            table = spark.createDataFrame(plan, "session int, seq long, steps int, u array<array<double>>").repartition("session", "seq")
        else:
            steps = F.sort_array(F.collect_list(F.struct("t", "u")))
            table = inputs.groupBy("session", "seq").agg(steps.alias("s")).select("session", "seq", F.size("s").alias("steps"), F.col("s.u").alias("u"))
        return table.mapInArrow(run, SAMPLED)

    def _sample(self, rng: np.random.Generator, session: int, steps: int, u: np.ndarray, history: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _noisy(self, rng: np.random.Generator, session: int, x: np.ndarray) -> np.ndarray:
        e = self.params["emissions"][session]
        eta = x @ e["coefficients"].T + e["bias"]
        if self.likelihood is not None:
            return self.likelihood.sample(rng, eta)
        return eta + rng.standard_normal(eta.shape) @ np.linalg.cholesky(e["covariance"]).T

    def replace(self, **changes) -> Model:
        return type(self)(self.params | changes, self.observations, self.diagonal)


def _drawn(drawn: list[tuple]) -> pa.RecordBatch:
    """One row a step of drawn sequences (session, seq, steps, u, z, x, y)."""
    sessions, seqs, steps, us, zs, xs, ys = zip(*drawn, strict=True)
    steps = np.array(steps, np.int64)
    t = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    lists = [pa.concat_arrays([learning.nested(v) for v in own]) for own in (xs, ys, us)]
    columns = [pa.array(np.repeat(np.array(sessions, np.int32), steps)), pa.array(np.repeat(np.array(seqs, np.int64), steps)), pa.array(t.astype(np.int32)), pa.array(np.concatenate(zs).astype(np.int32)), *lists, pa.array(np.ones(len(t), bool))]
    return pa.RecordBatch.from_arrays(columns, schema=learning.arrow_schema(SAMPLED))


def factor(covariance: np.ndarray) -> np.ndarray:
    """The factors F of covariances, as numpy's multivariate_normal has them: mean + F @ standard normal numbers."""
    u, s, _ = np.linalg.svd(covariance)
    return u * np.sqrt(s)[..., None, :]


def fit_models(models: dict[int, Model], data: Packed | blocked.Blocked, num_iters: int = 10, owners: dict[int, list[int]] | None = None, tolerance: float | None = None) -> dict[int, Fit]:
    """Fits models side by side: whatever their number, a step is one aggregation, and so is a Newton move of those that need any.

    Without ``owners`` every model learns from all sessions. ``owners`` names the models of each session; such a model sees its
    session as session 0. With ``tolerance``, a model whose objective rises by less than that share of it is left as it is.
    """
    now, traces, live = dict(models), {r: [] for r in models}, set(models)
    if isinstance(data, blocked.Blocked) and len(models) > 1:
        raise ValueError("blocks have the messages of one model")
    for k in range(num_iters + 1):
        current, last = {r: now[r] for r in sorted(live)}, k == num_iters
        if isinstance(data, blocked.Blocked):
            data.under(current[0])

        def statistics(b: Batch, current: dict[int, Model] = current, last: bool = last) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
            for r, own in _views(b, current, owners):
                posterior, objective = current[r]._infer(own)
                yield r, own.session, {"objective": objective.sum()} | ({} if last else current[r]._statistics(own, posterior))

        sums = data.all_sums(statistics)
        for r in current:
            traces[r].append(float(sum(s["objective"] for s in sums.get(r, {}).values())))
            gain = traces[r][-1] - traces[r][-2] if k else np.inf
            if last or (tolerance is not None and abs(gain) <= tolerance * (1 + abs(traces[r][-1]))):
                live.discard(r)
        if not live:
            break
        moving = {r: current[r] for r in sorted(live)}
        regressing = {r: m for r, m in moving.items() if m._regresses() is not None}
        newer = _regressions(regressing, data, owners) if regressing else {}
        for r, m in moving.items():
            now[r] = m._maximise(sums.get(r, {}), newer.get(r, {}))
    return {r: Fit(now[r], traces[r]) for r in models}


def _views(b: Batch, models: dict[int, Model], owners: dict[int, list[int]] | None) -> Iterator[tuple[int, Batch]]:
    """The models that a batch is for, and the batch as each sees it."""
    if owners is None:
        return ((r, b) for r in models)
    return ((r, b.as_session(0)) for r in owners.get(b.session, []) if r in models)


def draw_states(rng: np.random.Generator, initial: np.ndarray, transition: np.ndarray, steps: int) -> np.ndarray:
    sums, totals = np.cumsum(transition, -1).tolist(), transition.sum(-1).tolist()
    now, total, z = np.cumsum(initial).tolist(), float(initial.sum()), []
    for chance in rng.random(steps).tolist():
        z.append(bisect_left(now, chance * total))
        now, total = sums[z[-1]], totals[z[-1]]
    return np.array(z, np.int32)


class HMM(Model):
    """Params: initial_probs (K,), transition_probs (K, K); emissions mean (K, D) and covariance (K, D, D), or log_rates (K, D)."""

    family = "hmm"
    posterior_schema = "gamma array<double>, state int, xi_next array<array<double>>"

    def _of(self, observations) -> None:
        self.kind = kinds.state_kind(observations)

    def _overlap(self) -> int:
        return self.offset

    def scan(self) -> blocked.DiscreteScan:
        return blocked.DiscreteScan(self.params["initial_probs"], self.params["transition_probs"])

    def elements(self, batch: Batch) -> np.ndarray:
        return blocked.DiscreteScan.element(self.params["transition_probs"], *self._local(batch))

    def _local(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Log factors (B, R, K) of the chain's steps, and how many count."""
        seen = batch.weight[..., None] > 0
        return np.where(seen, self.kind.log_prob(self.params["emissions"][batch.session], np.where(seen, batch.y, 0.0)), 0.0), batch.lengths

    def _infer(self, batch: Batch):
        local, lengths = self._local(batch)
        if batch.before is None:
            post = chains.discrete_chain(self.params["initial_probs"], self.params["transition_probs"], local, lengths)
            return post, post.log_normalizer
        post = chains.discrete_block(np.exp(batch.before), self.params["transition_probs"], local, lengths, batch.ahead)
        return post, post.log_normalizer

    def _firsts(self, batch: Batch, gamma: np.ndarray) -> np.ndarray:
        """Posterior of the first steps of sequences, added up."""
        begins = np.ones(len(gamma), bool) if batch.block is None else batch.block == 0
        return gamma[begins, 0].sum(0)

    def _statistics(self, batch: Batch, post: chains.DiscretePosterior) -> dict[str, np.ndarray]:
        w = post.gamma * batch.weight[..., None]
        y = np.where(batch.weight[..., None] > 0, batch.y, 0.0)
        return {"first": self._firsts(batch, post.gamma), "pairs": post.xi.sum((0, 1)), "n": w.sum((0, 1))} | self.kind.sums(w, y)

    def _chain_step(self, sums: learning.Sums) -> dict[str, np.ndarray]:
        first = sum(s["first"] for s in sums.values())
        pairs = sum(s["pairs"] for s in sums.values())
        return {
            "initial_probs": fits.categorical(first, self.params["initial_probs"], np.finfo(float).tiny),
            "transition_probs": fits.categorical(pairs, self.params["transition_probs"], fits.MIN_OCCUPANCY),
        }

    def _maximise(self, sums: learning.Sums, newer: dict) -> HMM:
        emissions = {session: self.kind.maximise(sums[session], old, self.diagonal) if session in sums else old for session, old in self.params["emissions"].items()}
        return self.replace(**self._chain_step(sums), emissions=emissions)

    def _posterior(self, batch: Batch, post: chains.DiscretePosterior) -> pd.DataFrame:
        lengths = np.maximum(batch.lengths - self.offset, 0)
        out = learning.step_rows(batch, {"gamma": post.gamma, "state": post.gamma.argmax(-1).astype(np.int32)}, self.offset, lengths)
        b, t = np.nonzero(chains.valid(lengths, batch.steps - self.offset))
        pairs = post.pairs()
        out["xi_next"] = learning.held(learning.nested(post.xi[b, np.minimum(t, post.xi.shape[1] - 1)], t < pairs[b])) if post.xi.shape[1] else [None] * len(b)
        return out

    def decode(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, t, state): the likeliest state of each step, the lowest of equal ones."""
        return self.infer(sequences).select("session", "seq", "t", "state")

    def entropy(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, entropy, elbo) of the posterior path; the bound is the log-likelihood, as inference is exact."""

        def make(b: Batch) -> pd.DataFrame:
            post, objective = self._infer(b)
            return pd.DataFrame({"session": np.int32(b.session), "seq": b.seq, "entropy": post.entropy(), "elbo": objective})

        return learning.rows(learning.packed(self._check(sequences)), "session int, seq long, entropy double, elbo double", make)

    def observation_mean(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, t, mean): posterior mean of the observation of each step."""

        def make(b: Batch) -> pd.DataFrame:
            return learning.step_rows(b, {"mean": self._infer(b)[0].gamma @ self.kind.means(self.params["emissions"][b.session])})

        return learning.rows(learning.packed(self._check(sequences)), "session int, seq long, t int, mean array<double>", make)

    def _state_means(self, batch: Batch) -> np.ndarray:
        """(B, R, K, D) mean observation of every state at each step."""
        means = self.kind.means(self.params["emissions"][batch.session])
        return np.broadcast_to(means, (len(batch.seq), batch.steps, *means.shape))

    def state_means(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, t, means): the mean observation given each state, (K, D) a step."""

        def make(b: Batch) -> pd.DataFrame:
            return learning.step_rows(b, {"means": self._state_means(b)}, self.offset, np.maximum(b.lengths - self.offset, 0))

        return learning.rows(learning.packed(self._check(sequences)), "session int, seq long, t int, means array<array<double>>", make)

    def match_conditional(self, sequences: DataFrame, target: HMM) -> HMM:
        """States in the order that brings their means at the steps of ``sequences`` closest to those of ``target``."""

        def costs(b: Batch) -> dict[str, np.ndarray]:
            own, other = self._state_means(b), target._state_means(b)
            gap = ((other[:, :, :, None] - own[:, :, None]) ** 2).sum(-1)
            seen = chains.valid(np.maximum(b.lengths - self.offset, 0), gap.shape[1])
            return {"costs": np.where(seen[..., None, None], gap, 0.0).sum((0, 1))}

        with Packed(self._check(sequences)) as data:
            return self.permute_states(align.match_permutation(sum(s["costs"] for s in data.sums(costs).values())))

    def permute_states(self, order: np.ndarray) -> HMM:
        """New state k is old state order[k]."""
        order = np.asarray(order)
        emissions = self.params["emissions"].map(lambda e: {k: v[order] for k, v in e.items()})
        return self.replace(initial_probs=self.params["initial_probs"][order], transition_probs=self.params["transition_probs"][np.ix_(order, order)], emissions=emissions)

    def match_states(self, means: np.ndarray, session: int = 0) -> HMM:
        """States in the order that brings the session's means closest to ``means``."""
        return self.permute_states(align.match_by_mean(self.kind.means(self.params["emissions"][session]), np.asarray(means, float)))

    @classmethod
    def initialize(cls, sequences: DataFrame, num_states: int, observations: str | kinds.StateObservations = GAUSSIAN, seed: int = 0, steps: int = 20, centers: dict[int, np.ndarray] | None = None, diagonal: bool = False) -> HMM:
        """Uniform initial and sticky transition probabilities; emissions from K-means of each session's visible observations."""
        kind = kinds.state_kind(observations)
        rows = sequences.where("visible").select("session", kind.features(F.col("y")).alias("y"))
        emissions = {session: kind.start(n, s, q, diagonal) for session, (n, s, q) in _partition(sequences, rows, num_states, seed, steps, centers).items()}
        return cls({"initial_probs": np.full(num_states, 1 / num_states), "transition_probs": sticky(num_states), "emissions": emissions}, observations, diagonal)

    def _sample(self, rng, session, steps, u, history):
        z = draw_states(rng, self.params["initial_probs"], self.params["transition_probs"], steps)
        return z, np.zeros((steps, 0)), self.kind.sample(rng, self.params["emissions"][session], z)


def _sessions(sequences: DataFrame) -> list[int]:
    """Identifiers of the sessions; ValueError where there is none to learn from."""
    found = sorted(r[0] for r in sequences.select("session").distinct().collect())
    if not found:
        raise ValueError("a table without sequences has nothing to start a model from")
    return found


def _partition(sequences: DataFrame, rows: DataFrame, k: int, seed: int, steps: int, centers: dict[int, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums of the K-means clusters of ``rows`` (session, y), by session; ValueError where one has no row that counts."""
    sessions = _sessions(sequences)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = cluster.partition(rows, k, seed, steps, centers)
    finally:
        rows.unpersist()
    missing = [s for s in sessions if s not in found]
    if missing:
        raise ValueError(f"nothing visible to start from in sessions {missing}")
    return {s: found[s] for s in sessions}


def sticky(k: int, stay: float = 0.9) -> np.ndarray:
    return np.eye(k) if k == 1 else np.full((k, k), (1 - stay) / (k - 1)) + (stay - (1 - stay) / (k - 1)) * np.eye(k)


class ARHMM(HMM):
    """An HMM whose observations regress on the last ``lags`` ones, most recent first.

    Params as HMM; emissions coefficients (K, D, L * D), bias (K, D) and covariance (K, D, D) for Gaussian observations.
    The first ``lags`` steps are history; a step counts only if it and its whole history are visible.
    """

    family = "arhmm"

    def __init__(self, params: dict, observations: str = GAUSSIAN, diagonal: bool = False):
        super().__init__(params, observations, diagonal)
        e = next(iter(self.params["emissions"]))
        self.offset = e["coefficients"].shape[-1] // e["coefficients"].shape[-2]

    def _of(self, observations) -> None:
        Model._of(self, observations)

    def windows(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Targets (B, R, D), histories (B, R, L * D), weights and lengths of the compact timeline."""
        lags, t = self.offset, batch.steps
        past = np.concatenate([batch.y[:, lags - k : t - k] for k in range(1, lags + 1)], -1)
        w = batch.weight[:, lags:].copy()
        for k in range(1, lags + 1):
            w *= batch.weight[:, lags - k : t - k]
        return batch.y[:, lags:], past, w, np.maximum(batch.lengths - lags, 0)

    def _local(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        if (batch.lengths <= self.offset).any():
            raise ValueError("a sequence has no step beyond its history")
        y, x, w, lengths = self.windows(batch)
        e = self.params["emissions"][batch.session]
        dist = LinearPoisson(e["coefficients"], e["bias"]) if self.observations == POISSON else LinearGaussian(e["coefficients"], e["bias"], e["covariance"])
        seen = w[..., None] > 0
        return np.where(seen, dist.log_prob(np.where(seen, y, 0.0), np.where(seen, x, 0.0)), 0.0), lengths

    def _statistics(self, batch: Batch, post):
        y, x, w, _ = self.windows(batch)
        out = {"first": self._firsts(batch, post.gamma), "pairs": post.xi.sum((0, 1)), "n": (post.gamma * w[..., None]).sum((0, 1))}
        if self.observations == GAUSSIAN:
            v = np.where(w[..., None] > 0, np.concatenate([x, y], -1), 0.0)
            g = post.gamma * w[..., None]
            out |= {"s": np.einsum("btk,btd->kd", g, v), "q": np.einsum("btk,btd,bte->kde", g, v, v)}
        return out

    def _regresses(self) -> Callable | None:
        return fits.poisson_statistics if self.observations == POISSON else None

    def _maximise(self, sums: learning.Sums, newer: dict) -> ARHMM:
        emissions = {}
        for session, old in self.params["emissions"].items():
            s = sums.get(session)
            if s is None:
                emissions[session] = old
                continue
            weak = s["n"] < fits.MIN_OCCUPANCY
            if self.observations == POISSON:
                w, b = newer[session]
                emissions[session] = {"coefficients": np.where(weak[:, None, None], old["coefficients"], w), "bias": np.where(weak[:, None], old["bias"], b)}
            else:
                w, b, c = fits.regression(s["n"], s["s"], s["q"], old["coefficients"].shape[-1], diagonal=self.diagonal)
                emissions[session] = {"coefficients": np.where(weak[:, None, None], old["coefficients"], w), "bias": np.where(weak[:, None], old["bias"], b), "covariance": np.where(weak[:, None, None], old["covariance"], c)}
        return self.replace(**self._chain_step(sums), emissions=emissions)

    def regressors(self, batch: Batch) -> dict[str, np.ndarray]:
        """Weights (N, K), inputs (N, P) and targets (N, D) of visible steps under the posterior."""
        post = self._infer(batch)[0]
        y, x, w, lengths = self.windows(batch)
        on = (w > 0) & chains.valid(lengths, y.shape[1])
        return {"w": post.gamma[on], "x": x[on], "y": y[on], "spread": None}

    def _state_means(self, batch: Batch) -> np.ndarray:
        e = self.params["emissions"][batch.session]
        eta = LinearPoisson(e["coefficients"], e["bias"]).log_rates(self.windows(batch)[1])
        return np.exp(eta) if self.observations == POISSON else eta

    def observation_mean(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, t, mean) given each step's history."""

        def make(b: Batch) -> pd.DataFrame:
            mean = np.einsum("btk,btkd->btd", self._infer(b)[0].gamma, self._state_means(b))
            return learning.step_rows(b, {"mean": mean}, self.offset, np.maximum(b.lengths - self.offset, 0))

        return learning.rows(learning.packed(self._check(sequences)), "session int, seq long, t int, mean array<double>", make)

    @classmethod
    def initialize(cls, sequences: DataFrame, num_states: int, lags: int = 1, observations: str = GAUSSIAN, seed: int = 0, steps: int = 20, diagonal: bool = False, pooled: bool = False) -> ARHMM:
        """States from K-means of (observation, history); regressions within each. With ``pooled`` all sessions are taken as session 0."""
        emissions = {}
        rows = lagged(sequences, lags).where("visible").select("session", F.concat(F.flatten("lags"), "y").alias("y"))
        if pooled:
            sequences, rows = (x.withColumn("session", F.lit(0)) for x in (sequences, rows))
        for session, (n, s, q) in _partition(sequences, rows, num_states, seed, steps).items():
            size = s.shape[1]
            inputs = size * lags // (lags + 1)
            if observations == POISSON:
                rate = fits.poisson(n, s[:, inputs:])
                emissions[session] = {"coefficients": np.zeros((num_states, size - inputs, inputs)), "bias": rate}
            else:
                w, b, c = fits.regression(n, s, q, inputs, floor=fits.INIT_FLOOR, diagonal=diagonal)
                emissions[session] = {"coefficients": w, "bias": b, "covariance": c}
        return cls({"initial_probs": np.full(num_states, 1 / num_states), "transition_probs": sticky(num_states), "emissions": emissions}, observations, diagonal)

    def _sample(self, rng, session, steps, u, history):
        z = draw_states(rng, self.params["initial_probs"], self.params["transition_probs"], steps)
        e = self.params["emissions"][session]
        d = e["bias"].shape[-1]
        y, past = np.zeros((steps, d)), np.zeros((self.offset, d)) if history is None else history
        counts = self.observations == POISSON
        noise = None if counts else (factor(e["covariance"])[z] @ rng.standard_normal((steps, d, 1)))[..., 0]
        for t in range(steps):
            eta = e["coefficients"][z[t]] @ past.ravel() + e["bias"][z[t]]
            y[t] = rng.poisson(np.exp(eta)) if counts else eta + noise[t]
            past = np.concatenate([y[t][None], past[:-1]])
        return z, np.zeros((steps, 0)), y


def _regressions(models: dict[int, Model], data: Packed | blocked.Blocked, owners: dict[int, list[int]] | None) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Regressions under the posteriors of models that use one kind of measure: their rows are kept, and every Newton step is one aggregation."""
    schema = "run int, session int, w array<double>, x array<double>, y array<double>, spread array<double>"
    names = [c.split()[0] for c in schema.split(", ")]

    def make(b: Batch) -> pd.DataFrame:
        frames = []
        for r, own in _views(b, models, owners):
            found = models[r].regressors(own)
            n = len(found["x"])
            flat = np.zeros((n, 0)) if found["spread"] is None else found["spread"].reshape(n, int(np.prod(found["spread"].shape[1:])))
            columns = {c: learning.held(learning.nested(v)) for c, v in (("w", found["w"]), ("x", found["x"]), ("y", found["y"]), ("spread", flat))}
            frames.append(pd.DataFrame({"run": np.full(n, r, np.int32), "session": np.full(n, own.session, np.int32)} | columns))
        return pd.concat(frames) if frames else pd.DataFrame({n: [] for n in names})

    table = learning.rows(data.table, schema, make).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = {(r, s) for r in models for s in ((0,) if owners is not None else data.sessions)}
        old = {(r, s): (e["coefficients"], e["bias"]) for r, m in models.items() for s, e in m.params["emissions"].items() if (r, s) in seen}
        out: dict[int, dict] = defaultdict(dict)
        for (r, s), found in regress(table, old, {r: m._regresses() for r, m in models.items()}).items():
            out[r][s] = found
        return dict(out)
    finally:
        table.unpersist()


def regress_counts(table: DataFrame, old: dict[int, tuple[np.ndarray, np.ndarray]], steps: int = 5, statistics: Callable = fits.poisson_statistics) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Regressions of rows (session, w, x, y, spread), from the coefficients and biases ``old`` of each session."""
    found = regress(table.withColumn("run", F.lit(0)), {(0, s): v for s, v in old.items()}, {0: statistics}, steps)
    return {s: v for (_, s), v in found.items()}


def regress(table: DataFrame, old: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], statistics: dict[int, Callable], steps: int = 5) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Regressions of rows (run, session, w, x, y, spread), from the coefficients and biases ``old`` of each run and session.

    All move together, a step or half step being one aggregation; each output is halved by itself. A session without rows keeps its own.
    """
    shapes = {k: (np.atleast_3d(w).shape if w.ndim == 3 else (1, *w.shape)) for k, (w, _) in old.items()}
    inputs = {p for _, _, p in shapes.values()}
    if len(inputs) != 1:  # as many runs of Newton steps as there are sizes
        each = [regress(table.where(F.size("x") == p), {k: v for k, v in old.items() if shapes[k][2] == p}, statistics, steps) for p in sorted(inputs)]
        return {k: v for found in each for k, v in found.items()}
    start = np.concatenate([np.concatenate([w.reshape(shapes[k]), b.reshape(shapes[k][:2])[..., None]], -1).reshape(-1, shapes[k][2] + 1) for k, (w, b) in old.items()])

    def parts(theta: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        out, at = {}, 0
        for key, (k, o, p) in shapes.items():
            out[key] = theta[at : at + k * o].reshape(k, o, p + 1)
            at += k * o
        return out

    def measure(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        now = parts(theta)

        def pieces(batches):
            for batch in batches:
                keys = np.stack([np.asarray(batch.column(c), np.int64) for c in ("run", "session")], 1)
                found, which = np.unique(keys, axis=0, return_inverse=True)
                for at, (run, session) in enumerate(found.tolist()):
                    own = batch if len(found) == 1 else batch.take(pa.array(np.flatnonzero(which == at)))
                    w, x, y, spread = (learning.matrix(own.column(c)) for c in ("w", "x", "y", "spread"))
                    spread = spread.reshape(len(x), x.shape[1], x.shape[1]) if spread.size else None
                    for k in range(w.shape[1]):
                        theta = now[run, session][k]
                        v, g, h = statistics[run](theta[:, :-1], theta[:, -1], y, x, w[:, k], spread)
                        yield run, session, {f"v{k}": v, f"g{k}": g, f"h{k}": h, f"n{k}": w[:, k].sum(), f"m{k}": (w[:, k, None] * x**2).sum(0)}

        got = learning.total(table, pieces)
        value, gradient, hessian = [], [], []
        for (run, session), (k, o, p) in shapes.items():
            found = got.get(run, {}).get(session)
            for j in range(k):
                if found is None:
                    value.append(np.zeros(o))
                    gradient.append(np.zeros((o, p + 1)))
                    hessian.append(np.tile(-np.eye(p + 1), (o, 1, 1)))
                    continue
                scale = max(found[f"m{j}"].mean(), np.finfo(float).tiny) if p else 1.0
                rho = fits.RIDGE * scale + 1e-8
                c = now[run, session][j, :, :p]
                value.append(found[f"v{j}"] - 0.5 * rho * (c**2).sum(-1))
                gradient.append(found[f"g{j}"] - rho * np.concatenate([c, np.zeros((o, 1))], 1))
                hessian.append(found[f"h{j}"] - rho * np.diag([1.0] * p + [0.0]))
        return np.concatenate(value), np.concatenate(gradient), np.concatenate(hessian)

    found = parts(fits.newton(start, measure, steps=steps, tolerance=1e-6))
    return {k: (found[k][..., :-1].reshape(old[k][0].shape), found[k][..., -1].reshape(old[k][1].shape)) for k in found}


class LDS(Model):
    """Params: initial_mean, initial_covariance, dynamics_coefficients, dynamics_bias, dynamics_covariance, optionally
    dynamics_input_coefficients; emissions coefficients (O, D), bias (O,) and, for Gaussian observations, covariance.
    ``u`` of step t acts on the move from t-1 to t.
    """

    family = "lds"
    posterior_schema = "mean array<double>, cov array<array<double>>, cross_next array<array<double>>"

    def _of(self, observations) -> None:
        self.likelihood = kinds.likelihood_kind(observations)

    def _overlap(self) -> int:
        if self.likelihood is not None:
            return super()._overlap()
        return 1

    def scan(self) -> blocked.GaussianScan:
        return blocked.GaussianScan(len(self.params["initial_mean"]))

    def elements(self, batch: Batch) -> np.ndarray:
        return self.scan().element(self._factors(batch))

    @staticmethod
    def _own(batch: Batch) -> np.ndarray:
        """(B, T) steps that belong to a batch: a block's first step belongs to the block before it, but in the first block."""
        on = chains.valid(batch.lengths, batch.steps)
        if batch.block is not None and batch.steps:
            on[:, 0] &= batch.block == 0
        return on

    def _factors(self, batch: Batch) -> chains.GaussianFactors:
        """Prior and emissions of a batch."""
        e = self.params["emissions"][batch.session]
        return chains.add_gaussian_emissions(self._prior(batch), batch.y, batch.weight * self._own(batch), e["coefficients"], e["bias"], e["covariance"])

    def _drive(self, batch: Batch) -> np.ndarray:
        p = self.params
        bias = np.broadcast_to(p["dynamics_bias"], (len(batch.seq), max(batch.steps - 1, 0), len(p["dynamics_bias"])))
        return bias + batch.u[:, 1:] @ p["dynamics_input_coefficients"].T if "dynamics_input_coefficients" in p else bias

    def _prior(self, batch: Batch) -> chains.GaussianFactors:
        p = self.params
        shape = (len(batch.seq), max(batch.steps - 1, 0), *p["dynamics_covariance"].shape)
        return chains.linear_factors(p["initial_mean"], p["initial_covariance"], np.broadcast_to(p["dynamics_coefficients"], shape), self._drive(batch), np.broadcast_to(p["dynamics_covariance"], shape), batch.steps, batch.lengths, None if batch.block is None else batch.block == 0)

    def _infer(self, batch: Batch):
        e = self.params["emissions"][batch.session]
        if self.likelihood is not None:
            y = np.where(batch.weight[..., None] > 0, batch.y, 0.0)
            post, _ = chains.laplace_chain(self._prior(batch), y, batch.weight, e["coefficients"], e["bias"], self.likelihood)
        elif batch.before is None:
            post = chains.gaussian_chain(self._factors(batch))
        else:
            # Every block's normalizer is that of the whole sequence; the first block stands for all.
            post = chains.gaussian_chain(self.scan().with_messages(self._factors(batch), batch.before, batch.ahead))
            return post, np.where(batch.block == 0, post.log_normalizer, 0.0)
        return post, post.log_normalizer

    def _statistics(self, batch: Batch, post: chains.GaussianPosterior) -> dict[str, np.ndarray]:
        on = self._own(batch)
        out = _latent_statistics(batch, post, np.ones((len(batch.seq), batch.steps, 1)), "dynamics_input_coefficients" in self.params)
        out |= {"all_n": on.sum(), "all_s": (post.mean * on[..., None]).sum((0, 1)), "all_q": (post.second() * on[..., None, None]).sum((0, 1))}
        if self.likelihood is None:
            out |= _emission_statistics(batch, post, on)
        return out

    def _regresses(self) -> Callable | None:
        return None if self.likelihood is None else self.likelihood.statistics

    def _emissions(self, sums: learning.Sums, newer: dict) -> dict[int, dict[str, np.ndarray]]:
        out = {}
        for session, old in self.params["emissions"].items():
            s = sums.get(session)
            if s is None:
                out[session] = old
            elif self.likelihood is not None:
                out[session] = {"coefficients": newer[session][0], "bias": newer[session][1]}
            else:
                w, b, c = fits.regression(s["en"], s["es"], s["eq"], old["coefficients"].shape[-1], diagonal=self.diagonal)
                out[session] = {"coefficients": w, "bias": b, "covariance": c} if s["en"] > 0 else old
        return out

    def _maximise(self, sums: learning.Sums, newer: dict) -> LDS:
        p = self.params
        add = {k: sum(s[k] for s in sums.values()) for k in ("xn", "xs", "xq", "tn", "ts", "tq", "all_n", "all_s", "all_q")}
        mean, cov = fits.moments(add["xn"][0], add["xs"][0], add["xq"][0])
        _, spread = fits.moments(add["all_n"], add["all_s"], add["all_q"])
        d = len(mean)
        changes = {"initial_mean": mean, "initial_covariance": fits.floored(cov, fits.FIT_FLOOR, spread)}
        if add["tn"][0] > 0:
            inputs = add["ts"].shape[-1] - 2 * d
            w, b, q = fits.regression(add["tn"][0], add["ts"][0], add["tq"][0], d + inputs, diagonal=self.diagonal)
            changes |= {"dynamics_coefficients": w[:, :d], "dynamics_bias": b, "dynamics_covariance": q}
            if "dynamics_input_coefficients" in p:
                changes["dynamics_input_coefficients"] = w[:, d:]
        return self.replace(**changes, emissions=self._emissions(sums, newer))

    def regressors(self, batch: Batch) -> dict[str, np.ndarray]:
        post = self._infer(batch)[0]
        post = getattr(post, "latents", post)
        on = batch.weight > 0
        return {"w": np.ones((int(on.sum()), 1)), "x": post.mean[on], "y": batch.y[on], "spread": post.cov[on]}

    def _posterior(self, batch: Batch, post: chains.GaussianPosterior) -> pd.DataFrame:
        # A block's last step is the next block's first one, and comes with its cross covariance there.
        lengths = batch.lengths if batch.ahead is None else batch.lengths - ~np.isnan(batch.ahead).all(1)
        out = learning.step_rows(batch, {"mean": post.mean, "cov": post.cov}, lengths=lengths)
        b, t = np.nonzero(chains.valid(lengths, batch.steps))
        out["cross_next"] = learning.held(learning.nested(post.cross[b, np.minimum(t, post.cross.shape[1] - 1)], t + 1 < batch.lengths[b])) if post.cross.shape[1] else [None] * len(b)
        return out

    def elbo(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, elbo, entropy): expected joint log density plus entropy; the log-likelihood for Gaussian observations."""

        def make(b: Batch) -> pd.DataFrame:
            post, objective = self._infer(b)
            if self.likelihood is not None:
                prior = self._prior(b)
                inner = prior.value(post.mean) - 0.5 * np.einsum("btij,btji->b", np.where(chains.valid(b.lengths, b.steps)[..., None, None], prior.diag, 0.0), post.cov) - np.einsum("btij,btji->b", prior.lower, post.cross)
                objective = inner + _expected(b, post, self.params["emissions"][b.session], self.likelihood) + post.entropy()
            return pd.DataFrame({"session": np.int32(b.session), "seq": b.seq, "elbo": objective, "entropy": post.entropy()})

        return learning.rows(learning.packed(sequences), "session int, seq long, elbo double, entropy double", make)

    def prior_mean(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, t, mean): the latents' mean before any observation counts, driven by the inputs."""
        p = self.params
        if "initial_mean" not in p:
            raise TypeError("a switching system has no closed prior mean")

        def make(b: Batch) -> pd.DataFrame:
            drive, mean = self._drive(b), np.zeros((len(b.seq), b.steps, len(p["initial_mean"])))
            mean[:, 0] = p["initial_mean"]
            for t in range(1, b.steps):
                mean[:, t] = mean[:, t - 1] @ p["dynamics_coefficients"].T + drive[:, t - 1]
            return learning.step_rows(b, {"mean": mean})

        return learning.rows(learning.packed(sequences), "session int, seq long, t int, mean array<double>", make)

    def observation_mean(self, sequences: DataFrame) -> DataFrame:
        """(session, seq, t, mean) of each step's observation under the posterior."""

        def make(b: Batch) -> pd.DataFrame:
            post = self._infer(b)[0]
            post = getattr(post, "latents", post)
            e = self.params["emissions"][b.session]
            eta = post.mean @ e["coefficients"].T + e["bias"]
            if self.likelihood is not None:
                eta = self.likelihood.expected_mean(eta, np.einsum("oi,btij,oj->bto", e["coefficients"], post.cov, e["coefficients"]))
            return learning.step_rows(b, {"mean": eta})

        return learning.rows(learning.packed(sequences), "session int, seq long, t int, mean array<double>", make)

    def align(self, f: Affine) -> LDS:
        """The same model in latent coordinates f(x)."""
        p, w, back = self.params, f.coefficients, f.inverse()
        a = w @ p["dynamics_coefficients"] @ back.coefficients
        changes = {
            "initial_mean": f.apply(p["initial_mean"]), "initial_covariance": w @ p["initial_covariance"] @ w.T, "dynamics_coefficients": a,
            "dynamics_bias": w @ p["dynamics_bias"] + f.bias - a @ f.bias, "dynamics_covariance": w @ p["dynamics_covariance"] @ w.T, "emissions": _composed(p["emissions"], back),
        }
        if "dynamics_input_coefficients" in p:
            changes["dynamics_input_coefficients"] = w @ p["dynamics_input_coefficients"]
        return type(self)(p | changes, self.observations)

    def whiten(self) -> LDS:
        """Coordinates in which the dynamics noise is the identity."""
        w = np.linalg.inv(np.linalg.cholesky(self.params["dynamics_covariance"]))
        return self.align(Affine(w, np.zeros(len(w))))

    @classmethod
    def initialize(cls, sequences: DataFrame, latent_dim: int, observations: str | kinds.Likelihood = GAUSSIAN, diagonal: bool = False) -> LDS:
        """Principal components of each session's visible observations (as their likelihood links them); damped identity dynamics."""
        emissions = {}
        likelihood = kinds.likelihood_kind(observations)
        rows = sequences.where("visible")
        sums = moments.vector_sums(rows if likelihood is None else rows.withColumn("y", F.transform("y", likelihood.link)), "y", "session")
        for session in _sessions(sequences):
            if session not in sums:
                raise ValueError(f"nothing visible to start from in session {session}")
            n, first, second = sums[session]
            mean, cov = fits.moments(np.asarray(n), first, second)
            size = len(mean)
            directions, variances = cluster.leading(cov, min(latent_dim, size))
            scale = np.sqrt(np.maximum(variances, 1e-6))
            w = np.zeros((size, latent_dim))
            w[:, : len(scale)] = directions * scale
            e = {"coefficients": w, "bias": mean}
            if likelihood is None:
                rest = max(1e-2 * float(variances.sum()), 1e-6)
                e["covariance"] = rest * np.eye(size)
            emissions[session] = e
        d = latent_dim
        shared = {"initial_mean": np.zeros(d), "initial_covariance": np.eye(d), "dynamics_coefficients": 0.9 * np.eye(d), "dynamics_bias": np.zeros(d), "dynamics_covariance": 0.2 * np.eye(d)}
        return cls(shared | {"emissions": emissions}, observations, diagonal)

    def _sample(self, rng, session, steps, u, history):
        p = self.params
        x = np.zeros((steps, len(p["initial_mean"])))
        drive = u @ p["dynamics_input_coefficients"].T if "dynamics_input_coefficients" in p and u.shape[1] else np.zeros_like(x)
        normal = rng.standard_normal(x.shape)
        moves = p["dynamics_bias"] + drive + normal @ factor(p["dynamics_covariance"]).T
        moves[:1] = p["initial_mean"] + normal[:1] @ factor(p["initial_covariance"]).T
        for t in range(steps):
            x[t] = moves[t] if t == 0 else p["dynamics_coefficients"] @ x[t - 1] + moves[t]
        return np.zeros(steps, np.int32), x, self._noisy(rng, session, x)


def _composed(emissions: Emissions, back: Affine) -> Emissions:
    return emissions.map(lambda e: e | {"coefficients": e["coefficients"] @ back.coefficients, "bias": e["bias"] + e["coefficients"] @ back.bias})


def _latent_statistics(batch: Batch, post: chains.GaussianPosterior, weight: np.ndarray, inputs: bool) -> dict[str, np.ndarray]:
    """Initial sums (xn, xs, xq) and joint sums of ([x_t-1, u_t], x_t) (tn, ts, tq) for each of the K columns of ``weight``."""
    first = weight[:, 0] * ((batch.lengths > 0) & (True if batch.block is None else batch.block == 0))[:, None]
    second = post.second()
    w = weight[:, 1:] * chains.valid(batch.lengths, batch.steps)[:, 1:, None]
    u = batch.u[:, 1:, : None if inputs else 0]
    v = np.concatenate([post.mean[:, :-1], u, post.mean[:, 1:]], -1)
    d, n = post.mean.shape[-1], u.shape[-1]
    q = v[..., :, None] * v[..., None, :]
    q[..., :d, :d] += post.cov[:, :-1]
    q[..., d + n :, d + n :] += post.cov[:, 1:]
    q[..., :d, d + n :] += post.cross
    q[..., d + n :, :d] += chains.transpose(post.cross)
    return {
        "xn": first.sum(0), "xs": np.einsum("bk,bd->kd", first, post.mean[:, 0]), "xq": np.einsum("bk,bde->kde", first, second[:, 0]),
        "tn": w.sum((0, 1)), "ts": np.einsum("btk,btd->kd", w, v), "tq": np.einsum("btk,btde->kde", w, q),
    }


def _emission_statistics(batch: Batch, post: chains.GaussianPosterior, on: np.ndarray) -> dict[str, np.ndarray]:
    """Joint sums of (x, y) of visible steps that are ``on``."""
    w = batch.weight * on
    v = np.concatenate([post.mean, np.where(w[..., None] > 0, batch.y, 0.0)], -1)
    d = post.mean.shape[-1]
    q = np.einsum("bt,bti,btj->ij", w, v, v)
    q[:d, :d] += np.einsum("bt,btij->ij", w, post.cov)
    return {"en": w.sum(), "es": np.einsum("bt,bti->i", w, v), "eq": q}


def _expected(b: Batch, post: chains.GaussianPosterior, e: dict, likelihood: kinds.Likelihood) -> np.ndarray:
    y = np.where(b.weight[..., None] > 0, b.y, 0.0)
    value = likelihood.expected(y, post.mean @ e["coefficients"].T + e["bias"], np.einsum("oi,btij,oj->bto", e["coefficients"], post.cov, e["coefficients"]))[0]
    return (np.where(b.weight[..., None] > 0, value, 0.0)).sum((1, 2))


def _expected_gaussian(b: Batch, post: chains.GaussianPosterior, e: dict) -> np.ndarray:
    p = np.linalg.inv(e["covariance"])
    gap = np.where(b.weight[..., None] > 0, b.y - post.mean @ e["coefficients"].T - e["bias"], 0.0)
    inner = e["coefficients"].T @ p @ e["coefficients"]
    each = np.einsum("bti,ij,btj->bt", gap, p, gap) + np.einsum("ij,btji->bt", inner, post.cov) + np.linalg.slogdet(e["covariance"])[1] + len(p) * chains.LOG_2PI
    return (-0.5 * b.weight * each).sum(1)


class SLDS(LDS):
    """Switching LDS. Params: initial_probs, transition_probs, latent_initial_means (K, D), latent_initial_covariances,
    dynamics_coefficients (K, D, D), dynamics_bias (K, D), dynamics_covariances, optionally dynamics_input_coefficients;
    emissions as LDS. State t selects the dynamics into x_t; state 0 selects the initial Gaussian only.
    """

    family = "slds"
    posterior_schema = "gamma array<double>, state int, mean array<double>, cov array<array<double>>"
    inference_iters = 5
    #: Whether mean field starts with all states alike at every step, or with the initial probabilities.
    even_start = False

    def _overlap(self) -> int:
        return Model._overlap(self)

    def _infer(self, batch: Batch):
        p = self.params
        e = p["emissions"][batch.session]
        bias = np.broadcast_to(p["dynamics_bias"], (len(batch.seq), max(batch.steps - 1, 0), *p["dynamics_bias"].shape))
        if "dynamics_input_coefficients" in p:
            bias = bias + np.einsum("kdi,bti->btkd", p["dynamics_input_coefficients"], batch.u[:, 1:])
        y = np.where(batch.weight[..., None] > 0, batch.y, 0.0)

        def emit(prior: chains.GaussianFactors, before: chains.GaussianPosterior | None) -> tuple[chains.GaussianPosterior, Callable]:
            if self.likelihood is not None:
                post, _ = chains.laplace_chain(prior, y, batch.weight, e["coefficients"], e["bias"], self.likelihood, None if before is None else before.mean)
                return post, lambda x: _expected(batch, x, e, self.likelihood)
            return chains.gaussian_chain(chains.add_gaussian_emissions(prior, batch.y, batch.weight, e["coefficients"], e["bias"], e["covariance"])), lambda x: _expected_gaussian(batch, x, e)

        k = len(p["initial_probs"])
        start = np.full((len(batch.seq), batch.steps, k), 1 / k) if self.even_start else None
        post = chains.switching_chain(p["initial_probs"], p["transition_probs"], p["latent_initial_means"], p["latent_initial_covariances"], p["dynamics_coefficients"], bias, p["dynamics_covariances"], batch.lengths, batch.steps, emit, self.inference_iters, start)
        return post, post.bound

    def _statistics(self, batch: Batch, post: chains.SwitchingPosterior) -> dict[str, np.ndarray]:
        on = chains.valid(batch.lengths, batch.steps)
        out = {"first": post.states.gamma[:, 0].sum(0), "pairs": post.states.xi.sum((0, 1))} | _latent_statistics(batch, post.latents, post.states.gamma, "dynamics_input_coefficients" in self.params)
        out |= {"all_n": on.sum(), "all_s": (post.latents.mean * on[..., None]).sum((0, 1)), "all_q": (post.latents.second() * on[..., None, None]).sum((0, 1))}
        if self.likelihood is None:
            out |= _emission_statistics(batch, post.latents, on)
        return out

    def _maximise(self, sums: learning.Sums, newer: dict) -> SLDS:
        p = self.params
        add = {k: sum(s[k] for s in sums.values()) for k in ("first", "pairs", "xn", "xs", "xq", "tn", "ts", "tq", "all_n", "all_s", "all_q")}
        mean, cov = fits.moments(add["xn"], add["xs"], add["xq"])
        _, spread = fits.moments(add["all_n"], add["all_s"], add["all_q"])
        cov = fits.floored(cov, fits.FIT_FLOOR, np.broadcast_to(spread, cov.shape))
        d = mean.shape[-1]
        w, b, q = fits.regression(add["tn"], add["ts"], add["tq"], add["ts"].shape[-1] - d, diagonal=self.diagonal)
        weak0, weak = add["xn"] < fits.MIN_OCCUPANCY, add["tn"] < fits.MIN_OCCUPANCY
        changes = {
            "initial_probs": fits.categorical(add["first"], p["initial_probs"], np.finfo(float).tiny), "transition_probs": fits.categorical(add["pairs"], p["transition_probs"], fits.MIN_OCCUPANCY),
            "latent_initial_means": np.where(weak0[:, None], p["latent_initial_means"], mean), "latent_initial_covariances": np.where(weak0[:, None, None], p["latent_initial_covariances"], cov),
            "dynamics_coefficients": np.where(weak[:, None, None], p["dynamics_coefficients"], w[..., :d]), "dynamics_bias": np.where(weak[:, None], p["dynamics_bias"], b),
            "dynamics_covariances": np.where(weak[:, None, None], p["dynamics_covariances"], q),
        }
        if "dynamics_input_coefficients" in p:
            changes["dynamics_input_coefficients"] = np.where(weak[:, None, None], p["dynamics_input_coefficients"], w[..., d:])
        return self.replace(**changes, emissions=self._emissions(sums, newer))

    def _posterior(self, batch: Batch, post: chains.SwitchingPosterior) -> pd.DataFrame:
        g = post.states.gamma
        return learning.step_rows(batch, {"gamma": g, "state": g.argmax(-1).astype(np.int32), "mean": post.latents.mean, "cov": post.latents.cov})

    def decode(self, sequences: DataFrame) -> DataFrame:
        return self.infer(sequences).select("session", "seq", "t", "state")

    def elbo(self, sequences: DataFrame) -> DataFrame:
        return self.objective(sequences).withColumnRenamed("objective", "elbo")

    def permute_states(self, order: np.ndarray) -> SLDS:
        order = np.asarray(order)
        own = ("initial_probs", "latent_initial_means", "latent_initial_covariances", "dynamics_coefficients", "dynamics_bias", "dynamics_covariances", "dynamics_input_coefficients")
        return self.replace(transition_probs=self.params["transition_probs"][np.ix_(order, order)], **{k: self.params[k][order] for k in own if k in self.params})

    def align(self, f: Affine) -> SLDS:
        p, w, back = self.params, f.coefficients, f.inverse()
        a = w @ p["dynamics_coefficients"] @ back.coefficients
        changes = {
            "latent_initial_means": p["latent_initial_means"] @ w.T + f.bias, "latent_initial_covariances": w @ p["latent_initial_covariances"] @ w.T, "dynamics_coefficients": a,
            "dynamics_bias": p["dynamics_bias"] @ w.T + f.bias - a @ f.bias, "dynamics_covariances": w @ p["dynamics_covariances"] @ w.T, "emissions": _composed(p["emissions"], back),
        }
        if "dynamics_input_coefficients" in p:
            changes["dynamics_input_coefficients"] = w @ p["dynamics_input_coefficients"]
        return type(self)(p | changes, self.observations)

    @classmethod
    def initialize(cls, sequences: DataFrame, num_states: int, latent_dim: int, observations: str = GAUSSIAN, diagonal: bool = False) -> SLDS:
        """Emissions of an LDS start; states differ by the damping of their dynamics."""
        base = LDS.initialize(sequences, latent_dim, observations).params
        k, d = num_states, latent_dim
        damping = np.linspace(0.95, 0.5, k)
        return cls({
            "initial_probs": np.full(k, 1 / k), "transition_probs": sticky(k), "latent_initial_means": np.zeros((k, d)), "latent_initial_covariances": np.tile(np.eye(d), (k, 1, 1)),
            "dynamics_coefficients": damping[:, None, None] * np.eye(d), "dynamics_bias": np.zeros((k, d)), "dynamics_covariances": np.array([(1 - x * x + 0.05) * np.eye(d) for x in damping]), "emissions": base["emissions"],
        }, observations, diagonal)

    def _sample(self, rng, session, steps, u, history):
        p = self.params
        z = draw_states(rng, p["initial_probs"], p["transition_probs"], steps)
        x = np.zeros((steps, p["latent_initial_means"].shape[-1]))
        drive = np.einsum("tdi,ti->td", p["dynamics_input_coefficients"][z], u) if "dynamics_input_coefficients" in p and u.shape[1] else np.zeros_like(x)
        normal = rng.standard_normal(x.shape)[..., None]
        moves = p["dynamics_bias"][z] + drive + (factor(p["dynamics_covariances"])[z] @ normal)[..., 0]
        moves[:1] = p["latent_initial_means"][z[:1]] + (factor(p["latent_initial_covariances"])[z[:1]] @ normal[:1])[..., 0]
        for t in range(steps):
            x[t] = moves[t] if t == 0 else p["dynamics_coefficients"][z[t]] @ x[t - 1] + moves[t]
        return z, x, self._noisy(rng, session, x)


def _families() -> dict[str, type[Model]]:
    from driftline.plans.walks import GatedWalk

    return {c.family: c for c in (HMM, ARHMM, LDS, SLDS, GatedWalk)}
