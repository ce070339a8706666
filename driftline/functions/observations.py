"""What a model family needs to know of its observations, as objects: built-in kinds, and the contract for kinds of one's own.

State observations (HMM) score rows given a state, add up sufficient sums, and turn sums into parameters. Likelihoods (LDS,
SLDS) score each coordinate given its linear predictor eta = C x + d, with slope and curvature, which is all that Laplace
inference and the regression of C and d use.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions import fits
from driftline.functions.dists import Gaussian, Poisson, log_factorial

GAUSSIAN, POISSON = "gaussian", "poisson"
#: Nodes of the quadrature over a scalar normal.
NODES = 20


class StateObservations:
    """Parameters ``e`` of a session are a dictionary of arrays whose first axis is the state."""

    name = ""

    def log_prob(self, e: dict, y: np.ndarray) -> np.ndarray:
        """(..., K) log density of y (..., D) in each state; hidden steps are zeros and don't count."""
        raise NotImplementedError

    def sums(self, w: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Sufficient sums under weights (B, T, K), by name; ``n``, the total weight of each state, is added to them."""
        raise NotImplementedError

    def maximise(self, sums: dict[str, np.ndarray], old: dict, diagonal: bool) -> dict:
        """Parameters from sums; states with too little weight keep ``old``."""
        raise NotImplementedError

    def means(self, e: dict) -> np.ndarray:
        """(K, D) mean observation of each state."""
        raise NotImplementedError

    def sample(self, rng: np.random.Generator, e: dict, z: np.ndarray) -> np.ndarray:
        """(T, D) observations of the states z (T,)."""
        raise NotImplementedError

    def features(self, y: Column) -> Column:
        """The array column that K-means starts see."""
        return y

    def start(self, n: np.ndarray, first: np.ndarray, second: np.ndarray, diagonal: bool) -> dict:
        """Parameters from the sums of features and of their products in each cluster."""
        raise NotImplementedError


class GaussianStates(StateObservations):
    name = GAUSSIAN

    def log_prob(self, e, y):
        return Gaussian(e["mean"], e["covariance"]).log_prob(y)

    def sums(self, w, y):
        return {"s": np.einsum("btk,btd->kd", w, y), "q": np.einsum("btk,btd,bte->kde", w, y, y)}

    def maximise(self, sums, old, diagonal):
        mean, cov = fits.gaussian(sums["n"], sums["s"], sums["q"], (old["mean"], old["covariance"]), diagonal=diagonal)
        return {"mean": mean, "covariance": cov}

    def means(self, e):
        return e["mean"]

    def sample(self, rng, e, z):
        return Gaussian(e["mean"][z], e["covariance"][z]).sample(rng)

    def start(self, n, first, second, diagonal):
        mean, cov = fits.gaussian(n, first, second, floor=fits.INIT_FLOOR, diagonal=diagonal)
        return {"mean": mean, "covariance": cov}


class PoissonStates(StateObservations):
    name = POISSON

    def log_prob(self, e, y):
        return Poisson(e["log_rates"]).log_prob(y)

    def sums(self, w, y):
        return {"s": np.einsum("btk,btd->kd", w, y)}

    def maximise(self, sums, old, diagonal):
        return {"log_rates": fits.poisson(sums["n"], sums["s"], old["log_rates"])}

    def means(self, e):
        return np.exp(e["log_rates"])

    def sample(self, rng, e, z):
        return rng.poisson(np.exp(e["log_rates"][z])).astype(float)

    def start(self, n, first, second, diagonal):
        return {"log_rates": fits.poisson(n, first)}


class CategoricalStates(StateObservations):
    """Symbols 0 to ``symbols`` - 1 in the first coordinate; parameters probs (K, symbols). Other symbols have probability 0."""

    def __init__(self, symbols: int):
        self.symbols, self.name = symbols, f"categorical{symbols}"

    def _one_hot(self, y: np.ndarray) -> np.ndarray:
        return (y[..., :1] == np.arange(self.symbols)).astype(float)

    def log_prob(self, e, y):
        with np.errstate(divide="ignore"):
            logs = np.log(e["probs"])
        code = y[..., 0].astype(int)
        known = (code == y[..., 0]) & (code >= 0) & (code < self.symbols)
        return np.where(known[..., None], logs.T[np.where(known, code, 0)], -np.inf)

    def sums(self, w, y):
        return {"s": np.einsum("btk,btc->kc", w, self._one_hot(y))}

    def maximise(self, sums, old, diagonal):
        return {"probs": fits.categorical(sums["s"], old["probs"], fits.MIN_OCCUPANCY)}

    def means(self, e):
        return e["probs"] @ np.arange(self.symbols)[:, None]

    def sample(self, rng, e, z):
        return (rng.random(len(z))[:, None] > np.cumsum(e["probs"], -1)[z][:, :-1]).sum(-1)[:, None].astype(float)

    def features(self, y):
        return F.array(*[(y[0] == c).cast("double") for c in range(self.symbols)])

    def start(self, n, first, second, diagonal):
        return {"probs": fits.categorical(first + 1)}


class Likelihood:
    """Observations given eta, coordinate by coordinate; ``curve`` is minus the second derivative and never negative."""

    name = ""

    def terms(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probability, slope, curve) at eta."""
        raise NotImplementedError

    def mean(self, eta: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def sample(self, rng: np.random.Generator, eta: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def link(self, y: Column) -> Column:
        """One coordinate as principal components see it."""
        return y

    def spread(self, mean: np.ndarray, variance: np.ndarray, f):
        """Means of the arrays that ``f(eta)`` returns over eta ~ N(mean, variance), by quadrature."""
        nodes, weights = np.polynomial.hermite_e.hermegauss(NODES)
        out = None
        for x, w in zip(nodes, weights / weights.sum(), strict=True):
            part = f(mean + np.sqrt(np.maximum(variance, 0.0)) * x)
            out = [w * p for p in part] if out is None else [o + w * p for o, p in zip(out, part, strict=True)]
        return tuple(out)

    def expected(self, y: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means of :meth:`terms` over eta ~ N(mean, variance)."""
        return self.spread(mean, variance, lambda eta: self.terms(y, eta))

    def expected_mean(self, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
        return self.spread(mean, variance, lambda eta: (self.mean(eta),))[0]

    def statistics(self, coefficients: np.ndarray, bias: np.ndarray, y: np.ndarray, x: np.ndarray, w: np.ndarray, spread: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objective, gradient (O, P+1) and curvature (O, P+1, P+1) of regressions on inputs N(x, spread); y (N, O), x (N, P), w (N,)."""
        p, eta = x.shape[-1], x @ coefficients.T + bias
        if spread is None:
            value, slope, curve = self.terms(y, eta)
            moved = np.zeros((*eta.shape, p))
        else:
            moved = np.einsum("nij,oj->noi", spread, coefficients)
            value, slope, curve = self.expected(y, eta, np.einsum("oi,noi->no", coefficients, moved))
        value, slope, curve = (w[:, None] * v for v in (value, slope, curve))
        one = np.concatenate([x, np.ones((len(x), 1))], 1)
        gradient = slope.T @ one
        gradient[:, :p] -= np.einsum("no,noi->oi", curve, moved)
        hessian = -np.einsum("no,np,nq->opq", curve, one, one)
        if spread is not None:
            hessian[:, :p, :p] -= np.einsum("no,nij->oij", curve, spread)
        return value.sum(0), gradient, hessian


class PoissonLikelihood(Likelihood):
    """Counts with rate exp(eta); means over normal eta are closed."""

    name = POISSON

    def terms(self, y, eta):
        with np.errstate(over="ignore"):
            rate = np.exp(eta)
        return y * eta - rate - log_factorial(y), y - rate, rate

    def mean(self, eta):
        return np.exp(eta)

    def sample(self, rng, eta):
        return rng.poisson(np.exp(eta)).astype(float)

    def link(self, y):
        return F.log1p(y)

    def expected(self, y, mean, variance):
        rate = np.exp(mean + variance / 2)
        return y * mean - rate - log_factorial(y), y - rate, rate

    def expected_mean(self, mean, variance):
        return np.exp(mean + variance / 2)

    def statistics(self, coefficients, bias, y, x, w, spread):
        return fits.poisson_statistics(coefficients, bias, y, x, w, spread)


class BernoulliLikelihood(Likelihood):
    """0 or 1 with log odds eta."""

    name = "bernoulli"

    def terms(self, y, eta):
        p = self.mean(eta)
        return y * eta - np.logaddexp(0, eta), y - p, p * (1 - p)

    def mean(self, eta):
        return np.exp(-np.logaddexp(0, -eta))

    def sample(self, rng, eta):
        return (rng.random(eta.shape) < self.mean(eta)).astype(float)


class NegativeBinomialLikelihood(Likelihood):
    """Counts with mean exp(eta) and variance mean + mean^2 / ``shape``."""

    def __init__(self, shape: float):
        self.shape, self.name = float(shape), f"negbin{shape:g}"

    def terms(self, y, eta):
        r = self.shape
        log_p, log_rest = -np.logaddexp(0, np.log(r) - eta), -np.logaddexp(0, eta - np.log(r))  # shares of the mean and of r in their sum
        p = np.exp(log_p)
        return y * log_p + r * log_rest + _log_gamma(y + r) - _log_gamma(np.array(r)) - log_factorial(y), y - (y + r) * p, (y + r) * p * (1 - p)

    def mean(self, eta):
        return np.exp(eta)

    def sample(self, rng, eta):
        return rng.poisson(rng.gamma(self.shape, np.exp(eta) / self.shape)).astype(float)

    def link(self, y):
        return F.log1p(y)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series eight steps on."""
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - sum(np.log(x + i) for i in range(8))


#: Kinds by name: models that are read back look theirs up here.
KINDS: dict[str, StateObservations | Likelihood] = {"bernoulli": BernoulliLikelihood()}


def register(kind: StateObservations | Likelihood) -> StateObservations | Likelihood:
    """Makes a kind known under its name, for models that are read back; a name has no hyphen."""
    if not kind.name or "-" in kind.name or kind.name in (GAUSSIAN, POISSON):
        raise ValueError(f"no name for a kind: {kind.name!r}")
    KINDS[kind.name] = kind
    return kind


def state_kind(kind: str | StateObservations) -> StateObservations:
    found = {GAUSSIAN: GaussianStates(), POISSON: PoissonStates()}.get(kind) if isinstance(kind, str) else kind
    found = KINDS.get(kind) if found is None else found
    if not isinstance(found, StateObservations):
        raise ValueError(f"no state observations: {kind!r}")
    return found


def likelihood_kind(kind: str | Likelihood) -> Likelihood | None:
    """None for Gaussian observations, which are exact."""
    if kind == GAUSSIAN:
        return None
    found = PoissonLikelihood() if kind == POISSON else KINDS.get(kind) if isinstance(kind, str) else kind
    if not isinstance(found, Likelihood):
        raise ValueError(f"no likelihood: {kind!r}")
    return found
