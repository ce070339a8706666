"""Coordinate ascent over states of any kind, by proposals."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import TypeVar

import numpy as np

S = TypeVar("S")
V = TypeVar("V")


def coordinate_ascent(state: S, coordinates: int, objective: Callable[[S], float], read: Callable[[S, int], V], write: Callable[[S, int, V], S], propose: Callable[[np.random.Generator, Callable[[V], float], V], V], active: Sequence[bool] | None = None, max_sweeps: int = 50, seed: int = 0) -> tuple[S, float]:
    """(state, objective) after sweeps over the active coordinates, until one brings nothing.

    ``propose`` gets a random stream, the objective of a value at the coordinate with all others as they are, and the value so
    far; its answer is taken only where the objective is a number and rises.
    """
    rng, best = np.random.default_rng(seed), float(objective(state))
    chosen = [i for i in range(coordinates) if active is None or active[i]]
    for _ in range(max_sweeps):
        rose = False
        for i in chosen:
            here = state
            value = propose(rng, lambda v, i=i, here=here: float(objective(write(here, i, v))), read(state, i))
            trial = write(state, i, value)
            found = float(objective(trial))
            if np.isfinite(found) and found > best:
                state, best, rose = trial, found, True
        if not rose:
            break
    return state, best


def best_ascent(starts: Iterable[S], *args, seed: int = 0, **more) -> tuple[S, float]:
    """The best of the ascents from several starts, each with a random stream of its own; the first of equal ones."""
    found = [coordinate_ascent(s, *args, seed=seed + k, **more) for k, s in enumerate(starts)]
    if not found:
        raise ValueError("no start")
    return max(found, key=lambda x: x[1] if np.isfinite(x[1]) else -np.inf)
