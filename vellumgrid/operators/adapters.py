"""Models behind vectorised functions, with retries.

A model is a plain function from lists to lists; it runs in Arrow batches on the
executors. Failures are retried with growing, jittered pauses, then the row gets
the fallback, so one bad call fails no job.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F


def pauses(attempts: int, first: float = 1.0, factor: float = 2.0, most: float = 30.0, rng: random.Random | None = None) -> list[float]:
    """Seconds before each retry: exponential, bounded, times 0.5 to 1.5."""
    rng = rng or random.Random()
    return [min(first * factor**k, most) * rng.uniform(0.5, 1.5) for k in range(attempts - 1)]


def retried(call: Callable, attempts: int = 3, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    def run(*args):
        for pause in [*pauses(attempts, first), None]:
            try:
                return call(*args)
            except Exception:
                if pause is None:
                    raise
                sleep(pause)

    return run


def isolated(model: Callable[..., list], fallback=None, attempts: int = 3, first: float = 1.0) -> Callable[..., list]:
    """A list model whose failing rows get the fallback, and no others: a batch that
    fails is tried again whole, with pauses, then in halves down to single rows."""

    def halves(*columns: list) -> list:
        try:
            return list(model(*columns))
        except Exception:
            n = len(columns[0])
            if n <= 1:
                return [fallback] * n
            return halves(*[c[: n // 2] for c in columns]) + halves(*[c[n // 2 :] for c in columns])

    def run(*columns: list) -> list:
        try:
            return list(retried(model, attempts, first)(*columns))
        except Exception:  # the failing rows are told from the rest
            return halves(*columns)

    return run


def batched(model: Callable[[list], list], size: int) -> Callable[[list], list]:
    """A list model that is called on ``size`` rows at a time, in order; a failing
    batch fails the whole."""
    return lambda rows: [x for at in range(0, len(rows), size) for x in model(rows[at : at + size])]


def adaptive_size(elapsed: float, target: float, least: int, most: int) -> int:
    """The next batch's size after ``least`` rows took ``elapsed`` seconds."""
    return most if elapsed <= 0 else max(least, min(most, int(least * target / elapsed)))


def vectorised(model: Callable[..., list], kind: str, fallback=None, attempts: int = 3, first: float = 1.0):
    """A column function of a list model."""
    safe = isolated(model, fallback, attempts, first)

    def one(a: pd.Series) -> pd.Series:
        return pd.Series(safe(a.tolist()))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(safe(a.tolist(), b.tolist()))

    def column(*args):
        f = one if len(args) == 1 else two
        f.__annotations__ = {**{n: pd.Series for n in ("a", "b")[: len(args)]}, "return": pd.Series}
        return F.pandas_udf(f, kind)(*args)

    return column


def cached(model: Callable[[object], object], size: int = 10_000) -> Callable[[list], list]:
    """A list model that remembers its last ``size`` inputs in each worker."""
    known = lru_cache(size)(model)
    return lambda xs: [known(x) for x in xs]
