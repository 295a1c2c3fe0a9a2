"""Training of allocation policies, one task a run of algorithm and seed.

A trainer is any function (observations, returns, seed, steps) -> actions: arrays of months x values, months x tickers and months x
tickers. Trainers from outside are registered by name; the one here needs numpy only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Trainer = Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]


def reward(weights: np.ndarray, returns: np.ndarray) -> float:
    """Twice the return less 0.7 times the volatility less half the largest fall of the months' portfolio."""
    r = (weights * returns).sum(axis=1)
    grown = np.cumprod(1 + r)
    fall = np.max(1 - grown / np.maximum.accumulate(np.maximum(grown, 1e-12))) if len(grown) else 0.0
    return float(2 * (grown[-1] - 1) - 0.7 * r.std() - 0.5 * fall) if len(r) else 0.0


def evolve(observations: np.ndarray, returns: np.ndarray, seed: int, steps: int, spread: float = 0.1, rate: float = 0.05) -> np.ndarray:
    """A linear softmax policy by mirrored random search on the reward of the month after each observation."""
    chance = np.random.default_rng(seed)
    scale = np.abs(observations).max(axis=0)
    x = np.c_[observations / np.where(scale > 0, scale, 1.0), np.ones(len(observations))]
    theta = np.zeros((x.shape[1], returns.shape[1]))

    def act(t: np.ndarray) -> np.ndarray:
        a = x @ t
        e = np.exp(a - a.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    later = returns[1:]
    for _ in range(steps if len(later) else 0):
        d = chance.standard_normal(theta.shape)
        gain = reward(act(theta + spread * d)[:-1], later) - reward(act(theta - spread * d)[:-1], later)
        theta += rate * np.sign(gain) * d * min(abs(gain) / spread, 1.0)
    return act(theta)


TRAINERS: dict[str, Trainer] = {"evolve": evolve}


def train(observations: DataFrame, returns: DataFrame, tickers: list[str], runs: list[tuple[str, int]], steps: int, trainers: dict[str, Trainer] | None = None) -> DataFrame:
    """(model, seed, month, ticker, action): the ledger of every run's trained policy.

    observations has (month, values), returns (month, ticker, ret); runs are (trainer's name, seed). Months without a vector are
    left out, a return that isn't there is 0. Each run reads the months' vectors in one task: they are as many as the months.
    """
    known = TRAINERS | (trainers or {})
    wide = returns.groupBy("month").pivot("ticker", tickers).agg(F.first("ret"))
    rets = wide.select("month", F.array(*[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in tickers]).alias("rets"))
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed")) for m, s in runs]))
    rows = observations.where("values is not null").join(rets, "month").select("month", "values", "rets", named.alias("run")).select("month", "values", "rets", "run.*")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        model, seed = pdf["model"].iloc[0], int(pdf["seed"].iloc[0])
        actions = known[model](np.stack(pdf["values"]).astype(float), np.stack(pdf["rets"]).astype(float), seed, steps)
        n = len(tickers)
        return pd.DataFrame({"model": model, "seed": seed, "month": np.repeat(pdf["month"].to_numpy(), n), "ticker": tickers * len(pdf), "action": np.asarray(actions, float).ravel()})

    return rows.groupBy("model", "seed").applyInPandas(one, "model string, seed int, month string, ticker string, action double")
