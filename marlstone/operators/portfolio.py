"""Portfolios, episodes and reports as set-wise queries over (…, month, ticker, weight) ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.panel import month, ratio
from marlstone.session import settle

RUN = ["model", "seed"]


def sum_weights(ledger: DataFrame, keys: list[str], n: int, action: str = "action") -> DataFrame:
    """Actions divided by their sum; equal weights where the sum isn't above zero."""
    total = F.sum(action).over(Window.partitionBy(*keys))
    return ledger.withColumn("weight", F.when(total > 0, F.col(action) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0 / n)))


def softmax_weights(ledger: DataFrame, keys: list[str], action: str = "action") -> DataFrame:
    """Exponentials of the actions divided by their sum."""
    by = Window.partitionBy(*keys)
    raised = ledger.withColumn("_e", F.exp(F.col(action) - F.max(action).over(by)))
    return raised.withColumn("weight", F.col("_e") / F.sum("_e").over(by)).drop("_e")


def equal_weight(px: DataFrame, initial: float) -> DataFrame:
    """(date, portfolio_value, log_evolution): the same amount in every ticker at its first known price, held; gaps count 0."""
    first = F.first("close", True).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = px.where(F.col("close").isNotNull()).agg(F.countDistinct("ticker").alias("n"))
    held = px.withColumn("first", first).join(F.broadcast(n), F.lit(True))
    value = held.groupBy("date").agg(F.coalesce(F.sum(F.col("close") * (F.lit(initial) / F.col("n")) / F.nullif(F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("portfolio_value"))
    return value.withColumn("log_evolution", F.when(F.col("portfolio_value") > 0, F.ln(F.col("portfolio_value") / initial)))


def episode_metrics(daily: DataFrame, keys: list[str], deviation: str, value: str = "value") -> DataFrame:
    """(keys, roi, volatility, mdd, reward) of each episode's daily values; deviation is 'pop' or 'samp'."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = daily.withColumn("step", ratio(F.col(value), F.lag(value).over(w)) - 1).withColumn("peak", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    std = F.stddev_pop if deviation == "pop" else F.stddev_samp
    first, last = F.min_by(value, "date"), F.max_by(value, "date")
    out = rows.groupBy(*keys).agg(
        F.when(first > 0, last / F.nullif(first, F.lit(0.0)) - 1).otherwise(0.0).alias("roi"), F.coalesce(std("step"), F.lit(0.0)).alias("volatility"), F.coalesce(F.max(ratio(F.col("peak") - F.col(value), F.col("peak"))), F.lit(0.0)).alias("mdd")
    )
    return out.withColumn("reward", 2 * F.col("roi") - 0.7 * F.col("volatility") - 0.5 * F.col("mdd"))


def month_windows(px: DataFrame) -> DataFrame:
    """Prices with the training step they belong to, as an equi-joinable key.

    A step's window runs from one calendar month end to the next, both included, so that a month-end day is in two windows:
    as the last day of its month's and as the first of the following month's.
    """
    own = month(F.col("date"))
    after = F.when(F.col("date") == F.last_day("date"), month(F.add_months(F.trunc("date", "month"), 1)))
    return px.withColumn("window_month", F.explode(F.filter(F.array(own, after), lambda m: m.isNotNull())))


def values_of(weights: DataFrame, px: DataFrame, keys: list[str], on: str, strict: int = 0) -> DataFrame:
    """(keys, date, value): Σ price · weight of each day; strict: null unless so many prices are there."""
    both = weights.join(px, [on, "ticker"])
    total = F.sum(F.col("close") * F.col("weight"))
    return both.groupBy(*keys, "date").agg((F.when(F.count("close") == strict, total) if strict else F.coalesce(total, F.lit(0.0))).alias("value"))


def train_episodes(weights: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """Training episodes: the observation month's weights over the closed window up to the next month's end, population deviation."""
    steps = weights.withColumn("window_month", month(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1)))
    return episode_metrics(values_of(steps, month_windows(panel), [*keys, "month"], "window_month"), [*keys, "month"], "pop")


def back_test(weights: DataFrame, panel: DataFrame, keys: list[str], lag: int, deviation: str) -> DataFrame:
    """Back-test months: weights of month t on the prices of month t + lag."""
    moved = weights.withColumn("price_month", month(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), lag))).drop("month")
    px = panel.withColumn("price_month", month(F.col("date")))
    return episode_metrics(values_of(moved, px, [*keys, "price_month"], "price_month"), [*keys, "price_month"], deviation).withColumnRenamed("price_month", "month")


def rebased_roi(weights: DataFrame, returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, month, roi): Σ weight · monthly return over the tickers that have one."""
    return weights.join(returns.select("month", "ticker", "ret"), ["month", "ticker"]).groupBy(*keys, "month").agg(F.sum(F.col("weight") * F.col("ret")).alias("roi"))


def cumulative(returns: DataFrame, keys: list[str], value: str = "roi", minus_one: bool = True) -> DataFrame:
    """(…, cumulative): running product of 1 + r; null from the first r of -1 or less on."""
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.when(F.min(1 + F.col(value)).over(w) > 0, F.exp(F.sum(F.when(F.col(value) > -1, F.ln(1 + F.col(value)))).over(w)))
    return returns.withColumn("cumulative", grown - 1 if minus_one else grown)


def scorecard(returns: DataFrame, keys: list[str], value: str = "roi") -> DataFrame:
    """One row a strategy: total, annualised, volatility, Sharpe, Sortino, Calmar, drawdown and win rate of monthly returns."""
    r = F.col(value)
    grown = cumulative(returns.select(*keys, "month", value), keys, value, False)
    peak = F.max("cumulative").over(Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    rows = grown.withColumn("fall", ratio(peak - F.col("cumulative"), peak))
    agg = rows.groupBy(*keys).agg(
        (F.product(1 + r) - 1).alias("total_return"), F.count("*").alias("n"), (F.stddev_pop(r) * F.sqrt(F.lit(12.0))).alias("volatility"), (F.stddev_pop(F.when(r < 0, r)) * F.sqrt(F.lit(12.0))).alias("down"), F.max("fall").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("win_rate")
    )
    agg = agg.withColumn("annualized_return", F.pow(1 + F.col("total_return"), 12.0 / F.col("n")) - 1)
    over = lambda c: F.when(F.col(c) > 0, F.col("annualized_return") / F.nullif(F.col(c), F.lit(0.0))).otherwise(0.0)
    return agg.select(*keys, "total_return", "annualized_return", "volatility", over("volatility").alias("sharpe_ratio"), over("down").alias("sortino_ratio"), over("max_drawdown").alias("calmar_ratio"), "max_drawdown", "win_rate")


def rolling_sharpe(returns: DataFrame, keys: list[str], window: int = 12, value: str = "roi") -> DataFrame:
    """(keys, month, rolling_sharpe) of the `window` months before each one, itself left out; no row before there are so many."""
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(-window, -1)
    rows = returns.withColumn("n", F.count(value).over(w)).withColumn("m", F.avg(value).over(w)).withColumn("s", F.stddev_pop(value).over(w))
    return rows.where(F.col("n") == window).select(*keys, "month", F.when(F.col("s") > 0, F.col("m") * 12 / F.nullif(F.col("s") * F.sqrt(F.lit(12.0)), F.lit(0.0))).otherwise(0.0).alias("rolling_sharpe"))


def merge_runs(ledger: DataFrame, columns: list[str]) -> DataFrame:
    """(month, one weight column a run and ticker) for the run labels `ticker_model_seed` given."""
    label = F.concat_ws("_", "ticker", "model", F.col("seed").cast("string"))
    return ledger.withColumn("label", label).groupBy("month").pivot("label", columns).agg(F.first("weight"))


def run_matrix(results: DataFrame, runs: list[str], value: str) -> DataFrame:
    """(month, one column a run); a month a run lacks is null."""
    return results.groupBy("month").pivot("run", runs).agg(F.first(value))


def ledger(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(…, weight, ret, contribution): every weight with its month's return and what it brought; null where there is none."""
    both = weights.join(returns.select("month", "ticker", "ret"), ["month", "ticker"], "left")
    return both.withColumn("contribution", F.col("weight") * F.col("ret"))


def observed(vectors: DataFrame, months: DataFrame, length: int) -> DataFrame:
    """(month, values) of all months asked for; a month without a vector of the length has zeros."""
    known = vectors.where(F.size("values") == length).select("month", "values")
    zeros = F.array_repeat(F.lit(0.0), length)
    return months.join(known, "month", "left").select("month", F.coalesce("values", zeros).alias("values"))


def positions(rows: DataFrame, order: str) -> DataFrame:
    """(…, position) from 1 on in the order, ties by chance: ranks within ranges of the order and the sizes of the ranges before.

    Ranges are partitions of a range shuffle, so that no task sees all rows.
    """
    ranged = settle(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    ranked = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return ranked.join(F.broadcast(offsets), "_part").withColumn("position", (F.col("_before") + F.col("_k")).cast("int")).drop("_part", "_k", "_before")


def positional(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of two frames side by side by their position in the order; the longer one's rest beside nulls."""
    return positions(left, order).join(positions(right, order), "position", "full")


def confusion(scored: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(truth, guess, n) of all pairs that occur."""
    return scored.groupBy(truth.alias("truth"), guess.alias("guess")).agg(F.count("*").alias("n"))
