"""Irregular readings onto a regular grid of weekdays.

Each series' readings are reduced to one a day by a partial aggregation. A trend with weekly and yearly harmonics is fitted to
the logarithm of the values: the normal equations' sums are ordinary aggregates, so that only one small matrix a series is
solved in Python. Grid days without reading get the fit plus the residual, bridged in a straight line between the nearest
observed days. Windows run over a series' days, whose number the calendar bounds, however many readings there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import settle

ORIGIN = 16436  # 2015-01-01 in days, so that the sums stay small
RIDGE = 1e-6


def features(day: Column) -> list[Column]:
    """Constant, trend in decades, two yearly harmonics and a weekly one."""
    t = (F.unix_date(day) - ORIGIN).cast("double")
    year, week = t * (2 * np.pi / 365.25), t * (2 * np.pi / 7)
    return [F.lit(1.0), t / 3652.5, F.sin(year), F.cos(year), F.sin(year * 2), F.cos(year * 2), F.sin(week), F.cos(week)]


def usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def daily(readings: DataFrame, keys: list[str], moment: str, value: str, arrived: str) -> DataFrame:
    """(keys, day, value, readings): the last usable reading of each day; of one moment the one that arrived last."""
    r = readings.select(*[F.upper(F.trim(F.coalesce(F.col(k), F.lit("")))).alias(k) for k in keys], F.col(moment).alias("_at"), F.col(value).cast("double").alias("_v"), F.col(arrived).alias("_in"))
    r = r.where(usable(F.col("_v")) & F.col("_at").isNotNull())
    return r.groupBy(*keys, F.to_date("_at").alias("day")).agg(F.max_by("_v", F.struct("_at", "_in", "_v")).alias("value"), F.count("*").alias("readings"))


def fit(days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coefficients, first_day, last_day) by the normal equations of each series."""
    f, y = features(F.col("day")), F.ln("value")
    n = len(f)
    sums = [F.sum(f[i] * f[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(f[i] * y).alias(f"b{i}") for i in range(n)]
    tables = days.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), *sums)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.zeros((batch.num_rows, n, n))
            b = np.stack([batch.column(f"b{i}").to_numpy(zero_copy_only=False) for i in range(n)], 1)
            for i in range(n):
                for j in range(i, n):
                    a[:, i, j] = a[:, j, i] = batch.column(f"a{i}_{j}").to_numpy(zero_copy_only=False)
            # the ridge keeps series of few days solvable; the constant is left free
            a += np.diag([0.0] + [1.0] * (n - 1)) * RIDGE * np.maximum(a[:, :1, :1], 1)
            c = np.linalg.solve(a, b[:, :, None])[:, :, 0] if batch.num_rows else np.zeros((0, n))
            kept = [batch.column(k) for k in (*keys, "first_day", "last_day")]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), n).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept, lists], names=[*keys, "first_day", "last_day", "coefficients"])

    kinds = ", ".join(f"`{k}` string" for k in keys)
    return tables.mapInArrow(solve, f"{kinds}, first_day date, last_day date, coefficients array<double>")


def weekday_grid(readings: DataFrame, keys: list[str], moment: str, value: str, arrived: str) -> DataFrame:
    """(keys, day, value, filled, readings): one row for every Monday to Friday between a series' first and last usable reading.

    `filled` marks days without usable reading, whose value is predicted. Series are told apart by their trimmed, upper-case
    keys, a null key being ''. Null, NaN, infinite, zero and negative values and readings without moment don't count; repeated
    rows count once a day; a series of one day has one row or, on a weekend, none; an empty table gives no rows.
    """
    days = settle(daily(readings, keys, moment, value, arrived))
    model = settle(fit(days, keys))
    # weekends stay in as supports of the bridge until the end
    calendar = model.select(*keys, "coefficients", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    f = features(F.col("day"))
    predicted = reduce(lambda s, i: s + f[i] * F.col("coefficients")[i], range(1, len(f)), F.col("coefficients")[0])
    grid = calendar.select(*keys, "day", predicted.alias("fit")).join(days, [*keys, "day"], "left").withColumn("gap", F.ln("value") - F.col("fit"))
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("value").isNotNull(), F.struct("day", "gap"))
    grid = grid.withColumn("left", F.last(known, True).over(before)).withColumn("right", F.last(known, True).over(after))
    span = F.datediff("right.day", "left.day")
    bridge = F.col("left.gap") + F.when(span > 0, (F.col("right.gap") - F.col("left.gap")) * F.datediff("day", "left.day") / span).otherwise(0.0)
    return grid.where(F.weekday("day") < 5).select(
        *keys, "day", F.coalesce("value", F.exp(F.col("fit") + bridge)).alias("value"), F.col("value").isNull().alias("filled"), F.coalesce("readings", F.lit(0)).cast("bigint").alias("readings")
    )
