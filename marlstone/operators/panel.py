"""Daily price panels in long form: alignment, fills, rebasing, returns and monthly risk features.

All functions take and give (ticker, date, close) rows. Windows are partitioned by ticker or by ticker and month, so that no
task holds more than one series' calendar; wide forms appear only at the edge, with an explicit list of tickers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252


def safe_ln(c: Column) -> Column:
    """ln, null where the argument isn't above zero."""
    return F.when(c > 0, F.ln(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b, F.lit(0.0))


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def dense(px: DataFrame, tickers: list[str]) -> DataFrame:
    """Every date of the panel with every ticker; a missing price is null."""
    dates = px.select("date").distinct().select("date", F.explode(F.array(*map(F.lit, tickers))).alias("ticker"))
    return dates.join(px, ["date", "ticker"], "left")


def carried(value: str, by: list[str], order: str) -> Column:
    """Backward fill, then the last value carried forward."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.first(value, True).over(ahead), F.last(value, True).over(behind))


def fill(px: DataFrame, tickers: list[str], order: str = "after_align") -> DataFrame:
    """Gaps filled: after_align fills the dense panel, before_align each ticker on its own dates, calendar gaps staying null."""
    if order == "before_align":
        return dense(px.withColumn("close", carried("close", ["ticker"], "date")), tickers)
    return dense(px, tickers).withColumn("close", carried("close", ["ticker"], "date"))


def interpolate(px: DataFrame) -> DataFrame:
    """True linear interpolation by row position between known values; both ends carry the nearest one."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = px.withColumn("k", F.row_number().over(w))
    known = F.when(F.col("close").isNotNull(), F.struct("k", "close"))
    before, after = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("a", before).withColumn("b", after)
    line = F.col("a.close") + (F.col("b.close") - F.col("a.close")) * (F.col("k") - F.col("a.k")) / F.nullif(F.col("b.k") - F.col("a.k"), F.lit(0))
    return rows.select("ticker", "date", F.coalesce("close", line, "a.close", "b.close").alias("close"))


def rebase(px: DataFrame) -> DataFrame:
    """(…, rebased, log_evolution) by each ticker's first known price; null throughout if that isn't above zero."""
    first = F.first("close", True).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rebased = F.when(first > 0, F.col("close") / first)
    return px.withColumn("rebased", rebased).withColumn("log_evolution", safe_ln(F.col("rebased")))


def log_returns(px: DataFrame) -> DataFrame:
    """(…, ret) over the whole series."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    return px.withColumn("ret", safe_ln(ratio(F.col("close"), before)))


def month_returns(panel: DataFrame) -> DataFrame:
    """(month, date, ticker, close, ret) of a dense panel: lag within the month, dates with any missing return dropped for all.

    Tickers without a price in the month don't count.
    """
    rows = panel.withColumn("month", month(F.col("date")))
    rows = rows.withColumn("n_px", F.count("close").over(Window.partitionBy("month", "ticker"))).where("n_px > 0").drop("n_px")
    before = F.lag("close").over(Window.partitionBy("month", "ticker").orderBy("date"))
    rows = rows.withColumn("ret", safe_ln(ratio(F.col("close"), before)))
    by_date = Window.partitionBy("month", "date")
    return rows.withColumn("n_all", F.count("*").over(by_date)).withColumn("n_ret", F.count("ret").over(by_date)).where("n_all = n_ret").select("month", "date", "ticker", "close", "ret")


def monthly_features(panel: DataFrame) -> DataFrame:
    """(month, ticker, 7 features): first and last close, volatility, Sharpe, Sortino, drawdown and Calmar of each month."""
    rows = panel.withColumn("month", month(F.col("date"))).where(F.col("close").isNotNull() | F.lit(True))
    w = Window.partitionBy("month", "ticker").orderBy("date")
    start = F.first("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    peak = F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    falls = rows.withColumn("fall", F.when(start.isNotNull() & F.col("close").isNotNull(), ratio(peak - F.col("close"), peak)))
    levels = falls.groupBy("month", "ticker").agg(
        F.min_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("month_first_close"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("month_last_close"), F.max("fall").alias("mdd"), F.count("close").alias("n_px")
    ).where("n_px > 0")
    moves = month_returns(panel).groupBy("month", "ticker").agg(F.avg("ret").alias("mean"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(DAYS)))).alias("volatility"), (F.stddev_samp(F.least("ret", F.lit(0.0))) * F.sqrt(F.lit(float(DAYS)))).alias("downside"))
    growth = F.pow(F.col("month_last_close") / F.nullif(F.col("month_first_close"), F.lit(0.0)), F.lit(12.0)) - 1
    return levels.join(moves, ["month", "ticker"], "left").select(
        "month", "ticker", "month_first_close", "month_last_close", "volatility", ratio(F.col("mean") * DAYS, F.col("volatility")).alias("sharpe_ratio"), ratio(F.col("mean") * DAYS, F.col("downside")).alias("sortino_ratio"), "mdd", ratio(growth, F.col("mdd")).alias("calmar_ratio")
    )


FEATURES = ("month_first_close", "month_last_close", "volatility", "sharpe_ratio", "sortino_ratio", "mdd", "calmar_ratio")


def correlations(panel: DataFrame) -> DataFrame:
    """(month, t1, t2, corr) of the month's returns, t1 before t2; null where a side doesn't vary."""
    r = month_returns(panel)
    a, b = r.select("month", "date", F.col("ticker").alias("t1"), F.col("ret").alias("r1")), r.select("month", "date", F.col("ticker").alias("t2"), F.col("ret").alias("r2"))
    both = a.join(b, ["month", "date"]).where("t1 < t2").groupBy("month", "t1", "t2").agg(F.corr("r1", "r2").alias("corr"), F.stddev_samp("r1").alias("s1"), F.stddev_samp("r2").alias("s2"))
    return both.select("month", "t1", "t2", F.when((F.col("s1") > 0) & (F.col("s2") > 0), F.col("corr")).alias("corr"))


def observations(panel: DataFrame) -> DataFrame:
    """(month, labels, values): features and correlations of each month in one vector, undefined values being 0."""
    stack = ", ".join(f"'{f}', {f}" for f in FEATURES)
    long = monthly_features(panel).select("month", F.col("ticker"), F.expr(f"stack({len(FEATURES)}, {stack}) as (feature, value)"))
    place = F.array_position(F.array(*map(F.lit, FEATURES)), F.col("feature"))
    flat = long.select("month", F.struct(F.lit(0).alias("part"), F.col("ticker").alias("x"), F.format_string("%02d", place).alias("y")).alias("at"), F.concat_ws("_", "ticker", "feature").alias("label"), "value")
    pairs = correlations(panel).select("month", F.struct(F.lit(1).alias("part"), F.col("t1").alias("x"), F.col("t2").alias("y")).alias("at"), F.concat_ws("_", F.lit("corr"), "t1", "t2").alias("label"), F.col("corr").alias("value"))
    rows = flat.unionByName(pairs).groupBy("month").agg(F.array_sort(F.collect_list(F.struct("at", "label", F.coalesce("value", F.lit(0.0)).alias("value")))).alias("v"))
    return rows.select("month", F.transform("v", lambda x: x["label"]).alias("labels"), F.transform("v", lambda x: x["value"].cast("float")).alias("values"))


def wide(px: DataFrame, tickers: list[str], value: str = "close") -> DataFrame:
    """One column a ticker, by one shuffle instead of a chain of outer joins."""
    return px.groupBy("date").pivot("ticker", tickers).agg(F.first(value, True))


def month_last(px: DataFrame) -> DataFrame:
    """(ticker, month, month_end, close): last known close of each month."""
    known = px.where(F.col("close").isNotNull())
    return known.groupBy("ticker", month(F.col("date")).alias("month")).agg(F.last_day(F.max("date")).alias("month_end"), F.max_by("close", "date").alias("close"))


def simple_returns(px: DataFrame, order: str = "date", by: str = "ticker") -> DataFrame:
    """(…, ret) = x / previous x - 1, gaps being carried forward first."""
    w = Window.partitionBy(by).orderBy(order)
    filled = px.withColumn("close", F.last("close", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("ret", ratio(F.col("close"), F.lag("close").over(w)) - 1)


def coverage_gaps(px: DataFrame, start: Column, end: Column) -> DataFrame:
    """(ticker, gap_start, gap_end): what is missing before and after each cached series within [start, end]."""
    have = px.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    gaps = F.array(F.when(start < F.col("a"), F.struct(start.alias("s"), F.date_sub("a", 1).alias("e"))), F.when(end > F.col("b"), F.struct(F.date_add("b", 1).alias("s"), end.alias("e"))))
    return have.select("ticker", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("g")).select("ticker", F.col("g.s").alias("gap_start"), F.col("g.e").alias("gap_end"))


def newest_wins(*frames: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of all frames, of equal keys the one of the last frame."""
    rows = None
    for i, f in enumerate(frames):
        f = f.withColumn("_age", F.lit(i))
        rows = f if rows is None else rows.unionByName(f, allowMissingColumns=True)
    pick = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_age")))
    return rows.withColumn("_n", pick).where("_n = 1").drop("_n", "_age")


def first_wins(*frames: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of all frames, of equal keys the one of the first frame."""
    return newest_wins(*reversed(frames), keys=keys)


def ema(rows: DataFrame, keys: list[str], order: str, value: str, span: int) -> DataFrame:
    """(…, ema): exponential moving average with alpha 2 / (span + 1), from the first value on; a null keeps the average."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    alpha = 2.0 / (span + 1)
    step = lambda a, x: F.when(x.isNull(), a).when(a.isNull(), x).otherwise(x * alpha + a * (1 - alpha))
    series = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    grown = F.aggregate(
        "s", F.array().cast("array<struct<o:string,e:double>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(x["o"].cast("string").alias("o"), step(F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["e"]), x["v"]).alias("e")))),
    )
    flat = series.select(*keys, F.explode(grown).alias("x")).select(*keys, F.col("x.o").alias("_o"), F.col("x.e").alias("ema"))
    return rows.withColumn("_o", F.col(order).cast("string")).join(flat, [*keys, "_o"]).drop("_o")


def wacc(equity: Column, debt: Column, cost_of_equity: Column, cost_of_debt: Column, tax: float) -> Column:
    """Weighted average cost of capital."""
    total = F.nullif(equity + debt, F.lit(0.0))
    return equity / total * cost_of_equity + debt / total * cost_of_debt * (1 - tax)


def with_random(vectors: DataFrame, every: int = 7, start: int = 2, seed: int = 42) -> DataFrame:
    """(month, values): each month's values at start, start + every, …, and as many uniform values from -1 to 1 by seed and month."""
    slots = F.sequence(F.lit(start), F.size("values") - 1, F.lit(every))
    taken = F.when(F.size("values") > start, F.transform(slots, lambda i: F.get("values", i))).otherwise(F.array().cast("array<float>"))
    value = lambda i: (F.pmod(F.xxhash64("month", i, F.lit(seed)), F.lit(1 << 31)) / float(1 << 30) - 1).cast("float")
    drawn = F.when(F.size("values") > start, F.transform(slots, value)).otherwise(F.array().cast("array<float>"))
    return vectors.select("month", F.concat(taken, drawn).alias("values"))


def inventory(px: DataFrame) -> DataFrame:
    """(ticker, n_rows, start, end, coverage_days, null_<column>, has_<price>, error) of each cached series.

    Nulls are counted in every other column; error names what is missing for a price.
    """
    others = [c for c in px.columns if c not in ("ticker", "date")]
    prices = [c for c in ("close", "adj_close") if c in px.columns]
    out = px.groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.datediff(F.max("date"), F.min("date")).alias("coverage_days"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in others],
    )
    flags = {f"has_{c}": F.col(f"null_{c}") < F.col("n_rows") if c in prices else F.lit(False) for c in ("close", "adj_close")}
    priced = F.col("has_close") | F.col("has_adj_close")
    return out.withColumns(flags).withColumn("error", F.when(~priced, "no close or adj_close").when(F.col("start_date").isNull(), "no date"))
