"""Queries on price panels, portfolios and back-tests.

The panel of these queries has one series for each flag and status of the order lines, its price being the day's highest; the
ledger's actions are the quantities of four models and five seeds. Operators that need one series only run on the readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import grid, panel, policies, portfolio
from marlstone.plans.kit import Book, num, rounded
from marlstone.session import settle, table

BOOK = Book()
TICKERS = ["AF", "AO", "NF", "NO", "RF", "RO"]

PX = """px AS (SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2)"""
PANEL = PX + """, panel AS (SELECT ticker, date, close FROM (SELECT DISTINCT date FROM px) CROSS JOIN (SELECT DISTINCT ticker FROM px) LEFT JOIN px USING (ticker, date))"""
FILLED = PANEL + """, filled AS (SELECT ticker, date, coalesce(first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS close FROM panel)"""
RETS = PANEL + """, m AS (SELECT strftime(date, '%Y-%m') AS month, ticker, date, close, count(close) OVER (PARTITION BY strftime(date, '%Y-%m'), ticker) AS n_px FROM panel),
r0 AS (SELECT month, ticker, date, close, CASE WHEN close / nullif(lag(close) OVER (PARTITION BY month, ticker ORDER BY date), 0) > 0 THEN ln(close / nullif(lag(close) OVER (PARTITION BY month, ticker ORDER BY date), 0)) END AS ret FROM m WHERE n_px > 0),
rets AS (SELECT month, ticker, date, close, ret FROM (SELECT *, count(*) OVER (PARTITION BY month, date) AS a, count(ret) OVER (PARTITION BY month, date) AS b FROM r0) WHERE a = b)"""
FEATS = RETS + """, lv AS (SELECT month, ticker, min_by(close, date) FILTER (close IS NOT NULL) AS month_first_close, max_by(close, date) FILTER (close IS NOT NULL) AS month_last_close, max(CASE WHEN f IS NOT NULL THEN (peak - close) / nullif(peak, 0) END) AS mdd FROM
 (SELECT *, max(close) OVER (PARTITION BY month, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak, first_value(close) OVER (PARTITION BY month, ticker ORDER BY date) AS f FROM m) GROUP BY 1, 2 HAVING count(close) > 0),
mv AS (SELECT month, ticker, avg(ret) AS mean, stddev_samp(ret) * sqrt(252) AS volatility, stddev_samp(least(ret, 0.0)) * sqrt(252) AS down FROM rets GROUP BY 1, 2),
feats AS (SELECT month, ticker, month_first_close, month_last_close, volatility, mean * 252 / nullif(volatility, 0) AS sharpe_ratio, mean * 252 / nullif(down, 0) AS sortino_ratio, mdd, (pow(month_last_close / nullif(month_first_close, 0), 12) - 1) / nullif(mdd, 0) AS calmar_ratio FROM lv LEFT JOIN mv USING (month, ticker))"""
CORRS = """, corrs AS (SELECT month, t1, t2, CASE WHEN s1 > 0 AND s2 > 0 THEN c END AS corr FROM (SELECT a.month, a.ticker AS t1, b.ticker AS t2, corr(a.ret, b.ret) AS c, stddev_samp(a.ret) AS s1, stddev_samp(b.ret) AS s2 FROM rets a JOIN rets b ON a.month = b.month AND a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2, 3))"""
LEDGER = """led AS (SELECT CAST(l_linenumber % 4 AS INTEGER) AS model, CAST(l_suppkey % 5 AS INTEGER) AS seed, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag || l_linestatus AS ticker, sum(l_quantity) AS action FROM lineitem GROUP BY 1, 2, 3, 4)"""
SUMW = LEDGER + """, w AS (SELECT *, CASE WHEN sum(action) OVER (PARTITION BY model, seed, month) > 0 THEN action / sum(action) OVER (PARTITION BY model, seed, month) ELSE 1.0 / 6 END AS weight FROM led)"""
SOFTW = LEDGER + """, w AS (SELECT model, seed, month, ticker, action, e / sum(e) OVER (PARTITION BY model, seed, month) AS weight FROM (SELECT *, exp(action / 100 - max(action / 100) OVER (PARTITION BY model, seed, month)) AS e FROM led))"""
MRET = """, ml AS (SELECT ticker, strftime(date, '%Y-%m') AS month, last_day(max(date)) AS month_end, max_by(close, date) AS close FROM filled GROUP BY 1, 2), mret AS (SELECT ticker, month, close, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY month), 0) - 1 AS ret FROM ml)"""
ROI = SUMW + ", " + FILLED + MRET + """, roi AS (SELECT model, seed, month, sum(weight * ret) AS roi FROM w JOIN mret USING (month, ticker) WHERE ret IS NOT NULL GROUP BY 1, 2, 3)"""
MEAN = ROI + """, mean AS (SELECT model, month, avg(roi) AS roi FROM roi GROUP BY 1, 2)"""


def _episode(keys: str, source: str, std: str) -> str:
    return f"""SELECT {keys}, CASE WHEN f > 0 THEN l / nullif(f, 0) - 1 ELSE 0 END AS roi, v AS volatility, d AS mdd, 2 * (CASE WHEN f > 0 THEN l / nullif(f, 0) - 1 ELSE 0 END) - 0.7 * v - 0.5 * d AS reward FROM
 (SELECT {keys}, min_by(value, date) AS f, max_by(value, date) AS l, coalesce({std}(step), 0) AS v, coalesce(max((peak - value) / nullif(peak, 0)), 0) AS d FROM
 (SELECT *, value / nullif(lag(value) OVER (PARTITION BY {keys} ORDER BY date), 0) - 1 AS step, max(value) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM {source}) GROUP BY {keys})"""


def _round(names: str, sql: str, keep: str) -> str:
    """SELECT keep, rounded names FROM (sql's last select)."""
    return f"SELECT {keep}, " + ", ".join(f"round({n}, 6) AS {n}" for n in names.split()) + f" FROM {sql}"


def prices(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("close"))


def ledger(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy((F.col("l_linenumber") % 4).cast("int").alias("model"), (F.col("l_suppkey") % 5).cast("int").alias("seed"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.concat("l_returnflag", "l_linestatus").alias("ticker")).agg(F.sum("l_quantity").alias("action"))


def dense(s: SparkSession, d: str) -> DataFrame:
    return panel.dense(prices(s, d), TICKERS)


def filled(s: SparkSession, d: str) -> DataFrame:
    return panel.fill(prices(s, d), TICKERS)


def sum_weighted(s: SparkSession, d: str) -> DataFrame:
    return portfolio.sum_weights(ledger(s, d), ["model", "seed", "month"], len(TICKERS))


def soft_weighted(s: SparkSession, d: str) -> DataFrame:
    return portfolio.softmax_weights(ledger(s, d).withColumn("action", F.col("action") / 100), ["model", "seed", "month"])


def month_rets(s: SparkSession, d: str) -> DataFrame:
    return panel.simple_returns(panel.month_last(filled(s, d)), "month")


def roi(s: SparkSession, d: str) -> DataFrame:
    return portfolio.rebased_roi(sum_weighted(s, d), month_rets(s, d).where("ret is not null"), ["model", "seed"])


def mean_roi(s: SparkSession, d: str) -> DataFrame:
    return roi(s, d).groupBy("model", "month").agg(F.avg("roi").alias("roi"))


@BOOK.add("win3_win4_fill_after_align", f"WITH {FILLED} SELECT ticker, date, close FROM filled")
def fill_after(s: SparkSession, d: str) -> DataFrame:
    return filled(s, d)


@BOOK.add("join1_fill_before_align", f"WITH {PANEL} SELECT ticker, date, close FROM panel")
def fill_before(s: SparkSession, d: str) -> DataFrame:
    return panel.fill(prices(s, d), TICKERS, "before_align")


@BOOK.add("join2_agg12_wide_close", f"WITH {PX} SELECT date, " + ", ".join(f"max(close) FILTER (ticker = '{t}') AS \"{t}\"" for t in TICKERS) + " FROM px GROUP BY date")
def wide_close(s: SparkSession, d: str) -> DataFrame:
    return panel.wide(prices(s, d), TICKERS)


INTERPOLATED = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM panel), n AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN k END IGNORE NULLS) OVER a AS ka, last_value(close IGNORE NULLS) OVER a AS ca, first_value(CASE WHEN close IS NOT NULL THEN k END IGNORE NULLS) OVER b AS kb, first_value(close IGNORE NULLS) OVER b AS cb FROM k
 WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ticker, date, round(coalesce(close, ca + (cb - ca) * (k - ka) / nullif(kb - ka, 0), ca, cb), 6) AS close FROM n"""


@BOOK.add("win5_interpolate", f"WITH {PANEL}, " + INTERPOLATED[5:])
def interpolate(s: SparkSession, d: str) -> DataFrame:
    return rounded(panel.interpolate(dense(s, d)))


@BOOK.add("win6_win7_rebase_log", f"WITH {FILLED} " + """SELECT ticker, date, close, round(CASE WHEN f > 0 THEN close / f END, 6) AS rebased, round(CASE WHEN f > 0 AND close / f > 0 THEN ln(close / f) END, 6) AS log_evolution FROM (SELECT *, first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM filled)""")
def rebase_log(s: SparkSession, d: str) -> DataFrame:
    return rounded(panel.rebase(filled(s, d)))


@BOOK.add("win1_log_returns", f"WITH {PX} SELECT ticker, date, close, round(ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)), 6) AS ret FROM px")
def log_returns(s: SparkSession, d: str) -> DataFrame:
    return rounded(panel.log_returns(prices(s, d)))


@BOOK.add("win2_month_returns", f"WITH {RETS} SELECT month, ticker, date, close, round(ret, 6) AS ret FROM rets")
def month_returns(s: SparkSession, d: str) -> DataFrame:
    return rounded(panel.month_returns(dense(s, d)))


@BOOK.add("agg2_7_monthly_features", f"WITH {FEATS} " + _round("month_first_close month_last_close volatility sharpe_ratio sortino_ratio mdd", "feats", "month, ticker, CAST(calmar_ratio AS FLOAT) AS calmar_ratio"))
def monthly_features(s: SparkSession, d: str) -> DataFrame:
    return rounded(panel.monthly_features(dense(s, d)).withColumn("calmar_ratio", F.col("calmar_ratio").cast("float")))


@BOOK.add("agg8_join15_correlations", f"WITH {RETS}{CORRS} SELECT month, t1, t2, round(corr, 6) AS corr FROM corrs")
def correlations(s: SparkSession, d: str) -> DataFrame:
    return rounded(panel.correlations(dense(s, d)))


@BOOK.add("prj7_8_arr1_observations", None)
def observations(s: SparkSession, d: str) -> DataFrame:
    return panel.observations(dense(s, d))


@BOOK.add("prj8_upper_triangle", f"WITH {RETS}{CORRS} SELECT month, 'corr_' || t1 || '_' || t2 AS label, round(coalesce(corr, 0), 6) AS value FROM corrs")
def upper_triangle(s: SparkSession, d: str) -> DataFrame:
    o = panel.observations(dense(s, d)).select("month", F.explode(F.arrays_zip("labels", "values")).alias("x"))
    pairs = panel.correlations(dense(s, d)).select("month", F.concat_ws("_", F.lit("corr"), "t1", "t2").alias("label"), F.coalesce("corr", F.lit(0.0)).alias("value"))
    # the vector holds single precision; its labels decide which pairs there are
    return rounded(o.select("month", F.col("x.labels").alias("label")).where("label like 'corr%'").join(pairs, ["month", "label"]))


@BOOK.add("prj9_values_only", f"WITH {FEATS}{CORRS}, f AS (SELECT month, count(*) * 7 AS n FROM feats GROUP BY 1), c AS (SELECT month, count(*) AS n FROM corrs GROUP BY 1) SELECT month, CAST(f.n + coalesce(c.n, 0) AS BIGINT) AS length FROM f LEFT JOIN c USING (month)")
def values_only(s: SparkSession, d: str) -> DataFrame:
    return panel.observations(dense(s, d)).select("month", num(F.size("values")).alias("length"))


@BOOK.add("prj7_feature_labels", f"WITH {FEATS} SELECT month, ticker || '_' || feature AS label, CAST(coalesce(value, 0) AS FLOAT) AS value FROM (UNPIVOT (SELECT month, ticker, coalesce(month_first_close, 0) AS month_first_close, coalesce(month_last_close, 0) AS month_last_close, coalesce(volatility, 0) AS volatility, coalesce(sharpe_ratio, 0) AS sharpe_ratio, coalesce(sortino_ratio, 0) AS sortino_ratio, coalesce(mdd, 0) AS mdd, coalesce(calmar_ratio, 0) AS calmar_ratio FROM feats) ON month_first_close, month_last_close, volatility, sharpe_ratio, sortino_ratio, mdd, calmar_ratio INTO NAME feature VALUE value)")
def feature_labels(s: SparkSession, d: str) -> DataFrame:
    f = panel.monthly_features(dense(s, d))
    long = f.select("month", "ticker", F.expr("stack(7, " + ", ".join(f"'{n}', {n}" for n in panel.FEATURES) + ") as (feature, value)"))
    return long.select("month", F.concat_ws("_", "ticker", "feature").alias("label"), F.coalesce("value", F.lit(0.0)).cast("float").alias("value"))


@BOOK.add("prj11_all_null_months", f"WITH {PANEL} SELECT strftime(date, '%Y-%m') AS month, ticker, count(close) AS n_px FROM panel GROUP BY 1, 2 HAVING count(close) > 0")
def all_null_months(s: SparkSession, d: str) -> DataFrame:
    return dense(s, d).groupBy(F.date_format("date", "yyyy-MM").alias("month"), "ticker").agg(F.count("close").alias("n_px")).where("n_px > 0")


@BOOK.add("win8_drawdown", f"WITH {FILLED} SELECT ticker, date, round((peak - close) / nullif(peak, 0), 6) AS drawdown FROM (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM filled)")
def drawdown(s: SparkSession, d: str) -> DataFrame:
    peak = F.max("close").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return rounded(filled(s, d).select("ticker", "date", panel.ratio(peak - F.col("close"), peak).alias("drawdown")))


@BOOK.add("win10_11_month_returns", f"WITH {FILLED}{MRET} SELECT ticker, month, close, round(ret, 6) AS ret FROM mret")
def month_simple_returns(s: SparkSession, d: str) -> DataFrame:
    return rounded(month_rets(s, d).select("ticker", "month", "close", "ret"))


@BOOK.add("win11_month_end", f"WITH {FILLED}{MRET} SELECT ticker, month, month_end, close FROM ml")
def month_end(s: SparkSession, d: str) -> DataFrame:
    return panel.month_last(filled(s, d)).select("ticker", "month", "month_end", "close")


@BOOK.add("agg23_equal_weight_month", f"WITH {FILLED}{MRET} SELECT month, round(avg(ret), 6) AS ret FROM mret WHERE ret IS NOT NULL GROUP BY 1")
def equal_weight_month(s: SparkSession, d: str) -> DataFrame:
    return rounded(month_rets(s, d).where("ret is not null").groupBy("month").agg(F.avg("ret").alias("ret")))


@BOOK.add("sim7_agg24_buy_and_hold", f"WITH {FILLED}" + """, h AS (SELECT *, first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM filled), v AS (SELECT date, sum(close * (10000.0 / 6) / nullif(f, 0)) AS portfolio_value FROM h GROUP BY 1) SELECT date, round(portfolio_value, 6) AS portfolio_value, round(ln(portfolio_value / 10000), 6) AS log_evolution FROM v""")
def buy_and_hold(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.equal_weight(filled(s, d), 10_000.0))


@BOOK.add("math3_sum_weights", f"WITH {SUMW} SELECT model, seed, month, ticker, action, round(weight, 6) AS weight FROM w")
def weights_sum(s: SparkSession, d: str) -> DataFrame:
    return rounded(sum_weighted(s, d))


@BOOK.add("math2_softmax_weights", f"WITH {SOFTW} SELECT model, seed, month, ticker, round(weight, 6) AS weight FROM w")
def weights_soft(s: SparkSession, d: str) -> DataFrame:
    return rounded(soft_weighted(s, d).select("model", "seed", "month", "ticker", "weight"))


@BOOK.add("eval1_join5_roi", f"WITH {ROI} SELECT model, seed, month, round(roi, 6) AS roi FROM roi")
def eval_roi(s: SparkSession, d: str) -> DataFrame:
    return rounded(roi(s, d))


TRAIN = SUMW + ", " + FILLED + """, x AS (SELECT *, strftime(date, '%Y-%m') AS wm FROM filled UNION ALL SELECT *, strftime(date + INTERVAL 1 DAY, '%Y-%m') FROM filled WHERE date = last_day(date)),
e AS (SELECT model, seed, w.month AS month, x.date, sum(x.close * w.weight) AS value FROM w JOIN x ON x.ticker = w.ticker AND x.wm = strftime(CAST(w.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') GROUP BY 1, 2, 3, 4)"""


@BOOK.add("sim1_join8_training", f"WITH {TRAIN} " + _round("roi volatility mdd reward", "(" + _episode("model, seed, month", "e", "stddev_pop") + ")", "model, seed, month"))
def training(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.train_episodes(sum_weighted(s, d).select("model", "seed", "month", "ticker", "weight"), filled(s, d), ["model", "seed"]))


def _back(weights: str, lag: int, std: str) -> str:
    e = f"e AS (SELECT model, seed, strftime(CAST(w.month || '-01' AS DATE) + INTERVAL {lag} MONTH, '%Y-%m') AS month, x.date, sum(x.close * w.weight) AS value FROM w JOIN filled x ON x.ticker = w.ticker AND strftime(x.date, '%Y-%m') = strftime(CAST(w.month || '-01' AS DATE) + INTERVAL {lag} MONTH, '%Y-%m') GROUP BY 1, 2, 3, 4)"
    return f"WITH {weights}, {FILLED}, {e} " + _round("roi volatility mdd reward", "(" + _episode("model, seed, month", "e", std) + ")", "model, seed, month")


@BOOK.add("sim2_join9_win16_back_test", _back(SUMW, 1, "stddev_pop"))
def back_test(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.back_test(sum_weighted(s, d).select("model", "seed", "month", "ticker", "weight"), filled(s, d), ["model", "seed"], 1, "pop"))


@BOOK.add("agg21_seed_means", "SELECT model, month, round(avg(roi), 6) AS roi, round(avg(volatility), 6) AS volatility, round(avg(mdd), 6) AS mdd, round(avg(reward), 6) AS reward FROM (" + _back(SUMW, 1, "stddev_pop").replace("round(roi, 6) AS roi", "roi").replace("round(volatility, 6) AS volatility", "volatility").replace("round(mdd, 6) AS mdd", "mdd").replace("round(reward, 6) AS reward", "reward") + ") GROUP BY 1, 2")
def seed_means(s: SparkSession, d: str) -> DataFrame:
    runs = portfolio.back_test(sum_weighted(s, d).select("model", "seed", "month", "ticker", "weight"), filled(s, d), ["model", "seed"], 1, "pop")
    return rounded(runs.groupBy("model", "month").agg(*[F.avg(c).alias(c) for c in ("roi", "volatility", "mdd", "reward")]))


@BOOK.add("sim4_agg26_meta", _back(SOFTW, 0, "stddev_samp"))
def meta(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.back_test(soft_weighted(s, d).select("model", "seed", "month", "ticker", "weight"), filled(s, d), ["model", "seed"], 0, "samp"))


@BOOK.add("sim5_super_without_last", _back(SOFTW, 0, "stddev_samp").replace("FROM (SELECT model, seed, month, CASE", "FROM (SELECT * FROM (SELECT model, seed, month, CASE", 1) + " QUALIFY month < max(month) OVER (PARTITION BY model, seed))")
def super_stage(s: SparkSession, d: str) -> DataFrame:
    rows = portfolio.back_test(soft_weighted(s, d).select("model", "seed", "month", "ticker", "weight"), filled(s, d), ["model", "seed"], 0, "samp")
    return rounded(rows.withColumn("z", F.max("month").over(Window.partitionBy("model", "seed"))).where("month < z").drop("z"))


@BOOK.add("win9_cumulative", f"WITH {MEAN} SELECT model, month, round(roi, 6) AS roi, CAST(exp(sum(ln(1 + roi)) OVER (PARTITION BY model ORDER BY month)) - 1 AS FLOAT) AS cumulative FROM mean")
def cumulative(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.cumulative(mean_roi(s, d), ["model"]).withColumn("cumulative", F.col("cumulative").cast("float")))


CARD = """, c AS (SELECT *, exp(sum(ln(1 + roi)) OVER (PARTITION BY model ORDER BY month)) AS g FROM mean), p AS (SELECT *, max(g) OVER (PARTITION BY model ORDER BY month) AS peak FROM c),
a AS (SELECT model, product(1 + roi) - 1 AS total_return, count(*) AS n, stddev_pop(roi) * sqrt(12) AS volatility, stddev_pop(roi) FILTER (roi < 0) * sqrt(12) AS down, max((peak - g) / peak) AS max_drawdown, avg(CAST(roi > 0 AS DOUBLE)) AS win_rate FROM p GROUP BY 1),
b AS (SELECT *, pow(1 + total_return, 12.0 / n) - 1 AS annualized_return FROM a), card AS (SELECT model, total_return, annualized_return, volatility, CASE WHEN volatility > 0 THEN annualized_return / volatility ELSE 0 END AS sharpe_ratio, CASE WHEN down > 0 THEN annualized_return / down ELSE 0 END AS sortino_ratio, CASE WHEN max_drawdown > 0 THEN annualized_return / max_drawdown ELSE 0 END AS calmar_ratio, max_drawdown, win_rate FROM b)"""
CARD_NAMES = "annualized_return volatility sharpe_ratio sortino_ratio calmar_ratio max_drawdown win_rate"


@BOOK.add("agg22_eval2_scorecard", f"WITH {MEAN}{CARD} " + _round(CARD_NAMES, "card", "model, CAST(total_return AS FLOAT) AS total_return"))
def scorecard(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.scorecard(mean_roi(s, d), ["model"]).withColumn("total_return", F.col("total_return").cast("float")))


BENCHED = MEAN + ", u AS (SELECT CAST(model AS VARCHAR) AS model, month, roi FROM mean UNION ALL SELECT 'equal_weight', month, avg(ret) FROM mret WHERE ret IS NOT NULL GROUP BY 2 UNION ALL SELECT 'index', month, ret FROM mret WHERE ret IS NOT NULL AND ticker = '" + TICKERS[0] + "')"


@BOOK.add("eval2_benchmarks", f"WITH {BENCHED}{CARD.replace('FROM mean)', 'FROM u)')} " + _round(CARD_NAMES, "card", "model, CAST(total_return AS FLOAT) AS total_return"))
def benchmarks(s: SparkSession, d: str) -> DataFrame:
    r = month_rets(s, d).where("ret is not null")
    equal = r.groupBy("month").agg(F.avg("ret").alias("roi")).select(F.lit("equal_weight").alias("model"), "month", "roi")
    index = r.where(F.col("ticker") == TICKERS[0]).select(F.lit("index").alias("model"), "month", F.col("ret").alias("roi"))
    runs = mean_roi(s, d).select(F.col("model").cast("string").alias("model"), "month", "roi")
    return rounded(portfolio.scorecard(runs.unionByName(equal).unionByName(index), ["model"]).withColumn("total_return", F.col("total_return").cast("float")))


@BOOK.add("rl1_trained_policies", None)
def trained(s: SparkSession, d: str) -> DataFrame:
    runs = [("evolve", seed) for seed in range(5)]
    return rounded(policies.train(panel.observations(dense(s, d)), month_rets(s, d), TICKERS, runs, 200))


@BOOK.add("rl2_meta_policy", None)
def meta_policy(s: SparkSession, d: str) -> DataFrame:
    """A policy on the weights of trained policies."""
    first = settle(trained(s, d), "runs")
    vectors = first.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("ticker", "seed", "action"))).alias("v")).select("month", F.transform("v", lambda x: x["action"]).alias("values"))
    return rounded(policies.train(vectors, month_rets(s, d), TICKERS, [("evolve", 1)], 200))


@BOOK.add("win12_rolling_sharpe", f"WITH {MEAN} SELECT model, month, round(CASE WHEN s > 0 THEN m * 12 / (s * sqrt(12)) ELSE 0 END, 6) AS rolling_sharpe FROM (SELECT *, count(roi) OVER w AS n, avg(roi) OVER w AS m, stddev_pop(roi) OVER w AS s FROM mean WINDOW w AS (PARTITION BY model ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12")
def rolling(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.rolling_sharpe(mean_roi(s, d), ["model"]))


RUNS = [f"m{m}_s{x}" for m in range(4) for x in range(5)]


@BOOK.add("ens3_agg12_roi_matrix", f"WITH {ROI} SELECT month, " + ", ".join(f"round(max(roi) FILTER ('m' || model || '_s' || seed = '{r}'), 6) AS {r}" for r in RUNS) + " FROM roi GROUP BY month")
def roi_matrix(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.run_matrix(roi(s, d).withColumn("run", F.concat(F.lit("m"), "model", F.lit("_s"), "seed")), RUNS, "roi"))


@BOOK.add("ens3_value_matrix", f"WITH {ROI}, v AS (SELECT month, 'm' || model || '_s' || seed AS run, 10000.0 * exp(sum(ln(1 + roi)) OVER (PARTITION BY model, seed ORDER BY month)) AS value FROM roi) SELECT month, " + ", ".join(f"CAST(max(value) FILTER (run = '{r}') AS FLOAT) AS {r}" for r in RUNS) + " FROM v GROUP BY month")
def value_matrix(s: SparkSession, d: str) -> DataFrame:
    grown = portfolio.cumulative(roi(s, d), ["model", "seed"], minus_one=False)
    rows = grown.select("month", F.concat(F.lit("m"), "model", F.lit("_s"), "seed").alias("run"), (10_000.0 * F.col("cumulative")).alias("value"))
    m = portfolio.run_matrix(rows, RUNS, "value")
    return m.select("month", *[F.col(r).cast("float").alias(r) for r in RUNS])


@BOOK.add("sim6_ledger", f"WITH {SUMW}, {FILLED}{MRET} SELECT model, seed, month, ticker, round(action, 6) AS action, round(weight, 6) AS weight, round(ret, 6) AS ret, round(weight * ret, 6) AS contribution FROM w LEFT JOIN (SELECT month, ticker, ret FROM mret) USING (month, ticker)")
def ledger_rows(s: SparkSession, d: str) -> DataFrame:
    w = sum_weighted(s, d).select("model", "seed", "month", "ticker", "action", "weight")
    return rounded(portfolio.ledger(w, month_rets(s, d)))


@BOOK.add("sim3_text_observations", f"WITH {FILLED}{MRET}, o AS (SELECT month, " + ", ".join(f"max(ret) FILTER (ticker = '{t}') AS \"{t}\"" for t in TICKERS) + " FROM mret WHERE month <= '1996-12' GROUP BY 1), m AS (SELECT strftime(x, '%Y-%m') AS month FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) AS x)) SELECT month, " + ", ".join(f"round(coalesce(\"{t}\", 0), 6) AS v{i}" for i, t in enumerate(TICKERS)) + " FROM m LEFT JOIN o USING (month)")
def text_observations(s: SparkSession, d: str) -> DataFrame:
    known = month_rets(s, d).where("month <= '1996-12'").groupBy("month").pivot("ticker", TICKERS).agg(F.first("ret"))
    vectors = known.select("month", F.array(*[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in TICKERS]).alias("values"))
    months = s.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("1998-12-01").cast("date"), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    o = portfolio.observed(vectors, months, len(TICKERS))
    return rounded(o.select("month", *[F.get("values", F.lit(i)).alias(f"v{i}") for i in range(len(TICKERS))]))


LABELS = [f"{t}_{m}_{x}" for t in TICKERS for m in range(2) for x in range(2)]


@BOOK.add("ens1_prj2_merged_weights", f"WITH {SUMW} SELECT month, " + ", ".join(f"round(max(weight) FILTER (ticker || '_' || model || '_' || seed = '{c}'), 6) AS \"{c}\"" for c in LABELS) + " FROM w GROUP BY month")
def merged_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.merge_runs(sum_weighted(s, d), LABELS))


@BOOK.add("ens2_join10_two_sources", f"WITH {SUMW}, a AS (SELECT month, ticker, avg(weight) AS x FROM w WHERE model < 2 GROUP BY 1, 2), b AS (SELECT month, ticker, avg(weight) AS y FROM w WHERE model >= 2 GROUP BY 1, 2) SELECT month, ticker, round(x, 6) AS text_weight, round(y, 6) AS metric_weight FROM a JOIN b USING (month, ticker)")
def two_sources(s: SparkSession, d: str) -> DataFrame:
    w = sum_weighted(s, d)
    a, b = (w.where(c).groupBy("month", "ticker").agg(F.avg("weight").alias(n)) for c, n in (("model < 2", "text_weight"), ("model >= 2", "metric_weight")))
    return rounded(a.join(b, ["month", "ticker"]))


@BOOK.add("join10_observations_correlations", f"WITH {FEATS}{CORRS}, f AS (SELECT month, count(*) AS tickers, avg(volatility) AS volatility FROM feats GROUP BY 1), c AS (SELECT month, count(*) AS pairs, avg(corr) AS corr FROM corrs GROUP BY 1) SELECT month, tickers, pairs, round(volatility, 6) AS volatility, round(corr, 6) AS corr FROM f JOIN c USING (month)")
def observed_pairs(s: SparkSession, d: str) -> DataFrame:
    features = panel.monthly_features(dense(s, d)).groupBy("month").agg(F.count("*").alias("tickers"), F.avg("volatility").alias("volatility"))
    pairs = panel.correlations(dense(s, d)).groupBy("month").agg(F.count("*").alias("pairs"), F.avg("corr").alias("corr"))
    return rounded(features.join(pairs, "month").select("month", "tickers", "pairs", "volatility", "corr"))


@BOOK.add("join11_positional", f"WITH {MEAN}, a AS (SELECT month AS m1, roi AS r1, row_number() OVER (ORDER BY month) AS position FROM mean WHERE model = 0), b AS (SELECT month AS m2, roi AS r2, row_number() OVER (ORDER BY month) AS position FROM mean WHERE model = 1 AND month > '1995-03') SELECT position, m1, round(r1, 6) AS r1, m2, round(r2, 6) AS r2 FROM a FULL JOIN b USING (position)")
def positional(s: SparkSession, d: str) -> DataFrame:
    m = mean_roi(s, d)
    a = m.where("model = 0").select("month", "roi").withColumnsRenamed({"roi": "r1"})
    b = m.where("model = 1 and month > '1995-03'").select("month", F.col("roi").alias("r2"))
    both = portfolio.positional(a.select("month", F.col("month").alias("m1"), "r1"), b.select("month", F.col("month").alias("m2"), "r2"), "month")
    return rounded(both.select(F.col("position").cast("bigint").alias("position"), "m1", "r1", "m2", "r2"))


@BOOK.add("join3_benchmark", f"WITH {MEAN}, bench AS (SELECT month, avg(ret) AS equal_weight, max(ret) FILTER (ticker = '{TICKERS[0]}') AS index_return FROM mret WHERE ret IS NOT NULL GROUP BY 1) SELECT model, month, round(roi, 6) AS roi, round(equal_weight, 6) AS equal_weight, round(index_return, 6) AS index_return FROM mean LEFT JOIN bench USING (month)")
def benchmark(s: SparkSession, d: str) -> DataFrame:
    bench = month_rets(s, d).where("ret is not null").groupBy("month").agg(F.avg("ret").alias("equal_weight"), F.max(F.when(F.col("ticker") == TICKERS[0], F.col("ret"))).alias("index_return"))
    return rounded(mean_roi(s, d).join(bench, "month", "left").select("model", "month", "roi", "equal_weight", "index_return"))


@BOOK.add("agg25_mean_weights", f"WITH {SUMW} SELECT model, ticker, round(avg(weight), 6) AS weight FROM w GROUP BY 1, 2")
def mean_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(sum_weighted(s, d).groupBy("model", "ticker").agg(F.avg("weight").alias("weight")))


@BOOK.add("agg31_episode_rewards", f"WITH {TRAIN}, ep AS (" + _episode("model, seed, month", "e", "stddev_pop") + ") SELECT model, seed, round(avg(reward), 6) AS mean_reward, round(stddev_pop(reward), 6) AS std_reward FROM ep GROUP BY 1, 2")
def episode_rewards(s: SparkSession, d: str) -> DataFrame:
    e = portfolio.train_episodes(sum_weighted(s, d).select("model", "seed", "month", "ticker", "weight"), filled(s, d), ["model", "seed"])
    return rounded(e.groupBy("model", "seed").agg(F.avg("reward").alias("mean_reward"), F.stddev_pop("reward").alias("std_reward")))


@BOOK.add("win15_rebase_from_month", f"WITH {MEAN}, c AS (SELECT model, month, exp(sum(ln(1 + roi)) OVER (PARTITION BY model ORDER BY month)) AS g FROM mean) SELECT model, month, CAST(g / first_value(g) OVER (PARTITION BY model ORDER BY month) AS FLOAT) AS value FROM c WHERE month >= '1998-01'")
def rebase_from_month(s: SparkSession, d: str) -> DataFrame:
    g = portfolio.cumulative(mean_roi(s, d), ["model"], minus_one=False).where("month >= '1998-01'")
    first = F.first("cumulative").over(Window.partitionBy("model").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return rounded(g.select("model", "month", (F.col("cumulative") / first).cast("float").alias("value")))


@BOOK.add("win14_baseline_point", f"WITH {MEAN} SELECT model, month, round(roi, 6) AS roi FROM mean UNION ALL SELECT DISTINCT model, '0000-00', 0.0 FROM mean")
def baseline_point(s: SparkSession, d: str) -> DataFrame:
    m = mean_roi(s, d)
    return rounded(m.unionByName(m.select("model").distinct().select("model", F.lit("0000-00").alias("month"), F.lit(0.0).alias("roi"))))


@BOOK.add("src8_win18_gaps", f"WITH {PX}, r AS (SELECT ticker, min(date) AS a, max(date) AS b FROM px GROUP BY 1) SELECT ticker, DATE '1995-01-01' AS gap_start, CAST(a - INTERVAL 1 DAY AS DATE) AS gap_end FROM r WHERE DATE '1995-01-01' < a UNION ALL SELECT ticker, CAST(b + INTERVAL 1 DAY AS DATE), DATE '2001-12-31' FROM r WHERE DATE '2001-12-31' > b")
def gaps(s: SparkSession, d: str) -> DataFrame:
    return panel.coverage_gaps(prices(s, d), F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))


@BOOK.add("src13_agg28_29_inventory", f"WITH {PANEL} SELECT ticker, count(*) AS n_rows, min(date) AS start_date, max(date) AS end_date, CAST(max(date) - min(date) AS INTEGER) AS coverage_days, count(*) FILTER (close IS NULL) AS null_close, count(close) > 0 AS has_close, false AS has_adj_close, CASE WHEN count(close) = 0 THEN 'no close or adj_close' END AS error FROM panel GROUP BY 1")
def inventory(s: SparkSession, d: str) -> DataFrame:
    return panel.inventory(dense(s, d))


@BOOK.add("set4_win13_newest_wins", "SELECT ticker, date, close FROM (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker, date ORDER BY age DESC) AS n FROM (SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close, 0 AS age FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_returnflag, CAST(l_shipdate AS DATE), min(l_extendedprice), 1 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1, 2)) WHERE n = 1")
def newest_wins(s: SparkSession, d: str) -> DataFrame:
    by = [F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("date")]
    li = table(s, d, "lineitem")
    return panel.newest_wins(li.groupBy(*by).agg(F.max("l_extendedprice").alias("close")), li.where("l_shipdate >= timestamp'1999-01-01'").groupBy(*by).agg(F.min("l_extendedprice").alias("close")), keys=["ticker", "date"])


@BOOK.add("src4_last_reading_of_day", "SELECT ticker, venue, day, max_by(close, (date, received_at, close)) AS value, count(*) AS readings FROM (SELECT upper(trim(ticker)) AS ticker, upper(trim(venue)) AS venue, CAST(date AS DATE) AS day, date, received_at, close FROM stock_closing_prices WHERE close IS NOT NULL AND NOT isnan(close) AND isfinite(close) AND close > 0) GROUP BY 1, 2, 3")
def last_reading(s: SparkSession, d: str) -> DataFrame:
    return grid.daily(table(s, d, "stock_closing_prices"), ["ticker", "venue"], "date", "close", "received_at").withColumn("readings", num(F.col("readings")))


@BOOK.add("flt1_flt2_ranges", f"WITH {PX} SELECT ticker, date, close FROM px WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND strftime(date, '%Y-%m') BETWEEN '1997-02' AND '1997-05'")
def ranges(s: SparkSession, d: str) -> DataFrame:
    return prices(s, d).where(F.col("date").between("1997-01-01", "1997-06-30") & F.date_format("date", "yyyy-MM").between("1997-02", "1997-05"))


@BOOK.add("date4_month_range", "SELECT strftime(m, '%Y-%m') AS month, CAST(m AS DATE) AS month_start, last_day(m) AS month_end FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-11-01', INTERVAL 1 MONTH)) AS m) WHERE last_day(m) <= DATE '2001-11-01'")
def month_range(s: SparkSession, d: str) -> DataFrame:
    m = s.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-11-01").cast("date"), F.expr("interval 1 month"))).alias("m"))
    return m.where(F.last_day("m") <= F.lit("2001-11-01").cast("date")).select(F.date_format("m", "yyyy-MM").alias("month"), F.col("m").alias("month_start"), F.last_day("m").alias("month_end"))


@BOOK.add("flt9_complete_runs", f"WITH {ROI}, n AS (SELECT model, seed, count(*) AS months FROM roi GROUP BY 1, 2) SELECT model, seed, months FROM n WHERE months = (SELECT max(months) FROM n)")
def complete_runs(s: SparkSession, d: str) -> DataFrame:
    n = roi(s, d).groupBy("model", "seed").agg(F.count("*").alias("months"))
    return n.join(F.broadcast(n.agg(F.max("months").alias("months"))), "months", "left_semi")


@BOOK.add("flt9_complete_dates", f"WITH {PX} SELECT date, count(*) AS n FROM px GROUP BY 1 HAVING count(*) = 6")
def complete_dates(s: SparkSession, d: str) -> DataFrame:
    return prices(s, d).groupBy("date").agg(F.count("*").alias("n")).where("n = 6")
