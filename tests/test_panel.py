import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import asof, panel, portfolio

DAYS = pd.date_range("2020-01-28", periods=9).date


def frame(spark, **series):
    rows = [(t, d, v) for t, values in series.items() for d, v in zip(DAYS, values)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def closes(df, ticker="A", column="close"):
    return [r[column] for r in df.where(F.col("ticker") == ticker).orderBy("date").collect()]


def test_fill_is_backward_then_carried(spark):
    n = None
    px = frame(spark, A=[n, 1.0, n, n, 4.0, n, 7.0, n, n])
    assert closes(panel.fill(px, ["A"])) == [1, 1, 4, 4, 4, 7, 7, 7, 7]


def test_fill_before_align_leaves_calendar_gaps(spark):
    px = frame(spark, A=[1.0, None, 3.0]).unionByName(frame(spark, B=[1.0] * 5))
    assert closes(panel.fill(px, ["A", "B"], "before_align")) == [1, 3, 3, None, None]


def test_interpolation_matches_pandas(spark):
    values = [None, 1.0, None, None, 4.0, None, 7.0, None, None]
    want = pd.Series(values, dtype=float).interpolate("linear", limit_direction="both").tolist()
    assert closes(panel.interpolate(frame(spark, A=values))) == pytest.approx(want)


def test_rebase_needs_a_positive_start(spark):
    out = panel.rebase(frame(spark, A=[2.0, 4.0], B=[-1.0, 3.0], C=[None, 5.0]))
    assert closes(out, "A", "rebased") == [1, 2] and closes(out, "B", "rebased") == [None, None] and closes(out, "C", "rebased") == [None, 1]
    assert closes(out, "A", "log_evolution") == pytest.approx([0, math.log(2)])


def test_month_returns_drop_dates_listwise(spark):
    px = frame(spark, A=[1.0, 2.0, 4.0, 8.0], B=[1.0, None, 1.0, 2.0])
    rows = panel.month_returns(panel.dense(px, ["A", "B", "C"])).collect()
    # B has no return on the second and third day, so A has none there either; C has no price at all
    assert {(r.ticker, r.date) for r in rows} == {("A", DAYS[3]), ("B", DAYS[3])}


def test_monthly_features_match_numpy(spark):
    rng = np.random.default_rng(1)
    p = np.exp(np.cumsum(rng.normal(0, 0.02, 4)))
    r = panel.monthly_features(frame(spark, A=[float(x) for x in p])).where("month = '2020-01'").first()
    ret = np.diff(np.log(p))
    assert r.volatility == pytest.approx(ret.std(ddof=1) * math.sqrt(252))
    assert r.sharpe_ratio == pytest.approx(ret.mean() * 252 / (ret.std(ddof=1) * math.sqrt(252)))
    assert r.sortino_ratio == pytest.approx(ret.mean() * 252 / (np.where(ret < 0, ret, 0).std(ddof=1) * math.sqrt(252)))
    assert r.mdd == pytest.approx(((np.maximum.accumulate(p) - p) / np.maximum.accumulate(p)).max())


def test_flat_and_short_months_have_no_ratios(spark):
    r = panel.monthly_features(frame(spark, A=[3.0, 3.0, 3.0])).first()
    assert r.sharpe_ratio is None and r.calmar_ratio is None and r.mdd == 0
    assert panel.monthly_features(frame(spark, A=[3.0])).first().volatility is None
    assert panel.monthly_features(frame(spark)).count() == 0


def test_weights(spark):
    rows = spark.createDataFrame([("m", "A", 0.0), ("m", "B", 0.0)], "k string, ticker string, action double")
    assert [r.weight for r in portfolio.sum_weights(rows, ["k"], 2).collect()] == [0.5, 0.5]
    assert [r.weight for r in portfolio.softmax_weights(rows, ["k"]).collect()] == [0.5, 0.5]


def test_month_end_day_is_in_two_windows(spark):
    got = {(r.date.isoformat(), r.window_month) for r in panel_windows(spark).collect()}
    assert ("2020-01-31", "2020-01") in got and ("2020-01-31", "2020-02") in got and ("2020-02-01", "2020-01") not in got


def panel_windows(spark):
    return portfolio.month_windows(frame(spark, A=[1.0] * 9))


def test_scorecard_and_rolling(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0.01, 0.05, 20)
    df = spark.createDataFrame([("s", f"20{18 + i // 12}-{i % 12 + 1:02d}", float(x)) for i, x in enumerate(r)], "k string, month string, roi double")
    card = portfolio.scorecard(df, ["k"]).first()
    total = np.prod(1 + r) - 1
    assert card.total_return == pytest.approx(total)
    assert card.sharpe_ratio == pytest.approx(((1 + total) ** (12 / 20) - 1) / (r.std() * math.sqrt(12)))
    cum = np.cumprod(1 + r)
    assert card.max_drawdown == pytest.approx(((np.maximum.accumulate(cum) - cum) / np.maximum.accumulate(cum)).max())
    roll = portfolio.rolling_sharpe(df, ["k"]).orderBy("month").collect()
    assert len(roll) == 8 and roll[0].rolling_sharpe == pytest.approx(r[:12].mean() * 12 / (r[:12].std() * math.sqrt(12)))


def test_as_of_and_within(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("c", 1, 1)], "k string, t int, v int")
    got = {(r.k, r.t, r.v) for r in asof.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 1, None), ("a", 5, 50), ("b", 5, None), (None, 5, None)}
