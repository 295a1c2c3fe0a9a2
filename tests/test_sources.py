import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.engine import Engine
from marlstone.operators import policies
from marlstone.sources import feed, stores


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,date,close\nA,2020-01-01,1.5\nB,nonsense,2\nC,2020-01-02,\n")
    rows = stores.read_csv(spark, str(tmp_path / "a.csv"), "ticker string, date date, close double", ["close"])
    assert [(r.ticker, r.close) for r in rows.collect()] == [("A", 1.5)]
    (tmp_path / "a.jsonl").write_text('{"symbol": "A", "published_date": "2020-01-02"}\n\n{broken\n{"symbol": "B", "published_date": "2019-01-01"}\n')
    assert [r.symbol for r in stores.read_json_lines(spark, str(tmp_path / "a.jsonl"), since="2020-01-01").collect()] == ["A"]
    (tmp_path / "b.jsonl").write_text('{"symbol": "A", "published_date": "2020-01-02"}\n{"symbol": "C", "published_date": "soon"}\n{"symbol": "B", "published_date": "2020-01-02T10:00:00+09:00"}\n{"symbol": "D", "published_date": "2021-01-01"}\n')
    assert [r.symbol for r in stores.read_json_lines(spark, str(tmp_path / "b.jsonl"), newest_first=True).collect()] == ["D", "B", "A", "C"]


def test_csv_in_other_encodings_and_checks(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    (tmp_path / "u.csv").write_text("name,n\ncafé,1\n")
    for name in ("l", "u"):
        assert stores.read_csv(spark, str(tmp_path / f"{name}.csv"), "name string, n int").first().name == "café"
    stores.check_csv(spark, str(tmp_path / "u.csv"), ["name"])
    with pytest.raises(ValueError, match="url"):
        stores.check_csv(spark, str(tmp_path / "u.csv"), ["url"])
    (tmp_path / "e.csv").write_text("name,n\n")
    with pytest.raises(ValueError, match="no rows"):
        stores.check_csv(spark, str(tmp_path / "e.csv"), ["name"])


def test_dates_and_vendor_frames(spark):
    rows = spark.createDataFrame([("2020-01-02 00:00:00", 1.0, 3.0), ("x", 2.0, 4.0), (None, 2.0, 4.0)], "Date string, Close double, v double")
    assert [str(r.date) for r in stores.dated(rows).collect()] == ["2020-01-02"]
    with pytest.raises(ValueError, match="none of"):
        stores.dated(rows.drop("Date"))
    r = stores.flatten_ohlcv(rows, "A").first()
    assert (r.ticker, str(r.date), r.close, r.adj_close) == ("A", "2020-01-02", 1.0, 1.0)
    nested = spark.createDataFrame([("2020-01-02", (5.0, 6.0), (7.0, 8.0))], "Date string, Close struct<A:double,B:double>, `Adj Close` struct<A:double,B:double>")
    r = stores.flatten_ohlcv(nested, "B").first()
    assert (r.close, r.adj_close) == (6.0, 8.0)
    with pytest.raises(ValueError, match="neither"):
        stores.flatten_ohlcv(rows.drop("Close"), "A")


def test_atomic_sink_pages_articles_and_runs(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 2):
        stores.write_atomic(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert stores.described(spark, path) == {"id": "bigint"}
    pages = spark.createDataFrame([("A", 2020, 1, 0, "u0", "<p>x</p>"), ("A", 2020, 1, 1, "u1", "<p>y</p>"), ("B", 2020, 2, 0, "u2", None)], "asset string, year int, month int, idx int, url string, html string")
    stores.write_pages(pages, str(tmp_path / "p"))
    assert {(r.url, r.html) for r in stores.read_pages(spark, str(tmp_path / "p")).collect()} == {("u0", "<p>x</p>"), ("u1", "<p>y</p>"), ("u2", None)}
    articles = spark.createDataFrame([("A", 2020, 1, "one two"), ("A", 2020, 1, "three"), ("B", 2020, 1, 'a "b", c')], "asset string, year int, month int, text string")
    stores.write_articles(articles, str(tmp_path / "a"), mark=True)
    assert {r.text for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "a/csv")).collect()} == {"one two", "three", 'a "b", c'}
    assert {(r.asset, r.words) for r in spark.read.json(str(tmp_path / "a/stats")).collect()} == {("A", 3), ("B", 3)}
    assert {r.value for r in spark.read.text(str(tmp_path / "a/txt")).where("asset = 'A'").collect()} == {"one two", "three"}
    runs = spark.createDataFrame([("2020-01", 0.1, "ppo", 1), ("2020-01", 0.2, "sac", 2)], "month string, roi double, model string, seed int")
    runs.write.partitionBy("model", "seed").parquet(str(tmp_path / "r"))
    assert {(r.model, r.seed, r.roi) for r in stores.read_runs(spark, str(tmp_path / "r"), "month string, roi double").collect()} == {("ppo", 1, 0.1), ("sac", 2, 0.2)}


def test_labelled_set_falls_back_on_another_split(spark, tmp_path):
    spark.createDataFrame([("x", 1)], "text string, label int").write.parquet(str(tmp_path / "train"))
    assert stores.read_labelled(spark, str(tmp_path)).first().split == "train"
    with pytest.raises(ValueError, match="none of"):
        stores.read_labelled(spark, str(tmp_path), ("test",))


def test_series_store(spark, tmp_path):
    day = dt.date(2020, 1, 1)
    rows = spark.createDataFrame([("A", day, 1.0, 2.0), ("B", day, 3.0, None)], "ticker string, date date, close double, adj_close double")
    assert [r.price for r in stores.price_column(rows).orderBy("ticker").collect()] == [2.0, 3.0]
    stores.write_series(rows, str(tmp_path / "s"))
    stores.write_series(rows.where("ticker = 'B'").withColumn("close", F.lit(9.0)), str(tmp_path / "s"))
    assert {(r.ticker, r.close) for r in stores.read_series(spark, str(tmp_path / "s")).collect()} == {("A", 1.0), ("B", 9.0)}
    again = spark.createDataFrame([("C", day, 5.0, None), ("C", day, 4.0, None)], "ticker string, date date, close double, adj_close double").coalesce(1)
    again.write.partitionBy("ticker").mode("append").parquet(str(tmp_path / "s"))
    assert stores.read_series(spark, str(tmp_path / "s")).where("ticker = 'C'").first().close == 4.0  # the last, not the larger
    with pytest.raises(ValueError, match="neither"):
        stores.price_column(rows.drop("close", "adj_close"))


def test_append_unseen(spark, tmp_path):
    of = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "k string, v int")
    path = str(tmp_path / "u")
    assert [stores.append_unseen(of(*x), path, "k") for x in ("aab", "bc", "abc")] == [2, 1, 0]
    assert spark.read.parquet(path).count() == 3


def test_vectors_and_defaults(spark, tmp_path):
    v = spark.createDataFrame([("2020-01", [1.0, 2.0])], stores.VECTOR)
    stores.write_vectors(v, str(tmp_path / "v"), 2)
    assert stores.read_vectors(spark, str(tmp_path / "v"), 2).first()["values"] == [1.0, 2.0]
    with pytest.raises(ValueError, match="3 values"):
        stores.write_vectors(v, str(tmp_path / "v"), 3)
    with pytest.raises(Exception, match="hasn't 4 values"):
        stores.read_vectors(spark, str(tmp_path / "v"), 4).collect()
    assert stores.with_columns(v.select("month"), {"month": "x", "source": "s"}).first() == ("2020-01", "s")


def test_nested_links(spark, tmp_path):
    links = spark.createDataFrame([("A", "u2"), ("A", "u1")], "asset string, url string")
    stores.write_nested_links(links, str(tmp_path / "l"), ["asset"])
    r = spark.read.json(str(tmp_path / "l")).first()
    assert (r.asset, r.link_count, [x.url for x in r.links]) == ("A", 2, ["u1", "u2"])


def test_feed_pages_and_limits(spark):
    def fetch(symbol, cursor):
        k = cursor or 0
        return [(symbol, k * 2 + i) for i in range(2)], (k + 1 if k < 2 else None)

    rows = feed.read_feed(spark, fetch, ["A", "B"], "symbol string, n int", most=5)
    assert sorted((r.symbol, r.n) for r in rows.collect()) == [(s, n) for s in "AB" for n in range(5)]


def test_feed_by_months_retries_and_partial_success(spark):
    by_month = lambda symbol, month, cursor: ([(symbol, month, i) for i in range(9)], None)
    rows = feed.read_feed(spark, by_month, ["A"], "symbol string, month string, n int", most=2, months=["2020-01", "2020-02"])
    assert sorted((r.month, r.n) for r in rows.collect()) == [("2020-01", 0), ("2020-01", 1), ("2020-02", 0), ("2020-02", 1)]

    def broken(symbol, cursor):
        if symbol == "B":
            raise feed.Refused(404)
        return [(symbol, 1)], None

    assert [r.symbol for r in feed.read_feed(spark, broken, ["A", "B"], "symbol string, n int", partial=True).collect()] == ["A"]
    with pytest.raises(Exception, match="404"):
        feed.read_feed(spark, broken, ["A", "B"], "symbol string, n int").collect()
    assets = spark.createDataFrame([("A", "Alpha", "stock")], "ticker string, asset_name string, asset_type string")
    r = feed.search_articles(spark, by_month, assets, ["2020-01"], "ticker string, month string, n int", most=3)
    assert r.count() == 3 and r.first().asset_name == "Alpha"


def test_json_fetch_and_probing():
    answers = [(503, ""), (429, ""), (200, '[{"a": 1}]')]
    assert feed.fetch_json(lambda a, p: answers.pop(0), "x", pause=0.0) == [{"a": 1}] and not answers
    assert feed.fetch_json(lambda a, p: (200, " "), "x") == []
    calls = []
    with pytest.raises(feed.Refused):
        feed.fetch_json(lambda a, p: (calls.append(a), (404, "no"))[1], "x", pause=0.0)
    assert len(calls) == 1
    with pytest.raises(ValueError):
        feed.fetch_json(lambda a, p: (200, "{broken"), "x", retries=1, pause=0.0)

    listed = dt.date(2010, 5, 1)

    def fetch(symbol, a, b):
        if a < listed:
            raise ValueError("no data")
        return [(a, 1.0)]

    assert feed.best_effort(fetch, "A", dt.date(2010, 4, 10), dt.date(2020, 1, 1))[0][0] == dt.date(2010, 5, 10)
    assert feed.best_effort(fetch, "A", dt.date(1980, 1, 1), dt.date(2020, 1, 1))[0][0] > listed
    assert feed.best_effort(fetch, "A", dt.date(2000, 1, 1), dt.date(2001, 1, 1)) == []


def test_prices_and_pages(spark):
    def fetch(symbol, a, b):
        if symbol == "B":
            raise OSError("down")
        return [(a, 2)]

    day = dt.date(2020, 1, 1)
    assert [tuple(r) for r in feed.read_prices(spark, fetch, ["A", "B"], day, day, retries=0).collect()] == [("A", day, 2.0)]

    def fails(u):
        raise OSError(u)

    urls = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    got = {r.url: (r.html, r.fetched_by) for r in feed.fetch_pages(urls, "url", [fails, lambda u: "x" * 200 if u == "a" else "x", lambda u: None], least=100).collect()}
    assert got == {"a": ("x" * 200, 1), "b": (None, None)}


def test_policies_learn_the_better_ticker(spark):
    months = [f"2020-{m:02d}" for m in range(1, 13)]
    obs = spark.createDataFrame([(m, [1.0, 2.0]) for m in months] + [("2021-01", None)], "month string, values array<float>")
    rets = spark.createDataFrame([(m, t, r) for m in months for t, r in (("A", 0.05), ("B", -0.05))], "month string, ticker string, ret double")
    flat = lambda o, r, seed, steps: [[1.0, 3.0]] * len(o)
    out = policies.train(obs, rets, ["A", "B"], [("evolve", 1), ("flat", 2)], 150, {"flat": flat}).collect()
    assert len(out) == 48
    assert all(r.action == (1.0 if r.ticker == "A" else 3.0) for r in out if r.model == "flat")
    assert all(r.action > 0.6 for r in out if r.model == "evolve" and r.ticker == "A")


def test_engine(spark, data):
    e = Engine(spark, data)
    assert e.query("SELECT count(*) AS n FROM region").first().n == 5
    e.register_scorer("flat", lambda t: (F.lit("Neutral"), F.lit(0.0)))
    assert e.score(spark.createDataFrame([("x",)], "text string"), scorer="flat").first().sentiment_label == "Neutral"
    e.register_policy("first", lambda pdf: pdf.head(1))
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "run int, x int")
    assert e.act(df, "first", ["run"], "run int, x int").count() == 2
