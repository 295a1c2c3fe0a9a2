import datetime as dt

from marlstone.operators import grid
from marlstone.streaming import incremental, once

READ = "ticker string, venue string, date timestamp_ntz, close double, received_at timestamp_ntz, day int, value string"


def at(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def readings(spark, rows):
    return spark.createDataFrame([(t, v, d, c, r, 7, "x") for t, v, d, c, r in rows], READ)


def on_grid(df):
    return {(r.ticker, r.venue, r.day.day): (r.value, r.filled) for r in grid.weekday_grid(df, ["ticker", "venue"], "date", "close", "received_at").collect()}


def test_grid_fills_weekdays_between_usable_readings(spark):
    # 2024-01-01 is a Monday
    rows = [(" abc", "V", at(1), 10.0, at(1)), ("ABC", "v ", at(3), 12.0, at(3)), ("ABC", "V", at(2), float("nan"), at(2)), ("ABC", "V", at(4), -1.0, at(4)), ("ABC", "V", at(6), 14.0, at(6)), ("ABC", "V", at(8), 15.0, at(8)), ("ABC", "V", None, 15.0, at(8)), (None, None, at(2), 3.0, at(2))]
    got = on_grid(readings(spark, rows))
    assert {k for k in got if k[0] == "ABC"} == {("ABC", "V", d) for d in (1, 2, 3, 4, 5, 8)}
    assert {k[2] for k, v in got.items() if v[1]} == {2, 4, 5}
    assert 10 < got["ABC", "V", 2][0] < 12 and 12 < got["ABC", "V", 5][0] < 14
    assert got["", "", 2] == (3.0, False)


def test_grid_takes_the_last_restated_reading(spark):
    rows = [("A", "V", at(1), 10.0, at(1)), ("A", "V", at(1), 11.0, at(2)), ("A", "V", at(1), 11.0, at(2)), ("A", "V", at(1, 9), 99.0, at(9))]
    assert on_grid(readings(spark, rows)) == {("A", "V", 1): (11.0, False)}


def test_grid_of_nothing_and_of_a_weekend(spark):
    assert on_grid(readings(spark, [])) == {}
    assert on_grid(readings(spark, [("A", "V", at(6), 1.0, at(6))])) == {}


NEWS = "delivery_id bigint, batch_id bigint, received_at timestamp_ntz, symbol string, published_date string, publisher string, title string, image string, site string, text string, url string"


def item(i, received, url, moment="2024-01-01 10:00:00", symbol="ABC", title="t", publisher="p"):
    return (i, 1, received, symbol, moment, publisher, title, None, None, "text", url)


def found(spark, tmp_path, *files, **how):
    for rows in files:
        spark.createDataFrame(rows, NEWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    return {r.delivery_id for r in once.repeats(spark, f"{tmp_path}/t.parquet", files_per_batch=1, **how).collect()}


def test_same_message_in_many_spellings(spark, tmp_path):
    rows = [
        item(5, at(1), "https://www.x.example/a"), item(2, at(1, 13), " HTTPS://WWW.X.example/a#r\n", "2024-01-01T12:00:00+02:00", " abc"), item(3, at(2), "https://x.example/a?utm_source=q&utm_medium=z", "2024-01-01T10:00:00.000Z"),
        item(4, at(2), "https://x.example/a?id=1"), item(6, at(2), "https://x.example/a", symbol="B"), item(7, at(2), "https://x.example/a", "2024-01-01 10:00:01"), item(8, at(2), "https://x.example/a", "n/a"), item(9, at(3), "https://x.example/a", "n/a"),
        item(10, at(3), ""), item(11, at(3), None), item(12, at(3), " ", title="u"), item(None, at(3), "https://x.example/a"),
    ]
    assert found(spark, tmp_path, rows) == {2, 3, 11}


def test_first_is_the_earliest_over_batches_and_late_ones_are_looked_up(spark, tmp_path):
    old, new = "2024-01-01 10:00:00", "2024-06-01 10:00:00"
    files = [
        [item(10, at(5), "https://x.example/a", old)],
        [item(9, at(4), "https://x.example/a", old), item(11, at(5), "https://x.example/a", old)],
        [item(20, at(20), "https://x.example/b", new)],
        [item(21, at(21), "https://x.example/c", new)],
        [item(30, at(25), "https://x.example/a", old), item(31, at(3), "https://x.example/a", old), item(32, at(25), "https://x.example/z", old), item(33, at(25), "https://x.example/z", old)],
    ]
    assert found(spark, tmp_path, *files) == {9, 10, 11, 30, 33}


def test_ties_take_the_smallest_id_and_an_empty_table_gives_nothing(spark, tmp_path):
    assert found(spark, tmp_path / "a", [item(7, at(1), "https://x.example/a"), item(3, at(1), "https://x.example/a")]) == {7}
    assert found(spark, tmp_path / "b", []) == set()


def test_a_delivery_without_receipt_is_the_last(spark, tmp_path):
    rows = [item(1, None, "https://x.example/a"), item(2, at(2), "https://x.example/a"), item(3, None, "https://x.example/b"), item(4, None, "https://x.example/b"), item(5, at(1), "https://x.example/c")]
    assert found(spark, tmp_path, rows) == {1, 4}


def test_hot_message(spark, tmp_path):
    rows = [item(i, at(1), "https://x.example/a") for i in range(500)] + [item(1000 + i, at(1), f"https://x.example/{i}") for i in range(500)]
    assert found(spark, tmp_path, rows) == set(range(1, 500))
    assert once.once(spark, f"{tmp_path}/t.parquet").count() == 501


def test_a_stopped_run_goes_on_and_expired_messages_leave_the_state(spark, tmp_path):
    place, path = f"{tmp_path}/t.parquet", f"{tmp_path}/kept"
    add = lambda *rows: spark.createDataFrame([*rows], NEWS).coalesce(1).write.mode("append").parquet(place)
    run = lambda: {r.delivery_id for r in once.repeats(spark, place, files_per_batch=1, path=path).collect()}
    batches = lambda: {r.batch: r.n for r in spark.read.parquet(f"{path}/ledger").groupBy("batch").count().withColumnRenamed("count", "n").collect()}
    old, new = "2024-01-01 10:00:00", "2024-06-01 10:00:00"
    add(item(10, at(5), "https://x.example/a", old), item(11, at(6), "https://x.example/a", old))
    assert run() == {11}
    before = batches()
    add(item(9, at(4), "https://x.example/a", old))
    assert run() == {10, 11}
    assert {k: n for k, n in batches().items() if k in before} == before  # what was settled isn't read again
    add(item(20, at(20), "https://x.example/b", new))
    run()
    add(item(21, at(21), "https://x.example/b", new))
    arriving = once.keyed(once.source(spark, place, 1))
    progress = []
    drain = once.drain
    once.drain = lambda *a: progress.extend(p for p in drain(*a).recentProgress)
    try:
        once.ledger(arriving, path)
    finally:
        once.drain = drain
    removed = sum(o["numRowsRemoved"] for p in progress for o in p["stateOperators"])
    assert removed == 0 and progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # only the message within the watermark is held
    add(item(30, at(25), "https://x.example/a", old), item(8, at(1), "https://x.example/a", old))
    assert run() == {9, 10, 11, 30, 21}


def test_streams_go_on_where_they_ended(spark, tmp_path):
    place = f"{tmp_path}/n.parquet"
    news = lambda *rows: spark.createDataFrame([*rows], NEWS).coalesce(1).write.mode("append").parquet(place)
    unseen = lambda: {r.delivery_id for r in incremental.unseen_articles(spark, place, f"{tmp_path}/u", 1).collect()}
    news(item(5, at(1), "u", title="a"), item(6, at(1), "u", title="a"), item(7, at(1), "u", title=None))
    assert unseen() == {5, 7}
    news(item(1, at(2), "u", title="a"), item(2, at(2), "u", title="b"))
    assert unseen() == {2, 5, 7} and unseen() == {2, 5, 7}

    prices = f"{tmp_path}/p.parquet"
    rows = lambda *r: readings(spark, [*r]).coalesce(1).write.mode("append").parquet(prices)
    series = lambda: {(r.ticker, r.day.day): r.close for r in incremental.upsert_series(spark, prices, f"{tmp_path}/s", 1).collect()}
    rows(("A", "V", at(1), 1.0, at(1)), ("A", "V", at(2), 2.0, at(9)), ("A", "V", at(3), None, at(3)))
    assert series() == {("A:V", 1): 1.0, ("A:V", 2): 2.0}
    rows((" a", "v", at(1), 5.0, at(4)), ("A", "V", at(2), 7.0, at(3)), ("B", "V", at(4), 4.0, at(4)))
    assert series() == {("A:V", 1): 5.0, ("A:V", 2): 2.0, ("B:V", 4): 4.0}

    events = f"{tmp_path}/e.parquet"
    more = lambda *r: spark.createDataFrame([*r], "event_id bigint, user_id bigint, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(events)
    gaps = lambda: {r.event_id: r.gap_us // 3_600_000_000 for r in incremental.spacing(spark, events, f"{tmp_path}/g", 1).collect()}
    more((1, 1, at(1, 1)), (2, 1, at(1, 4)), (3, 2, at(1, 2)), (4, None, at(1)), (5, 2, None))
    assert gaps() == {1: -1, 2: 3, 3: -1}
    more((6, 1, at(1, 9)), (7, 3, at(1, 9)))
    assert gaps() == {1: -1, 2: 3, 3: -1, 6: 5, 7: -1}

    posts = f"{tmp_path}/m.parquet"
    post = lambda *r: spark.createDataFrame([*r], "id bigint, text string, received_at timestamp_ntz").coalesce(1).write.mode("append").parquet(posts)
    months = lambda: {r.month: (r.n, r.average_score) for r in incremental.monthly_sentiment(spark, posts, f"{tmp_path}/n", 1).collect()}
    post((1, "prices rise", at(1)), (2, "prices fall", at(2)), (3, None, at(3)), (4, "rise", None))
    assert months() == {"2024-01": (3, 0.0)}
    post((5, "gain", at(2)), (6, "flat", dt.datetime(2024, 2, 1)))
    assert months() == {"2024-01": (4, 1 / 3), "2024-02": (1, None)}


def test_filled_values_are_near_held_out_ones(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from marlstone.session import table

    prices = table(spark, "/root/testdata/sf0.01", "stock_closing_prices")
    keys = ["ticker", "venue"]
    days = grid.daily(prices, keys, "date", "close", "received_at")
    ends = Window.partitionBy(*keys)
    inner = days.withColumn("a", F.min("day").over(ends)).withColumn("b", F.max("day").over(ends)).where("day > a and day < b and weekday(day) < 5")
    hidden = inner.where(F.pmod(F.xxhash64("ticker", "venue", "day"), F.lit(10)) == 0).select(*keys, "day", F.col("value").alias("truth"))
    left = days.join(hidden, [*keys, "day"], "left_anti").select(*keys, F.col("day").cast("timestamp").alias("date"), F.col("value").alias("close"), F.col("day").cast("timestamp").alias("received_at"))
    before = left.select(*keys, F.to_date("date").alias("day"), "close").unionByName(hidden.select(*keys, "day", F.lit(None).cast("double").alias("close")))
    carried = before.withColumn("carried", F.last("close", True).over(Window.partitionBy(*keys).orderBy("day"))).where("close is null").select(*keys, "day", "carried")
    both = grid.weekday_grid(left, keys, "date", "close", "received_at").join(hidden, [*keys, "day"]).join(carried, [*keys, "day"])
    off = lambda c: F.median(F.abs(F.ln(F.col(c) / F.col("truth")))).alias(c)
    r = both.where("filled").agg(off("value"), off("carried"), F.count("*").alias("n")).first()
    print(r)
    assert r.n > 300 and r.value < r.carried and r.value < 0.05
