"""Queries on the relational side: joins, sets, windows, JSON, arrays, the SQL entry point and the incremental forms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.engine import Engine
from marlstone.functions import text as T
from marlstone.operators import asof, panel
from marlstone.plans import market
from marlstone.plans.corpus_queries import S500, count_sql
from marlstone.plans.kit import Book, num, rounded
from marlstone.session import table
from marlstone.sources import stores
from marlstone.streaming import incremental

BOOK = Book()


def matching(rows: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names a pattern is found in."""
    return rows.select(*[c for c in rows.columns if re.search(pattern, c)])


@BOOK.add("src9_sql_passthrough", "SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 6) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def passthrough(s: SparkSession, d: str) -> DataFrame:
    return Engine(s, d).query("SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 6) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@BOOK.add("join6_semi", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").join(table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@BOOK.add("join7_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def anti(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@BOOK.add("join16_asof", "SELECT e.event_id, coalesce(p.event_id, -1) AS purchase_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'")
def as_of(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return asof.as_of(e.where("event_type = 'view'"), right, ["user_id"], "ts", ["purchase_id"]).select("event_id", F.coalesce("purchase_id", F.lit(-1)).alias("purchase_id"))


@BOOK.add("join16_interval", "SELECT a.event_id, count(b.event_id) AS near FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts AND b.event_id <> a.event_id WHERE a.event_type = 'error' GROUP BY 1")
def interval(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    return asof.within(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("at")), ["user_id"], "ts", "at", 3600).where("other is null or other <> event_id").groupBy("event_id").agg(F.count("other").alias("near")).unionByName(
        e.where("event_type = 'error'").select("event_id", F.lit(0).cast("bigint").alias("near"))
    ).groupBy("event_id").agg(F.max("near").alias("near"))


@BOOK.add("set5_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey"))


@BOOK.add("set5_except_all", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity < 5")
def except_all(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    return li.where("l_quantity > 45").select(F.col("l_suppkey").alias("k")).exceptAll(li.where("l_quantity < 5").select("l_suppkey"))


@BOOK.add("set1_union_by_name", "SELECT doc_id AS id, text, NULL AS title FROM documents UNION ALL SELECT delivery_id, text, title FROM news_item")
def union(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(s, d, "news_item").select(F.col("delivery_id").alias("id"), "text", "title"), allowMissingColumns=True)


@BOOK.add("agg32_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(s: SparkSession, d: str) -> DataFrame:
    return rounded(table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total")), 2)


@BOOK.add("agg32_rollup", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))")
def rollup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).rollup("event_type", "day").agg(F.count("*").alias("n"))


@BOOK.add("agg32_approx_distinct", "SELECT count(DISTINCT l_partkey) AS exact_parts, true AS near FROM lineitem")
def approx(s: SparkSession, d: str) -> DataFrame:
    """The sketch's estimate, three times its standard error from the exact number at most."""
    n = table(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.countDistinct("l_partkey").alias("exact_parts"))
    return n.select("exact_parts", (F.abs(F.col("parts") / F.col("exact_parts") - 1) <= 0.06).alias("near"))


@BOOK.add("win20_ranks", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS q, round(percent_rank() OVER w, 6) AS pr, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def ranks(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rounded(table(s, d, "customer").select("c_custkey", num(F.rank().over(w)).alias("r"), num(F.dense_rank().over(w)).alias("dr"), num(F.ntile(4).over(w)).alias("q"), F.percent_rank().over(w).alias("pr"), F.nth_value("c_custkey", 2).over(whole).alias("second")))


@BOOK.add("json1_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@BOOK.add("json2_emit", "SELECT CAST(to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name)) AS VARCHAR) AS json FROM nation")
def emit_json(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))


@BOOK.add("src28_nested_links", "SELECT file_name, count(*) AS link_count, array_to_string(list_sort(list(id)), ',') AS ids FROM (SELECT DISTINCT id, file_name FROM social_post WHERE contains(text, 'http')) GROUP BY 1")
def nested(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "social_post").where(F.contains("text", F.lit("http"))).select("id", "file_name").distinct()
    return p.groupBy("file_name").agg(F.count("*").alias("link_count"), F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@BOOK.add("arr1_vectors", "SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))), 6) AS head_sum FROM embeddings")
def vectors(s: SparkSession, d: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return rounded(table(s, d, "embeddings").select("vec_id", num(F.size("embedding")).alias("n"), F.element_at("embedding", 1).cast("double").alias("first_value"), F.aggregate(v, F.lit(0.0), lambda a, b: a + b).alias("head_sum")))


@BOOK.add("flt10_hash_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id LIMIT 100")
def sample(s: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: a sample of 100 by seed."""
    return table(s, d, "documents").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42"))), "doc_id").select("doc_id").limit(100)


@BOOK.add("math1_scalar", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS a, round(exp(l_discount), 6) AS b, round(pow(1 + l_tax, 12), 6) AS c, round(sqrt(l_quantity), 6) AS d FROM lineitem")
def scalar(s: SparkSession, d: str) -> DataFrame:
    return rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.ln("l_extendedprice").alias("a"), F.exp("l_discount").alias("b"), F.pow(1 + F.col("l_tax"), F.lit(12.0)).alias("c"), F.sqrt("l_quantity").alias("d")))


@BOOK.add("date3_5_6_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before FROM orders")
def date_parts(s: SparkSession, d: str) -> DataFrame:
    o = F.to_date("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", F.year(o).alias("y"), F.month(o).alias("m"), F.date_format(F.last_day(o), "yyyy-MM-dd").alias("month_end"), F.date_format(F.date_sub(o, 1), "yyyy-MM-dd").alias("day_before"))


@BOOK.add("topk1_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(20)


@BOOK.add("star_join_revenue", "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def star(s: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(s, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(j.groupBy("r_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")), 2)


@BOOK.add("stream1_unseen_articles", r"SELECT message, min(delivery_id) AS delivery_id FROM (SELECT delivery_id, md5(concat_ws('|', upper(trim(coalesce(symbol, ''))), coalesce(title, ''))) AS message FROM news_item) GROUP BY 1")
def stream_unseen(s: SparkSession, d: str) -> DataFrame:
    return incremental.unseen_articles(s, f"{d}/news_item.parquet")


@BOOK.add("stream5_monthly_sentiment", f"WITH q AS (SELECT strftime(received_at, '%Y-%m') AS month, trim({S500}) = '' AS blank, {count_sql(S500, T.POSITIVE)} AS p, {count_sql(S500, T.NEGATIVE)} AS m FROM social_post WHERE received_at IS NOT NULL) SELECT month, count(*) AS n, round(sum(CASE WHEN blank OR p = m THEN 0.0 ELSE (p - m) / (p + m) END) / nullif(count(*) FILTER (NOT blank AND p <> m), 0), 6) AS average_score FROM q GROUP BY 1")
def stream_months(s: SparkSession, d: str) -> DataFrame:
    return rounded(incremental.monthly_sentiment(s, f"{d}/social_post.parquet"))


@BOOK.add("stream2_upsert_series", "SELECT ticker, day, max_by(close, received_at) AS close FROM (SELECT upper(trim(ticker)) || ':' || upper(trim(venue)) AS ticker, CAST(date AS DATE) AS day, max_by(close, (received_at, close)) AS close, max(received_at) AS received_at FROM stock_closing_prices WHERE close > 0 AND isfinite(close) GROUP BY 1, 2) GROUP BY 1, 2")
def stream_upsert(s: SparkSession, d: str) -> DataFrame:
    return incremental.upsert_series(s, f"{d}/stock_closing_prices.parquet")


@BOOK.add("stream4_request_gaps", "SELECT event_id, user_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), -1) AS gap_us FROM events")
def request_gaps(s: SparkSession, d: str) -> DataFrame:
    return incremental.spacing(s, f"{d}/events.parquet")


@BOOK.add("map1_functions", "SELECT file_name, string_agg(CAST(month AS VARCHAR), ',' ORDER BY month) AS months, CAST(sum(n) AS BIGINT) AS posts, CAST(max(n) FILTER (month = 1) AS BIGINT) AS january FROM (SELECT file_name, CAST(month AS INTEGER) AS month, count(*) AS n FROM social_post WHERE month IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def maps(s: SparkSession, d: str) -> DataFrame:
    by = table(s, d, "social_post").where("month is not null").groupBy("file_name", F.col("month").cast("int").alias("month")).agg(F.count("*").alias("n"))
    m = by.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("m"))
    return m.select("file_name", F.array_join(F.array_sort(F.map_keys("m")).cast("array<string>"), ",").alias("months"), F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("posts"), F.try_element_at("m", F.lit(1)).alias("january"))


@BOOK.add("prj3_prj5_columns", "SELECT * EXCLUDE (l_suppkey) FROM (SELECT COLUMNS('^l_.*key$') FROM lineitem)")
def columns(s: SparkSession, d: str) -> DataFrame:
    return matching(table(s, d, "lineitem"), "^l_.*key$").drop("l_suppkey")


@BOOK.add("date2_coerced_dates", "SELECT delivery_id, strftime(try_cast(substring(trim(published_date), 1, 10) AS DATE), '%Y-%m-%d') AS day FROM news_item WHERE try_cast(substring(trim(published_date), 1, 10) AS DATE) IS NOT NULL AND regexp_matches(trim(published_date), '^[0-9]{4}-[0-9]{2}-[0-9]{2}')")
def coerced(s: SparkSession, d: str) -> DataFrame:
    n = stores.dated(table(s, d, "news_item"), ("Date", "published_date"))
    return n.select("delivery_id", F.date_format("date", "yyyy-MM-dd").alias("day"))


@BOOK.add("date6_month_difference", "SELECT o_orderkey, CAST((1998 - year(o_orderdate)) * 12 + (12 - month(o_orderdate)) AS BIGINT) AS months FROM orders")
def month_difference(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", num(F.months_between(F.lit("1998-12-01").cast("date"), F.trunc(F.to_date("o_orderdate"), "month"))).alias("months"))


@BOOK.add("win19_ema", "WITH RECURSIVE m AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS DOUBLE) AS n, row_number() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y-%m-%d')) AS k FROM events GROUP BY 1, 2), e AS (SELECT event_type, day, k, n AS ema FROM m WHERE k = 1 UNION ALL SELECT m.event_type, m.day, m.k, 0.4 * m.n + 0.6 * e.ema FROM e JOIN m ON m.event_type = e.event_type AND m.k = e.k + 1) SELECT event_type, day, round(ema, 6) AS ema FROM e")
def moving_average(s: SparkSession, d: str) -> DataFrame:
    daily = table(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return rounded(panel.ema(daily, ["event_type"], "day", "n", 4).select("event_type", "day", "ema"))


@BOOK.add("math6_capital_cost", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity / (l_quantity + 50.0) * l_tax + 50.0 / (l_quantity + 50.0) * l_discount * (1 - 0.25) AS FLOAT) AS wacc FROM lineitem")
def capital_cost(s: SparkSession, d: str) -> DataFrame:
    equity, debt = F.col("l_quantity").cast("double"), F.lit(50.0)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", panel.wacc(equity, debt, F.col("l_tax"), F.col("l_discount"), 0.25).cast("float").alias("wacc"))


@BOOK.add("json1_objects_only", "SELECT event_id FROM events WHERE json_type(props) = 'OBJECT'")
def objects_only(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where(F.substring(F.ltrim(F.try_parse_json("props").cast("string")), 1, 1) == "{").select("event_id")


@BOOK.add("math5_random_vectors", None)
def random_vectors(s: SparkSession, d: str) -> DataFrame:
    """prj10: the volatilities of each month's tickers and as many seeded uniform values."""
    return panel.with_random(market.observations(s, d), seed=42)


@BOOK.add("src2_split_keep_first", "SELECT ticker, date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY part) AS n FROM (SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close, 0 AS part FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-06-01' GROUP BY 1, 2 UNION ALL SELECT l_returnflag, CAST(l_shipdate AS DATE), min(l_extendedprice), 1 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' GROUP BY 1, 2)) WHERE n = 1")
def split_fetch(s: SparkSession, d: str) -> DataFrame:
    by = [F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("date")]
    li = table(s, d, "lineitem")
    early = li.where("l_shipdate <= timestamp'1995-06-01'").groupBy(*by).agg(F.max("l_extendedprice").alias("close"))
    late = li.where("l_shipdate >= timestamp'1995-06-01'").groupBy(*by).agg(F.min("l_extendedprice").alias("close"))
    return panel.first_wins(early, late, keys=["ticker", "date"])


@BOOK.add("src31_variant_links", "SELECT asset_name, count(DISTINCT id) AS posts FROM social_post JOIN asset_dim ON ticker = regexp_extract(file_name, '^([^_]+)_', 1) GROUP BY 1")
def variant_links(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "social_post").select("id", F.regexp_extract("file_name", "^([^_]+)_", 1).alias("ticker"))
    return p.join(F.broadcast(table(s, d, "asset_dim").select("ticker", "asset_name")), "ticker").groupBy("asset_name").agg(F.countDistinct("id").alias("posts"))


@BOOK.add("udtf_post_links", rf"SELECT DISTINCT id, unnest(regexp_extract_all(text, 'https?://[^{T.WS}]+')) AS url FROM social_post WHERE text IS NOT NULL")
def link_function(s: SparkSession, d: str) -> DataFrame:
    return Engine(s, d).query("SELECT DISTINCT id, url FROM social_post, LATERAL text_links(text) WHERE text IS NOT NULL")


@BOOK.add("prj4_identity_columns", "SELECT doc_id, 'documents' AS origin, 1 AS version FROM documents")
def identity(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.lit("documents").alias("origin"), F.lit(1).alias("version"))


@BOOK.add("sort1_by_date", "SELECT ticker, venue, strftime(date, '%Y-%m-%d %H:%M:%S.%f') AS at, row_number() OVER (PARTITION BY ticker, venue ORDER BY date, received_at, close NULLS FIRST, volume NULLS FIRST) AS place FROM stock_closing_prices")
def by_date(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "stock_closing_prices")
    place = F.row_number().over(Window.partitionBy("ticker", "venue").orderBy("date", "received_at", F.asc_nulls_first("close"), F.asc_nulls_first("volume")))
    return p.select("ticker", "venue", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), num(place).alias("place"))
