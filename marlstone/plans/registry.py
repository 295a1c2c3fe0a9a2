"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import grid
from marlstone.plans import corpus_queries, market, relational
from marlstone.session import table
from marlstone.streaming import once


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return once.repeats(spark, f"{d}/news_item.parquet")


def p4_once(spark: SparkSession, d: str) -> DataFrame:
    return once.once(spark, f"{d}/news_item.parquet")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.weekday_grid(table(spark, d, "stock_closing_prices"), ["ticker", "venue"], "date", "close", "received_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_grid(spark, d).where("filled and value is not null").select("ticker", "venue", F.date_format("day", "yyyy-MM-dd").alias("day"))


BOOKS = (market.BOOK, corpus_queries.BOOK, relational.BOOK)


KEYED = r"""k AS (SELECT delivery_id, received_at, upper(regexp_replace(coalesce(symbol, ''), '^\s+|\s+$', '', 'g')) AS s, try_cast(CASE WHEN regexp_matches(trim(published_date), '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN trim(published_date) ELSE trim(published_date) || 'Z' END AS TIMESTAMPTZ) AS m,
 regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '\s+', '', 'g'), '[?#].*$', ''), '/+$', '') AS u0, trim(coalesce(title, '')) AS t, trim(coalesce(publisher, '')) AS p FROM news_item),
u AS (SELECT *, CASE WHEN u0 = '' THEN '' ELSE regexp_replace(lower(regexp_extract(u0, '^[A-Za-z]+://([^/]*)', 1)), '^www\.', '') || regexp_extract(u0, '^[A-Za-z]+://[^/]*(.*)$', 1) END AS page FROM k),
n AS (SELECT delivery_id, m, row_number() OVER (PARTITION BY s, m, page, CASE WHEN page = '' THEN t END, CASE WHEN page = '' THEN p END ORDER BY received_at, delivery_id) AS k FROM u)"""
USABLE = """u AS (SELECT upper(trim(ticker)) AS ticker, upper(trim(venue)) AS venue, CAST(date AS DATE) AS day FROM stock_closing_prices WHERE close IS NOT NULL AND NOT isnan(close) AND isfinite(close) AND close > 0),
g AS (SELECT ticker, venue, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM u GROUP BY 1, 2)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return market.monthly_features(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"p4_found": p4_found, "p4_once": p4_once, "p6_found": p6_found, "p6_grid": p6_grid}
    for book in BOOKS:
        out |= book.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = {
        "p4_found": f"WITH {KEYED} SELECT delivery_id FROM n WHERE k > 1 AND m IS NOT NULL",
        "p4_once": f"WITH {KEYED} SELECT * FROM news_item WHERE delivery_id NOT IN (SELECT delivery_id FROM n WHERE k > 1 AND m IS NOT NULL)",
        "p6_found": f"WITH {USABLE} SELECT ticker, venue, strftime(day, '%Y-%m-%d') AS day FROM g WHERE isodow(day) < 6 AND (ticker, venue, day) NOT IN (SELECT ticker, venue, day FROM u)",
    }
    for book in BOOKS:
        out |= book.sql
    return out
