"""A paged feed as a Spark data source: one partition a symbol (and month), pages fetched with retries.

The fetcher is any function (symbol, cursor) -> (rows, next cursor or None), or (symbol, month, cursor) where months are asked
for; tests and offline runs hand in one that reads files.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[..., tuple[list[tuple], object]]
# Answers of a server that may be better next time.
RETRYABLE = (429, 500, 502, 503, 504)
# Days behind the start at which a series may begin, and the step beyond them.
PROBES, PROBE_STEP = (30, 180, 365, 365 * 3, 365 * 10), 365 * 5


class Refused(OSError):
    """An answer with a status that isn't success."""

    def __init__(self, status: int, body: str = "") -> None:
        super().__init__(f"status {status}: {body[:300]}")
        self.status = status

    @property
    def retryable(self) -> bool:
        return self.status in RETRYABLE


def persevere(call: Callable[[], object], retries: int = 3, pause: float = 0.5, most: float = 60.0, jitter: float = 0.25, seed: int | None = None) -> object:
    """What the call gives, tried again with growing pauses; a refusal that isn't retryable isn't tried again."""
    chance = random.Random(seed)
    for k in range(retries + 1):
        try:
            return call()
        except (OSError, ValueError) as e:
            if k == retries or isinstance(e, Refused) and not e.retryable:
                raise
            time.sleep(min(pause * 2**k, most) * (1 + jitter * chance.random()))
    return None


def fetch_json(get: Callable[[str, dict], tuple[int, str]], address: str, parameters: dict | None = None, **how) -> object:
    """The JSON of an address by `get`, which gives (status, body); an empty body is an empty list."""

    def once() -> object:
        status, body = get(address, parameters or {})
        if not 200 <= status < 300:
            raise Refused(status, body)
        return json.loads(body) if body.strip() else []

    return persevere(once, **how)


def best_effort(fetch: Callable[[str, dt.date, dt.date], list], symbol: str, start: dt.date, end: dt.date) -> list:
    """Rows of a symbol from start to end, or from the first later start at which there are any; a ValueError means none."""
    starts = [start, *(start + dt.timedelta(days=d) for d in PROBES)]
    while (later := start + dt.timedelta(days=PROBE_STEP * (len(starts) - len(PROBES)))) <= end:
        starts.append(later)
    for a in starts:
        if a > end:
            continue
        try:
            if rows := fetch(symbol, a, end):
                return rows
        except ValueError:
            continue
    return []


class Part(InputPartition):
    def __init__(self, symbol: str, month: str | None) -> None:
        super().__init__(symbol)
        self.symbol, self.month = symbol, month


class Feed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marlstone_feed"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.symbols, self.most = json.loads(options["symbols"]), int(options.get("most", "0"))
        self.months = json.loads(options.get("months", "null")) or [None]
        self.retries, self.pause = int(options.get("retries", "3")), float(options.get("pause", "0.5"))
        self.partial = options.get("partial", "false") == "true"
        self.packed = bytes.fromhex(options["fetch"])

    def partitions(self) -> list[InputPartition]:
        return [Part(s, m) for s in self.symbols for m in self.months]

    def read(self, partition: Part) -> Iterator[tuple]:
        fetch: Fetch = cloudpickle.loads(self.packed)
        where = (partition.symbol,) if partition.month is None else (partition.symbol, partition.month)
        cursor, given = None, 0
        while True:
            try:
                rows, cursor = persevere(lambda c=cursor: fetch(*where, c), self.retries, self.pause)
            except (OSError, ValueError):
                if self.partial:
                    return  # what other symbols have is kept
                raise
            for r in rows:
                if self.most and given >= self.most:
                    return
                yield r
                given += 1
            if cursor is None:
                return


def read_feed(spark: SparkSession, fetch: Fetch, symbols: list[str], schema: str, most: int = 0, retries: int = 3, pause: float = 0.5, months: list[str] | None = None, partial: bool = False) -> DataFrame:
    """Rows of all symbols' pages; `most` rows a symbol (and month) at most (0: all).

    With months, each is a partition of its own. partial: a symbol that fails in the end gives what was read of it so far.
    """
    spark.dataSource.register(Feed)
    options = {"schema": schema, "symbols": json.dumps(symbols), "months": json.dumps(months), "most": str(most), "retries": str(retries), "pause": str(pause), "partial": str(partial).lower(), "fetch": cloudpickle.dumps(fetch).hex()}
    return spark.read.format("marlstone_feed").options(**options).load()


def read_prices(spark: SparkSession, fetch: Callable[[str, dt.date, dt.date], list], tickers: list[str], start: dt.date, end: dt.date, **how) -> DataFrame:
    """(ticker, date, close) of all tickers from `fetch`, which gives (date, close) pairs; tickers that fail are left out.

    Each series starts where its listing is found to begin.
    """
    one = lambda ticker, cursor: ([(ticker, d, float(c)) for d, c in best_effort(fetch, ticker, start, end)], None)
    return read_feed(spark, one, tickers, "ticker string, date date, close double", partial=True, **how)


def search_articles(spark: SparkSession, fetch: Fetch, assets: DataFrame, months: list[str], schema: str, most: int = 20, **how) -> DataFrame:
    """(…, asset_name, asset_type): at most `most` articles of each asset and month from an index, with the asset's columns.

    assets is a dimension (ticker, asset_name, asset_type); `schema` names the ticker's column ticker.
    """
    tickers = [r.ticker for r in assets.select("ticker").distinct().limit(10_000).collect()]
    found = read_feed(spark, fetch, tickers, schema, most=most, months=months, **how)
    return found.join(assets.select("ticker", "asset_name", "asset_type"), "ticker", "left")


def fetch_pages(rows: DataFrame, url: str, fetchers: list[Callable[[str], str | None]], least: int = 100) -> DataFrame:
    """(url, html, fetched_by): each address's page by the first fetcher that gives `least` characters; null if none does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for u in part[url]:
                got = (None, None)
                for k, fetch in enumerate(fetchers):
                    try:
                        page = fetch(u)
                    except (OSError, ValueError):
                        continue
                    if page and len(page) >= least:
                        got = (page, k)
                        break
                out.append((u, *got))
            yield pd.DataFrame(out, columns=["url", "html", "fetched_by"]).astype({"fetched_by": "Int32"})

    return rows.select(url).where(F.col(url).isNotNull()).mapInPandas(run, "url string, html string, fetched_by int")
