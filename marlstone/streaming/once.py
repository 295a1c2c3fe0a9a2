"""Exactly one copy of every message that was delivered at least once.

A streaming aggregation keeps one state entry for each identifier: its first delivery so far. The entries are in the session's
keyed state store (RocksDB), read and written as deliveries arrive for them, and given up when the watermark passes the message's own event
time, which is part of its identifier. What a batch has settled is written as that batch's part of the ledger, over what an
interrupted run of the same batch has left, and the stream's checkpoint commits both: a run that starts at the same folder goes
on where the last one ended. A delivery that is late by the watermark isn't taken into the state, as its identifier may have
been given up; it is looked up in the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import web
from marlstone.session import shared_path
from marlstone.streaming.incremental import drain, source

LEDGER = "message string, moment timestamp, received_at timestamp, delivery_id bigint, deliveries bigint, batch bigint"


def keyed(news: DataFrame) -> DataFrame:
    """(delivery_id, received_at, moment, message): the identifier of each delivery's message.

    It is the digest of symbol, moment and page, or of symbol, title, publisher and moment where there is no address. A
    delivery without readable moment agrees with no other; it and deliveries without id are left out.
    """
    page = web.page(F.col("url"))
    symbol, moment = web.symbol(F.col("symbol")), web.moment(F.col("published_date"))
    by = F.when(page != "", F.concat_ws("\x1f", F.lit("page"), symbol, page)).otherwise(F.concat_ws("\x1f", F.lit("title"), symbol, web.clean(F.col("title")), web.clean(F.col("publisher"))))
    return (
        news.select("delivery_id", F.col("received_at").cast("timestamp").alias("received_at"), moment.alias("moment"), by.alias("by"))
        .where(F.col("moment").isNotNull() & F.col("delivery_id").isNotNull())
        .select("delivery_id", F.coalesce("received_at", F.lit("9999-01-01").cast("timestamp")).alias("received_at"), "moment", F.md5(F.concat_ws("\x1f", "by", F.unix_micros("moment").cast("string"))).alias("message"))
    )


def ledger(arriving: DataFrame, path: str, delay: str = "14 days") -> DataFrame:
    """Runs the stream of keyed deliveries to its present end; the firsts at `path`, as each batch has settled them.

    A message has a row for each batch that brought deliveries of it; the last one holds.
    """
    spark = arriving.sparkSession
    first = F.min(F.struct("received_at", "delivery_id")).alias("first")
    firsts = arriving.withWatermark("moment", delay).groupBy("message", "moment").agg(first, F.count("*").alias("deliveries")).select("message", "moment", "first.*", "deliveries")

    def settled(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    drain(firsts, settled, f"{path}/progress", "update")
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def judged(deliveries: DataFrame, book: DataFrame) -> DataFrame:
    """(message, delivery_id, received_at, repeat) of keyed deliveries by the ledger.

    A delivery behind the first of its message is a repeat. One that the ledger doesn't account for, as its message isn't
    there or its first is a later delivery, was late for the state; such deliveries are compared with each other.
    """
    order = F.struct("received_at", "delivery_id")
    firsts = book.groupBy("message").agg(F.min(order).alias("first"))
    both = deliveries.join(firsts, "message", "left")
    late = F.col("first").isNull() | (order < F.col("first"))
    earlier = both.where(late).groupBy("message").agg(F.min(order).alias("earlier"))
    return both.join(earlier, "message", "left").select("message", "delivery_id", "received_at", (order != F.coalesce("earlier", "first")).alias("repeat"))


def repeats(spark: SparkSession, place: str, delay: str = "14 days", files_per_batch: int = 8, path: str | None = None) -> DataFrame:
    """(delivery_id): the deliveries of a message other than its first, from the files at `place`.

    The first is the earliest received, of equals the one of smallest id; order of arrival in the files doesn't matter. An
    empty table gives no rows; a delivery without received_at counts as the last. `path` is where state and ledger are kept;
    a later run with the same path reads only files it hasn't seen. Without it they are new.
    """
    stored = spark.read.parquet(place)
    book = ledger(keyed(source(spark, place, files_per_batch)), path or shared_path(spark, "once"), delay)
    return judged(keyed(stored), book).where("repeat").select("delivery_id").distinct()


def once(spark: SparkSession, place: str, **how) -> DataFrame:
    """The stored rows with one delivery of each message: all but the repeats."""
    return spark.read.parquet(place).join(repeats(spark, place, **how), "delivery_id", "left_anti")
