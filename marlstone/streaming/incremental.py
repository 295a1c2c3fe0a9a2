"""Incremental forms of batch steps: each runs what has arrived since the last run and stops.

`root` is the folder of a step's progress, state and store. A run with the same root goes on where the last one ended; what an
interrupted run has written for a batch is written over by the same batch. Without a root the step starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marlstone.functions import web
from marlstone.operators import corpus
from marlstone.session import shared_path

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, place: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the table's files, a single file or a folder of them."""
    folder, _, name = place.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(place)
    return reader.option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], progress: str, mode: str = "append") -> StreamingQuery:
    """Runs the stream to its present end, handing every batch to `each`; progress is kept for the next run, state in RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
    query.awaitTermination()
    return query


def unseen_articles(spark: SparkSession, place: str, root: str | None = None, files_per_batch: int = 8) -> DataFrame:
    """(message, delivery_id): the delivery that came first of each symbol and title, of one batch the smallest.

    A batch's messages are looked up in the store of what was seen before, and only those that aren't there are appended.
    """
    root = root or shared_path(spark, "unseen")
    stored = lambda: spark.read.schema("message string, delivery_id bigint, batch bigint").parquet(f"{root}/seen")

    def append(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("message").agg(F.min("delivery_id").alias("delivery_id"))
        if number:
            new = new.join(stored().where(F.col("batch") < number).select("message"), "message", "left_anti")
        new.write.mode("overwrite").parquet(f"{root}/seen/batch={number}")

    rows = source(spark, place, files_per_batch).select("delivery_id", F.md5(F.concat_ws("|", F.upper(F.trim(F.coalesce("symbol", F.lit("")))), F.coalesce("title", F.lit("")))).alias("message"))
    drain(rows, append, f"{root}/progress")
    return stored().select("message", "delivery_id")


def monthly_sentiment(spark: SparkSession, place: str, root: str | None = None, files_per_batch: int = 8, delay: str = "14 days") -> DataFrame:
    """(month, n, average_score): posts and signed average score of each month of arrival, by days.

    The state holds the days the watermark hasn't passed; a post that arrives later than that isn't counted. Posts without
    received_at are left out.
    """
    root = root or shared_path(spark, "months")
    label, score = corpus.lexicon_label(F.col("text"))
    rows = source(spark, place, files_per_batch).select(F.col("received_at").cast("timestamp").alias("at"), label.alias("label"), score.alias("score")).where("at is not null").withWatermark("at", delay)
    side = lambda x: F.sum(F.when(F.col("label") == x, F.col("score")).otherwise(0.0))
    days = rows.groupBy(F.window("at", "1 day").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("label").isin("Positive", "Negative")).alias("polar"), (side("Positive") - side("Negative")).alias("total"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.to_date("day.start").alias("day"), "n", "polar", "total").write.mode("overwrite").parquet(f"{root}/days/batch={number}")

    drain(days, keep, f"{root}/progress", "update")
    kept = spark.read.schema("day date, n bigint, polar bigint, total double, batch bigint").parquet(f"{root}/days")
    last = kept.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("batch")))).where("k = 1")
    return last.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"), (F.sum("total") / F.nullif(F.sum("polar"), F.lit(0))).alias("average_score"))


def upsert_series(spark: SparkSession, place: str, root: str | None = None, files_per_batch: int = 8) -> DataFrame:
    """(ticker, day, close): the usable close of each day that was received last, of equals the larger one.

    The store has a partition a year; a batch reads and replaces the partitions it has days of and leaves the others alone.
    """
    root = root or shared_path(spark, "series")
    schema = "ticker string, day date, close double, received_at timestamp_ntz, year int"
    stored = lambda: spark.read.schema(schema).parquet(f"{root}/days")
    order = F.struct("received_at", "close")
    newest = lambda rows: rows.groupBy("ticker", "day").agg(F.max_by("close", order).alias("close"), F.max("received_at").alias("received_at")).withColumn("year", F.year("day"))

    def upsert(batch: DataFrame, number: int) -> None:
        new = newest(batch).persist()
        years = [r.year for r in new.select("year").distinct().collect()]  # as many as the batch has years
        if number:
            new = newest(new.unionByName(stored().where(F.col("year").isin(years))))
        path = f"{root}/merged"
        new.write.mode("overwrite").parquet(path)
        spark.read.parquet(path).repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{root}/days")
        new.unpersist()

    usable = (F.col("close") > 0) & ~F.isnan("close") & (F.col("close") < float("inf")) & F.col("date").isNotNull()
    rows = source(spark, place, files_per_batch).where(usable).select(F.concat(web.symbol(F.col("ticker")), F.lit(":"), web.symbol(F.col("venue"))).alias("ticker"), F.to_date("date").alias("day"), "close", "received_at")
    drain(rows, upsert, f"{root}/progress")
    return stored().select("ticker", "day", "close")


class LastSeen(StatefulProcessor):
    """The moment of each key's latest event, and the distance of each event from the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["at", "event_id"])
        before = self.last.get()[0] if self.last.exists() else None
        at = part["at"].to_numpy()
        gaps = [-1 if before is None else int(at[0]) - before, *(at[1:] - at[:-1]).tolist()]
        self.last.update((max(int(at[-1]), before if before is not None else int(at[-1])),))
        yield pd.DataFrame({"event_id": part["event_id"].to_numpy(), "user_id": key[0], "gap_us": gaps})

    def close(self) -> None:
        pass


def spacing(spark: SparkSession, place: str, root: str | None = None, files_per_batch: int = 8) -> DataFrame:
    """(event_id, user_id, gap_us): microseconds from the same user's event before, -1 for the first; over all runs.

    Of a batch, events are taken by moment and id; one that comes later than a newer one of an earlier batch has a negative
    gap to that one. Events without user or moment are left out.
    """
    root = root or shared_path(spark, "spacing")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = source(spark, place, files_per_batch).where("user_id is not null and ts is not null").select("event_id", "user_id", at.alias("at"))
    kind = dict(rows.dtypes)
    shape = f"event_id {kind['event_id']}, user_id {kind['user_id']}, gap_us bigint"
    gaps = rows.groupBy("user_id").transformWithStateInPandas(LastSeen(), shape, "append", "none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/gaps/batch={number}")

    drain(gaps, keep, f"{root}/progress")
    return spark.read.schema(shape + ", batch bigint").parquet(f"{root}/gaps").drop("batch")
