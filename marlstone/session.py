"""Session helpers: defaults for local runs and the shared folder of a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "asset_dim", "social_post", "news_item", "stock_closing_prices", "cleaning_stats", "common_word", "lang_sample", "pack_capacity",
)


def local_session(cores: int | str = 8, name: str = "marlstone") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def reach_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies, whatever folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the scan prunes columns and takes pushed filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where their scan has fewer tasks than there are cores; on tables of many files they stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(2 * cores)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a fresh local folder in a local session that names none.

    A cluster's session that names none is an error, as executors share no local folder.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "settled") -> DataFrame:
    """The same rows, computed once and written to the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
