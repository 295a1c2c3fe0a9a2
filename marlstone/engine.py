"""The entry point: tables of a directory as views, any SQL, and pluggable scorers and policies."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import udtf

from marlstone.operators import corpus
from marlstone.session import TABLES


@udtf(returnType="url string")
class TextLinks:
    """SQL table function text_links(text): the http addresses of a text, one a row."""

    def eval(self, text: str):
        for url in re.findall(r"https?://\S+", text or ""):
            yield (url,)


class Engine:
    """SQL over a directory's tables, and functions registered by name.

    >>> Engine(spark, "/data").query("SELECT count(*) FROM documents")
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.scorers: dict[str, Callable[[Column], tuple[Column, Column]]] = {"lexicon": corpus.lexicon_label}
        self.policies: dict[str, Callable] = {}
        spark.udtf.register("text_links", TextLinks)

    def views(self, *names: str) -> None:
        for n in names or TABLES:
            self.spark.read.parquet(f"{self.dir}/{n}.parquet").createOrReplaceTempView(n)

    def query(self, sql: str) -> DataFrame:
        """Any Spark SQL; the tables it names are registered first."""
        low = sql.lower()
        self.views(*[n for n in TABLES if n in low])
        return self.spark.sql(sql)

    def register_scorer(self, name: str, scorer: Callable[[Column], tuple[Column, Column]]) -> None:
        """A scorer gives (label, score) columns of a text column."""
        self.scorers[name] = scorer

    def register_policy(self, name: str, policy: Callable) -> None:
        """A policy maps a pandas frame of one run's observations to one of its actions."""
        self.policies[name] = policy

    def score(self, texts: DataFrame, text: str = "text", scorer: str = "lexicon") -> DataFrame:
        label, score = self.scorers[scorer](texts[text])
        return texts.withColumns({"sentiment_label": label, "sentiment_score": score})

    def act(self, observations: DataFrame, policy: str, keys: list[str], schema: str) -> DataFrame:
        """Actions of every run by a registered policy, runs side by side."""
        return observations.groupBy(*keys).applyInPandas(self.policies[policy], schema)
