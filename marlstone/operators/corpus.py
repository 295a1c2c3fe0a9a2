"""Corpus cleaning, statistics before and after, and sentiment features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T


def replaced(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """rows with the column replaced, the value being computed once.

    The generator keeps later filters from being moved below it, where each would compute the value anew.
    """
    return rows.select(*[F.explode(F.array(value)).alias(column) if c == column else F.col(c) for c in rows.columns])


def clean_posts(posts: DataFrame, key: str = "id", text: str = "text", group: str = "file_name", min_words: int = 5, max_words: int = 500, letters: float = 0.7, tags: float = 0.75, unicode_form: bool = True, prefix: str = "[STOCKTWITS]") -> DataFrame:
    """The posts that pass the cleaner, with their cleaned text; of equal texts of a group the first by key stays.

    The order is fixed: language before duplicates, duplicates before length, letters and tags.
    """
    t = F.col(text)
    rows = posts.where(t.isNotNull() & (F.trim(t) != ""))
    body = T.nfkc(t) if unicode_form else t
    rows = replaced(rows, text, T.keep_allowed(T.squeeze(T.strip_web(body)))).where(T.is_english(t))
    first = F.row_number().over(Window.partitionBy(group, text).orderBy(key))
    rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    rows = rows.where((T.n_words(t) >= min_words) & (F.coalesce(T.letter_share(t), F.lit(0.0)) >= letters) & (T.tag_share(t) <= tags))
    cut = T.first_words(t, max_words)
    return rows.withColumn("was_cut", T.n_words(t) > max_words).withColumn(text, F.concat(F.lit(prefix + " "), cut) if prefix else cut)


def statistics(texts: DataFrame, group: str = "file_name", text: str = "text") -> DataFrame:
    """One row a group: counts, means and medians of lengths, ratios and keyword counts of its texts."""
    t = F.col(text)
    rows = texts.select(group, F.length(t).alias("c"), T.n_words(t).alias("w"), T.ascii_share(t).alias("e"), T.digit_share(t).alias("g"), T.keyword_counts(t, k=T.FINANCE_KEYWORDS, p=T.POSITIVE, m=T.NEGATIVE).alias("_k"), t.rlike("[0-9]").alias("d"))
    rows = rows.select("*", "_k.*")
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.avg("c").alias("char_mean"), F.median("c").alias("char_median"), F.avg("w").alias("word_mean"), F.median("w").alias("word_median"), F.avg("e").alias("english_ratio"), F.avg("g").alias("digit_ratio"), F.avg("k").alias("keyword_freq"),
        F.sum("p").alias("positive_keywords"), F.sum("m").alias("negative_keywords"), F.count_if("d").alias("number_count"),
    )


def before_after(posts: DataFrame, cleaned: DataFrame, group: str = "file_name", text: str = "text") -> DataFrame:
    """Statistics before and after the cleaner beside each other, the texts cut by it, and the share retained.

    `cleaned` has was_cut.
    """
    known = posts.where(F.col(text).isNotNull() & (F.trim(text) != ""))
    a, b = statistics(known, group, text), statistics(cleaned, group, text)
    side = lambda df, tag: df.select(group, *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c != group])
    cut = cleaned.groupBy(group).agg(F.count_if("was_cut").alias("truncated_count"))
    both = side(a, "before").join(side(b, "after"), group, "left").join(cut, group, "left").withColumn("truncated_count", F.coalesce("truncated_count", F.lit(0)))
    return both.withColumn("filter_rate", F.coalesce("n_after", F.lit(0)) / F.col("n_before"))


def lexicon_label(t: Column) -> tuple[Column, Column]:
    """(label, score) by words of rise and fall in the first 500 characters; blank texts are an Error of score 0."""
    s = F.substring(F.coalesce(t, F.lit("")), 1, 500)

    def told(x: Column) -> Column:
        p, m, blank = x["k"]["p"], x["k"]["m"], F.trim(x["s"]) == ""
        label = F.when(blank, "Error").when(p > m, "Positive").when(p < m, "Negative").otherwise("Neutral")
        score = F.when(blank | (p == m), 0.0).otherwise(F.abs(p - m) / (p + m))
        return F.struct(label.alias("label"), score.cast("double").alias("score"))

    both = F.transform(F.transform(F.array(s), lambda x: F.struct(x.alias("s"), T.keyword_counts(x, p=T.POSITIVE, m=T.NEGATIVE).alias("k"))), told)[0]
    return both["label"], both["score"]


def signed_average(label: Column, score: Column) -> Column:
    """Positive scores less negative ones by the number of both; null where there is neither."""
    polar = F.count_if(label.isin("Positive", "Negative"))
    return (F.sum(F.when(label == "Positive", score).otherwise(0.0)) - F.sum(F.when(label == "Negative", score).otherwise(0.0))) / F.nullif(polar, F.lit(0))


def monthly_sentiment(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, average_score) of the groups that have positive or negative texts."""
    return labelled.groupBy(*keys).agg(signed_average(F.col("label"), F.col("score")).alias("average_score")).where("average_score is not null")


def sentiment_matrix(monthly: DataFrame, groups: list[str], group: str = "grp") -> DataFrame:
    return monthly.groupBy("year", "month").pivot(group, groups).agg(F.avg("average_score"))


def pad_neutral(matrix: DataFrame, first: int, last: int) -> DataFrame:
    """Missing scores of the years from first to last are 0; rows that aren't there aren't made."""
    inside = F.col("year").between(first, last)
    return matrix.select("year", "month", *[F.when(inside, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)).alias(c) for c in matrix.columns if c not in ("year", "month")])


def first_per(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def clean_articles(pages: DataFrame, text: str = "text", title: str | None = None, key: str = "doc_id", min_words: int = 50, max_words: int = 5000, letters: float = 0.7, unicode_form: bool = True) -> DataFrame:
    """Crawled texts that pass the article cleaner, as [NEWS]title.content; of equal contents the first by key stays.

    English texts of more than 20 characters lose boilerplate, page furniture and rare signs, and stay if they are of fitting
    length, mostly letters and have a sentence end. content_hash, word_count and char_count are of the formatted text.
    """
    t = F.col(text)
    rows = pages.where(F.length(T.strip(t)) > 20).where(T.crawled_english(t))
    body = T.ascii_quotes(T.nfkc(t) if unicode_form else t)
    rows = replaced(rows, text, T.keep_allowed_spaced(T.content_lines(T.strip_boilerplate(body))))
    rows = rows.where(T.n_words(t).between(min_words, max_words) & (F.coalesce(T.letter_share(t), F.lit(0.0)) >= letters) & (T.sentences(t) >= 1))
    rows = rows.withColumn(text, T.news_format(F.col(title), t) if title else T.news_format(F.lit(None).cast("string"), t))
    rows = rows.withColumns({"content_hash": T.content_key(t), "word_count": T.n_words(t), "char_count": F.length(t)})
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy(key))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def score_batches(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], labels: tuple[str, ...], batch: int = 32, longest: int = 500) -> DataFrame:
    """(key, label, score): the likeliest label of each text by a model that gives one row of logits a text.

    `load` runs once a Python worker; texts go to the model in batches of the first `longest` characters. Blank and null texts
    are an Error of score 0.
    """
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in batches:
            texts = [(x or "")[:longest] for x in part[text]]
            known = [i for i, x in enumerate(texts) if x.strip()]
            out = pd.DataFrame({key: part[key].to_numpy(), "label": "Error", "score": 0.0})
            for at in range(0, len(known), batch):
                of = known[at : at + batch]
                logits = np.asarray(model([texts[i] for i in of]), float)
                shares = np.exp(logits - logits.max(axis=1, keepdims=True))
                shares /= shares.sum(axis=1, keepdims=True)
                out.loc[of, "label"] = [labels[k] for k in shares.argmax(axis=1)]
                out.loc[of, "score"] = shares.max(axis=1)
            yield out

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, label string, score double")


def accuracy(scored: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(n, correct, accuracy) over the rows that have a truth."""
    hit = F.coalesce(truth == guess, F.lit(False))
    return scored.where(truth.isNotNull()).agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"))
