"""The registered queries of the text operators. Their SQL, where it can be said in SQL, is in marlstone.llm.oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import canonical, language, neardup, packing, quality, spans, tokens, truncation
from marlstone.session import spread, table

NEAR_RUN, NEAR_THRESHOLD = 3, 0.5  # as this project's data state the problem


def news_text():
    """Title, blank, text of a news item."""
    return F.concat_ws(" ", "title", "text")


def all_records(spark: SparkSession, d: str, *names: str) -> DataFrame:
    what = {"documents": ("doc_id", "text"), "social_post": ("id", "text"), "news_item": ("delivery_id", "text")}
    return canonical.records(*[(n, table(spark, d, n), *what[n]) for n in names])


def common(spark: SparkSession, d: str) -> frozenset[str]:
    return quality.common_words(table(spark, d, "common_word"))


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(all_records(spark, d, "documents", "social_post"), ["tbl", "id"], common(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = p1_statistics(spark, d)
    junk = F.when(F.col("tbl") == "documents", ~F.col("is_prose")).otherwise(F.col("is_bare"))
    return s.where(junk).select("tbl", F.col("id").alias("rec_id")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_look_pairs(all_records(spark, d, "documents", "social_post", "news_item"))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.spelling_groups(all_records(spark, d, "documents", "social_post", "news_item"))


def p3_marked(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(all_records(spark, d, "documents", "social_post", "news_item"), common(spark, d), frozenset({"social_post"}))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_marked(spark, d).where("cut").select("tbl", F.col("id").alias("rec_id")).distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    of = lambda n, k, s: table(spark, d, n).select(F.lit(n).alias("tbl"), F.col(k).alias("id"), F.col(s).alias("source"))
    sources = of("documents", "doc_id", "source").unionAll(of("social_post", "id", "file_name")).unionAll(of("news_item", "delivery_id", "site"))
    return truncation.truncation_rates(p3_marked(spark, d), sources)


def _filters(spark: SparkSession, d: str) -> language.Filters:
    return language.fit_filters(table(spark, d, "lang_sample"), table(spark, d, "common_word"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), _filters(spark, d))


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), _filters(spark, d))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), _filters(spark, d))


def near_records(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "news_item").select("delivery_id", news_text().alias("both"))
    return canonical.records(("documents", table(spark, d, "documents"), "doc_id", "text"), ("social_post", table(spark, d, "social_post"), "id", "text"), ("news_item", news, "delivery_id", "both"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(near_records(spark, d), run=NEAR_RUN, threshold=NEAR_THRESHOLD)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(near_records(spark, d), run=NEAR_RUN, threshold=NEAR_THRESHOLD)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "pack_capacity"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_containers(spark, d), table(spark, d, "pack_capacity"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(spread(table(spark, d, "documents").select("doc_id", "text")))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """Spans as begin-end, the end not included, in their order."""
    part = spans.shared_part(spread(table(spark, d, "documents").select("doc_id", "text")))
    told = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["begins"], x["ends"])), ",")
    return part.withColumn("spans", told).withColumn("shared_share", F.round("shared_share", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_statistics": p1_statistics, "p2_found": p2_found, "p2_canonical": p2_canonical, "p3_found": p3_found, "p3_rates": p3_rates,
        "p5_found": p5_found, "p5_languages": p5_languages, "p5_segments": p5_segments, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids,
        "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_shared": p10_shared,
    }
