"""Queries on posts, news and documents by the core's own column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import html, web
from marlstone.functions import text as T
from marlstone.operators import corpus, portfolio
from marlstone.plans.kit import Book, num, rounded
from marlstone.session import spread, table

BOOK = Book()
WS = T.WS
POSTS = "p AS (SELECT id, file_name, year, month, asset, text AS t FROM social_post WHERE text IS NOT NULL AND trim(text) <> '')"
SQUEEZED = rf"trim(regexp_replace(t, '[{WS}]+', ' ', 'g'))"
WORDS = rf"(CASE WHEN {SQUEEZED} = '' THEN [] ELSE string_split({SQUEEZED}, ' ') END)"
SOLID = "length(replace(t, ' ', ''))"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(t: str) -> str:
    out = rf"regexp_replace(regexp_replace({t}, 'http[^{WS}]+|www\.[^{WS}]+', '', 'g'), '<[^>]+>', '', 'g')"
    for k in T.WEB_KEYWORDS:
        out = f"replace({out}, {lit(k)}, '')"
    return out


def count_sql(t: str, keywords: tuple[str, ...]) -> str:
    # word boundaries as Unicode has them: letters beyond ASCII are word signs, other signs are not
    t = rf"regexp_replace(regexp_replace(lower({t}), '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
    return "(" + " + ".join(rf"len(regexp_extract_all({t}, {lit(chr(92) + 'b' + T._escaped(k) + chr(92) + 'b')}))" for k in keywords) + ")"


def posts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "social_post").select("id", "file_name", "year", "month", "asset", F.col("text").alias("t"))
    return t.where(F.col("t").isNotNull() & (F.trim("t") != ""))


def one(name: str, sql: str, column) -> None:
    """A query of one expression over all posts."""
    BOOK.add(name, f"WITH {POSTS} SELECT id, {sql} AS value FROM p")(lambda s, d: rounded(posts(s, d).select("id", column(F.col("t")).alias("value"))))


one("str2_strip_web", strip_sql("t"), T.strip_web)
one("str3_squeeze", SQUEEZED, T.squeeze)
one("str4_keep_allowed", "regexp_replace(t, '[^A-Za-z0-9 %+.?!$]', '', 'g')", T.keep_allowed)
one("str4_keep_allowed_spaced", rf"""trim(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9{WS}%+\-.,!?$''";:()@#&]', ' ', 'g'), '[{WS}]+', ' ', 'g'))""", T.keep_allowed_spaced)
one("str5_ascii_quotes", "replace(translate(t, '“”‘’–—', '\"\"''''--'), '…', '...')", T.ascii_quotes)
one("str8_english_share", rf"round(length(regexp_replace(t, '[^A-Za-z \t\n\r\f\x0B]', '', 'g')) / nullif({SOLID}, 0), 6)", T.english_share)
one("str9_letter_share", rf"round(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / nullif({SOLID}, 0), 6)", T.letter_share)
one("str10_ascii_share", f"round(coalesce(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / nullif({SOLID}, 0), 0), 6)", T.ascii_share)
one("str10_digit_share", f"round(coalesce(length(regexp_replace(t, '[^0-9]', '', 'g')) / nullif({SOLID}, 0), 0), 6)", T.digit_share)
one("str11_tag_share", f"round(coalesce(len(list_filter({WORDS}, lambda x: regexp_matches(x, '^\\$[^0-9]'))) / nullif(len({WORDS}), 0), 0), 6)", T.tag_share)
one("str12_word_count", f"CAST(len({WORDS}) AS INTEGER)", T.n_words)
one("str12_topk5_first_words", f"CASE WHEN len({WORDS}) > 6 THEN array_to_string({WORDS}[1:6], ' ') ELSE t END", lambda t: T.first_words(t, 6))
one("str13_prefix", "'[STOCKTWITS] ' || t", lambda t: F.concat(F.lit("[STOCKTWITS] "), t))
one("str14_keyword_count", f"CAST({count_sql('t', T.FINANCE_KEYWORDS)} AS INTEGER)", lambda t: T.keyword_count(t, T.FINANCE_KEYWORDS))
one("str15_positive_count", f"CAST({count_sql('t', T.POSITIVE)} AS INTEGER)", lambda t: T.keyword_count(t, T.POSITIVE))
one("str15_negative_count", f"CAST({count_sql('t', T.NEGATIVE)} AS INTEGER)", lambda t: T.keyword_count(t, T.NEGATIVE))
one("str15_has_digit", "regexp_matches(t, '[0-9]')", lambda t: t.rlike("[0-9]"))
one("str16_found_terms", "array_to_string(list_filter([" + ", ".join(map(lit, T.TERMS)) + "], lambda k: contains(lower(t), k))[1:10], ',')", lambda t: F.array_join(T.found_terms(t), ","))
one("str18_sentences", "CAST(len(regexp_extract_all(t, '[.!?]+')) AS INTEGER)", T.sentences)
one("str18_sentence_length", f"round(coalesce(len({WORDS}) / nullif(len(regexp_extract_all(t, '[.!?]+')), 0), 0), 2)", T.sentence_length)
one("str19_content_key", rf"md5(trim(regexp_replace(lower(substring(t, 1, 1000)), '[{WS}]+', ' ', 'g')))", T.content_key)
one("str23_field_cut", "substring(t, 1, 200)", lambda t: F.substring(t, 1, 200))

DOCS = "d AS (SELECT doc_id, lower(trim(coalesce(source, ''))) AS source, coalesce(text, '') AS t FROM documents)"


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source"), F.coalesce("text", F.lit("")).alias("t"))


def boiler_sql(t: str) -> str:
    for p in T.BOILERPLATE:
        t = f"regexp_replace({t}, {lit('(?is)' + p)}, ' ', 'g')"
    return t


@BOOK.add("str6_strip_boilerplate", f"WITH {DOCS} SELECT doc_id, {boiler_sql('t')} AS value FROM d")
def strip_boilerplate(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", T.strip_boilerplate(F.col("t")).alias("value"))


STRIPPED = rf"regexp_replace(regexp_replace(y, '^[{WS}]+', ''), '[{WS}]+$', '')"
PLAIN = " AND ".join(f"NOT contains(x, {lit(k)})" for k in T.JUNK) + rf" AND NOT regexp_matches(x, 'https?://|www\.|\.[a-z]{{2,3}}/') AND NOT (len(string_split_regex(x, '[{WS}]+')) < 5 AND regexp_matches(x, '^(home|news|about)'))"


@BOOK.add(
    "str7_content_lines",
    rf"""WITH {DOCS}, l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda y: {STRIPPED.replace('regexp_replace(y', 'regexp_replace(lower(y)')}), lambda x: length(x) >= 10 AND {PLAIN}) AS kept FROM d)
 SELECT doc_id, array_to_string(list_filter(list_transform(list_transform(kept, lambda y: regexp_replace(y, '\b(ad|ads|advertisement|sponsored)\b', '', 'g')), lambda y: {STRIPPED}), lambda x: length(x) > 5), chr(10)) AS value FROM l""",
)
def content_lines(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", T.content_lines(F.col("t")).alias("value"))


@BOOK.add("flt5_flt6_length_gates", f"WITH {DOCS} SELECT doc_id, length(t) AS n FROM d WHERE length(t) > 2000")
def length_gate(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", num(F.length("t")).alias("n")).where("n > 2000")


@BOOK.add("flt3_not_blank", "SELECT id, file_name FROM social_post WHERE text IS NOT NULL AND trim(text) <> ''")
def not_blank(s: SparkSession, d: str) -> DataFrame:
    return posts(s, d).select("id", "file_name")


CLEAN = f"""{POSTS}, c1 AS (SELECT id, file_name, regexp_replace(trim(regexp_replace({strip_sql('t')}, '[{WS}]+', ' ', 'g')), '[^A-Za-z0-9 %+.?!$]', '', 'g') AS t FROM p),
c2 AS (SELECT * FROM c1 WHERE length({SQUEEZED}) >= 10 AND length(regexp_replace(t, '[^A-Za-z \\t\\n\\r\\f\\x0B]', '', 'g')) / nullif({SOLID}, 0) >= 0.7),
c3 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY file_name, t ORDER BY id) = 1),
cl AS (SELECT id, file_name, t FROM c3 WHERE len({WORDS}) >= 5 AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / nullif({SOLID}, 0) >= 0.7 AND coalesce(len(list_filter({WORDS}, lambda x: regexp_matches(x, '^\\$[^0-9]'))) / nullif(len({WORDS}), 0), 0) <= 0.75)"""


def cleaned(s: SparkSession, d: str, unicode_form: bool = False) -> DataFrame:
    return corpus.clean_posts(spread(posts(s, d)).withColumnRenamed("t", "text").dropDuplicates(["id"]), unicode_form=unicode_form, prefix="").select("id", "file_name", F.col("text").alias("t"))


@BOOK.add("flt4_set2_clean_posts", "WITH " + CLEAN.replace("FROM social_post", "FROM (SELECT DISTINCT ON (id) * FROM social_post)") + " SELECT id, file_name, t FROM cl")
def clean_posts(s: SparkSession, d: str) -> DataFrame:
    return cleaned(s, d)


@BOOK.add("str1_clean_posts_nfkc", None)
def clean_posts_nfkc(s: SparkSession, d: str) -> DataFrame:
    return cleaned(s, d, True)


def stats_sql(source: str) -> str:
    return f"""SELECT file_name, count(*) AS n, avg(length(t)) AS char_mean, median(length(t)) AS char_median, avg(len({WORDS})) AS word_mean, median(len({WORDS})) AS word_median, avg(coalesce(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / nullif({SOLID}, 0), 0)) AS english_ratio, avg(coalesce(length(regexp_replace(t, '[^0-9]', '', 'g')) / nullif({SOLID}, 0), 0)) AS digit_ratio,
 avg({count_sql('t', T.FINANCE_KEYWORDS)}) AS keyword_freq, CAST(sum({count_sql('t', T.POSITIVE)}) AS BIGINT) AS positive_keywords, CAST(sum({count_sql('t', T.NEGATIVE)}) AS BIGINT) AS negative_keywords, count(*) FILTER (regexp_matches(t, '[0-9]')) AS number_count FROM {source} GROUP BY file_name"""


MEASURES = ("char_mean", "char_median", "word_mean", "word_median", "english_ratio", "digit_ratio", "keyword_freq")


@BOOK.add("agg15_16_statistics", f"WITH {POSTS}, st AS ({stats_sql('p')}) SELECT file_name, n, positive_keywords, negative_keywords, number_count, " + ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES) + " FROM st")
def statistics(s: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.statistics(spread(posts(s, d)), text="t"))


COUNTED = ("n", "positive_keywords", "negative_keywords", "number_count")
UNREPEATED = "WITH " + CLEAN.replace("FROM social_post", "FROM (SELECT DISTINCT ON (id) * FROM social_post)")


def posts_and_cleaned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = spread(posts(s, d)).dropDuplicates(["id"]).withColumnRenamed("t", "text")
    return p, corpus.clean_posts(p, unicode_form=False, prefix="")


@BOOK.add(
    "agg17_before_after",
    UNREPEATED + f", a AS ({stats_sql('p')}), b AS ({stats_sql('cl')}), c AS (SELECT file_name, count(*) FILTER (len({WORDS}) > 500) AS truncated_count FROM cl GROUP BY 1) SELECT file_name, "
    + ", ".join(f"{x}.{m} AS {m}_{y}" for x, y in (("a", "before"), ("b", "after")) for m in COUNTED) + ", " + ", ".join(f"round({x}.{m}, 6) AS {m}_{y}" for x, y in (("a", "before"), ("b", "after")) for m in MEASURES)
    + ", coalesce(truncated_count, 0) AS truncated_count, round(coalesce(b.n, 0) / a.n, 6) AS filter_rate FROM a LEFT JOIN b USING (file_name) LEFT JOIN c USING (file_name)",
)
def before_after(s: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.before_after(*posts_and_cleaned(s, d)))


@BOOK.add("agg20_word_range", UNREPEATED + f" SELECT file_name, round(avg(len({WORDS})), 6) AS mean_words, CAST(max(len({WORDS})) AS BIGINT) AS most_words, CAST(min(len({WORDS})) AS BIGINT) AS least_words, round(count(*) / max(a.n), 6) AS retention FROM cl JOIN (SELECT file_name, count(*) AS n FROM p GROUP BY 1) a USING (file_name) GROUP BY file_name")
def word_range(s: SparkSession, d: str) -> DataFrame:
    p, c = posts_and_cleaned(s, d)
    n = T.n_words(F.col("text"))
    after = c.groupBy("file_name").agg(F.avg(n).alias("mean_words"), num(F.max(n)).alias("most_words"), num(F.min(n)).alias("least_words"), F.count("*").alias("kept"))
    both = after.join(p.groupBy("file_name").agg(F.count("*").alias("n")), "file_name")
    return rounded(both.select("file_name", "mean_words", "most_words", "least_words", (F.col("kept") / F.col("n")).alias("retention")))


S500 = "substring(coalesce(text, ''), 1, 500)"
LABELS = f"""q AS (SELECT id, year, month, upper(trim(asset)) AS grp, trim({S500}) = '' AS blank, {count_sql(S500, T.POSITIVE)} AS p, {count_sql(S500, T.NEGATIVE)} AS m FROM social_post),
lab AS (SELECT id, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, grp, CASE WHEN blank THEN 'Error' WHEN p > m THEN 'Positive' WHEN p < m THEN 'Negative' ELSE 'Neutral' END AS label, CASE WHEN blank OR p = m THEN 0.0 ELSE abs(p - m) / (p + m) END AS score FROM q)"""
MONTHLY = LABELS + """, mon AS (SELECT year, month, grp, (sum(CASE WHEN label = 'Positive' THEN score ELSE 0 END) - sum(CASE WHEN label = 'Negative' THEN score ELSE 0 END)) / nullif(count(*) FILTER (label IN ('Positive', 'Negative')), 0) AS average_score FROM lab WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) FILTER (label IN ('Positive', 'Negative')) > 0)"""
GROUPS = ["BEBY", "CAMA", "DAMO", "TIVU", "VYRI", "XACO"]


def labelled(s: SparkSession, d: str) -> DataFrame:
    label, score = corpus.lexicon_label(F.col("text"))
    rows = spread(table(s, d, "social_post").select("id", "year", "month", "asset", "text"))
    return rows.select("id", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), F.upper(F.trim("asset")).alias("grp"), label.alias("label"), score.alias("score"))


@BOOK.add("ml1_lexicon_labels", f"WITH {LABELS} SELECT id, label, round(score, 6) AS score FROM lab")
def labels(s: SparkSession, d: str) -> DataFrame:
    return rounded(labelled(s, d).select("id", "label", "score"))


@BOOK.add("agg9_10_monthly_sentiment", f"WITH {MONTHLY} SELECT year, month, grp, round(average_score, 6) AS average_score FROM mon")
def monthly_sentiment(s: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.monthly_sentiment(labelled(s, d).where("year is not null and month is not null"), ["year", "month", "grp"]))


MATRIX = MONTHLY + ", mat AS (SELECT year, month, " + ", ".join(f"avg(average_score) FILTER (grp = '{g}') AS {g}" for g in GROUPS) + " FROM mon GROUP BY 1, 2)"


@BOOK.add("agg11_sentiment_matrix", f"WITH {MATRIX} SELECT year, month, " + ", ".join(f"round({g}, 6) AS {g}" for g in GROUPS) + " FROM mat")
def sentiment_matrix(s: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.sentiment_matrix(corpus.monthly_sentiment(labelled(s, d).where("year is not null and month is not null"), ["year", "month", "grp"]), GROUPS))


@BOOK.add("cond1_pad_neutral", f"WITH {MATRIX} SELECT year, month, " + ", ".join(f"round(CASE WHEN year BETWEEN 2013 AND 2024 THEN coalesce({g}, 0) ELSE {g} END, 6) AS {g}" for g in GROUPS) + " FROM mat")
def pad_neutral(s: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.pad_neutral(corpus.sentiment_matrix(corpus.monthly_sentiment(labelled(s, d).where("year is not null and month is not null"), ["year", "month", "grp"]), GROUPS), 2013, 2024))


TITLED = ", ".join(f"{n}_k AS (SELECT delivery_id, trim({x}) = '' AS blank, {count_sql(x, T.POSITIVE)} AS p, {count_sql(x, T.NEGATIVE)} AS m FROM news_item)" for n, x in (("text", S500), ("title", S500.replace("text", "title"))))
TITLED += ", " + ", ".join(f"{n}_l AS (SELECT delivery_id, CASE WHEN blank THEN 'Error' WHEN p > m THEN 'Positive' WHEN p < m THEN 'Negative' ELSE 'Neutral' END AS label FROM {n}_k)" for n in ("text", "title"))
TITLED += ", pairs AS (SELECT text_l.label AS truth, title_l.label AS guess FROM text_l JOIN title_l USING (delivery_id))"


def titled(s: SparkSession, d: str) -> DataFrame:
    """The label of each article's text as the truth, that of its title as the guess."""
    label = lambda c: corpus.lexicon_label(F.col(c))[0]
    return table(s, d, "news_item").select(label("text").alias("truth"), label("title").alias("guess"))


@BOOK.add("agg27_confusion", f"WITH {TITLED} SELECT truth, guess, count(*) AS n FROM pairs GROUP BY 1, 2")
def confusion(s: SparkSession, d: str) -> DataFrame:
    return portfolio.confusion(titled(s, d), F.col("truth"), F.col("guess"))


@BOOK.add("ml3_accuracy", f"WITH {TITLED} SELECT count(*) AS n, count(*) FILTER (truth = guess) AS correct, round(avg(CAST(truth = guess AS DOUBLE)), 6) AS accuracy FROM pairs")
def accuracy(s: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.accuracy(titled(s, d), F.col("truth"), F.col("guess")))


@BOOK.add("topk4_first_per_month", "SELECT id, file_name, year, month FROM (SELECT DISTINCT id, file_name, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM social_post WHERE year IS NOT NULL AND month IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY file_name, year, month ORDER BY id) <= 3")
def first_per_month(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "social_post").where("year is not null and month is not null").select("id", "file_name", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).distinct()
    return corpus.first_per(p, ["file_name", "year", "month"], ["id"], 3)


@BOOK.add("str17_topk7_top_tokens", rf"WITH {POSTS}, x AS (SELECT unnest(string_split(trim(regexp_replace(lower(regexp_replace(t, '\$[A-Za-z]+', ' ', 'g')), '[^a-z]+', ' ', 'g')), ' ')) AS token FROM p) SELECT token, count(*) AS n FROM x WHERE token <> '' AND token NOT IN (SELECT word FROM common_word) GROUP BY 1 ORDER BY n DESC, token LIMIT 80")
def top_tokens(s: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.regexp_replace(F.lower(F.regexp_replace("t", r"\$[A-Za-z]+", " ")), "[^a-z]+", " "))
    tokens = posts(s, d).select(F.explode(F.split(t, " ")).alias("token")).where("token <> ''")
    return tokens.join(F.broadcast(table(s, d, "common_word").select(F.col("word").alias("token"))), "token", "left_anti").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(80)


@BOOK.add("src25_links_of_posts", rf"WITH {POSTS}, l AS (SELECT DISTINCT id, unnest(regexp_extract_all(t, 'https?://[^{WS}]+')) AS url FROM p) SELECT id, url, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM l")
def links(s: SparkSession, d: str) -> DataFrame:
    found = posts(s, d).select("id", F.explode(F.regexp_extract_all("t", F.lit(rf"https?://[^{WS}]+"), F.lit(0))).alias("url")).distinct()
    return found.withColumn("domain", T.domain(F.col("url")))


LINKS = rf"{POSTS}, l AS (SELECT DISTINCT id, unnest(regexp_extract_all(t, 'https?://[^{WS}]+')) AS url FROM p), ld AS (SELECT id, url, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM l)"


@BOOK.add("agg18_topk1_domain_rates", f"WITH {LINKS} SELECT domain, count(*) AS n, CAST(sum(CASE WHEN contains(url, '/p/') THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN contains(url, '/p/') THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ld GROUP BY 1 ORDER BY rate DESC, domain LIMIT 20")
def domain_rates(s: SparkSession, d: str) -> DataFrame:
    hit = F.contains("url", F.lit("/p/")).cast("int")
    return rounded(links(s, d).groupBy("domain").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit.cast("double")).alias("rate"))).orderBy(F.desc("rate"), "domain").limit(20)


@BOOK.add("agg19_topk2_top_domains", f"WITH {LINKS} SELECT domain, count(*) AS n FROM ld GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def top_domains(s: SparkSession, d: str) -> DataFrame:
    return links(s, d).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(10)


@BOOK.add("win17_round_robin", f"WITH {LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id, url) AS turn FROM ld) SELECT id, url, domain, turn FROM r")
def round_robin(s: SparkSession, d: str) -> DataFrame:
    return links(s, d).withColumn("turn", F.row_number().over(Window.partitionBy("domain").orderBy("id", "url")).cast("bigint"))


NEWS = rf"""n AS (SELECT delivery_id, upper(trim(coalesce(symbol, ''))) AS symbol, published_date, regexp_replace(coalesce(url, ''), '[{WS}]+', '', 'g') AS u, title, publisher, site FROM news_item)"""


@BOOK.add("str20_clean_address", rf"WITH {NEWS} SELECT delivery_id, CASE WHEN u = '' THEN '' ELSE regexp_replace(regexp_replace(replace(regexp_replace(replace(CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN u ELSE 'https://' || u END, '://', chr(1)), '/{{2,}}', '/', 'g'), chr(1), '://'), '#.*$', ''), '^$', '') END AS url FROM n")
def addresses(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_item").select("delivery_id", T.clean_address(F.col("url")).alias("url"))


@BOOK.add("date1_parse_moments", "SELECT delivery_id, strftime(timezone('UTC', try_cast(CASE WHEN regexp_matches(trim(published_date), '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN trim(published_date) ELSE trim(published_date) || 'Z' END AS TIMESTAMPTZ)), '%Y-%m-%d %H:%M:%S') AS moment FROM news_item")
def moments(s: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_micros(F.unix_micros(web.moment(F.col("published_date"))))
    return table(s, d, "news_item").select("delivery_id", F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@BOOK.add("key1_composite_key", rf"WITH {NEWS} SELECT delivery_id, CASE WHEN u <> '' THEN 'url::' || u ELSE concat_ws('::', symbol, coalesce(title, ''), coalesce(publisher, ''), coalesce(trim(published_date), '')) END AS key FROM n")
def composite_key(s: SparkSession, d: str) -> DataFrame:
    u = F.regexp_replace(F.coalesce("url", F.lit("")), f"[{WS}]+", "")
    empty = lambda c: F.coalesce(c, F.lit(""))
    key = F.when(u != "", F.concat(F.lit("url::"), u)).otherwise(F.concat_ws("::", F.upper(F.trim(empty(F.col("symbol")))), empty(F.col("title")), empty(F.col("publisher")), empty(F.trim("published_date"))))
    return table(s, d, "news_item").select("delivery_id", key.alias("key"))


@BOOK.add("flt8_sort2_symbol_newest", "SELECT delivery_id, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at, row_number() OVER (PARTITION BY upper(trim(coalesce(symbol, ''))) ORDER BY received_at DESC, delivery_id) AS place FROM news_item WHERE upper(trim(coalesce(symbol, ''))) IN ('TIVU', '') AND received_at >= TIMESTAMP '2015-01-01'")
def symbol_newest(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "news_item").where(web.symbol(F.col("symbol")).isin("TIVU", "") & (F.col("received_at") >= F.lit("2015-01-01").cast("timestamp_ntz")))
    place = F.row_number().over(Window.partitionBy(web.symbol(F.col("symbol"))).orderBy(F.desc("received_at"), "delivery_id"))
    return n.select("delivery_id", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"), num(place).alias("place"))


@BOOK.add("flt7_denied_hosts", rf"""WITH {LINKS} SELECT id, url FROM ld WHERE NOT regexp_matches(domain, '(^|\.)(t|go)\.')""")
def denied_hosts(s: SparkSession, d: str) -> DataFrame:
    return links(s, d).where(~F.col("domain").rlike(r"(^|\.)(t|go)\.")).select("id", "url")


@BOOK.add("topk6_longest_text", "SELECT upper(trim(coalesce(symbol, ''))) AS symbol, max(length(text)) AS chars, max_by(md5(text), (length(text), text)) AS longest FROM news_item WHERE text IS NOT NULL GROUP BY 1")
def longest_text(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "news_item").where("text is not null")
    return n.groupBy(F.upper(F.trim(F.coalesce("symbol", F.lit("")))).alias("symbol")).agg(num(F.max(F.length("text"))).alias("chars"), F.md5(F.max_by("text", F.struct(F.length("text"), F.col("text")))).alias("longest"))


@BOOK.add("str22_safe_names", "SELECT delivery_id, replace(replace(coalesce(symbol, ''), '^', ''), '/', '_') AS name, array_to_string(list_filter(list_transform(string_split(coalesce(symbol, ''), ','), lambda x: upper(trim(x))), lambda x: x <> ''), ',') AS symbols FROM news_item")
def safe_names(s: SparkSession, d: str) -> DataFrame:
    symbol = F.coalesce("symbol", F.lit(""))
    return table(s, d, "news_item").select("delivery_id", T.safe_name(symbol).alias("name"), F.array_join(T.symbol_list(symbol), ",").alias("symbols"))


@BOOK.add("str24_formatting", "SELECT asset, printf('%.6f%%', CAST(char_length_before_mean AS DOUBLE)) AS share, printf('%.8f', CAST(word_length_before_mean AS DOUBLE)) AS fixed FROM cleaning_stats WHERE isfinite(char_length_before_mean) AND isfinite(word_length_before_mean)")
def formatting(s: SparkSession, d: str) -> DataFrame:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    c = table(s, d, "cleaning_stats").where(finite("char_length_before_mean") & finite("word_length_before_mean"))
    return c.select("asset", F.format_string("%.6f%%", "char_length_before_mean").alias("share"), F.format_string("%.8f", "word_length_before_mean").alias("fixed"))


@BOOK.add("src21_join7_unseen", "SELECT delivery_id FROM news_item WHERE batch_id >= 2018010100 AND title NOT IN (SELECT title FROM news_item WHERE batch_id < 2018010100 AND title IS NOT NULL) AND title IS NOT NULL")
def unseen(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "news_item").where("title is not null")
    return n.where("batch_id >= 2018010100").join(n.where("batch_id < 2018010100").select("title"), "title", "left_anti").select("delivery_id")


@BOOK.add("prj6_join12_ticker_alias", "SELECT DISTINCT file_name, regexp_extract(file_name, '^([^_]+)_', 1) AS ticker, asset_name FROM social_post LEFT JOIN asset_dim ON ticker = regexp_extract(file_name, '^([^_]+)_', 1)")
def ticker_alias(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "social_post").select("file_name", F.regexp_extract("file_name", "^([^_]+)_", 1).alias("ticker")).distinct()
    return names.join(F.broadcast(table(s, d, "asset_dim").select("ticker", "asset_name")), "ticker", "left").select("file_name", "ticker", "asset_name")


@BOOK.add("join13_category_default", "SELECT id, coalesce(asset_type, 'unknown') AS category FROM (SELECT DISTINCT id, upper(trim(asset)) AS a FROM social_post) LEFT JOIN asset_dim ON ticker = a")
def category(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "social_post").select("id", F.upper(F.trim("asset")).alias("ticker")).distinct()
    return p.join(F.broadcast(table(s, d, "asset_dim").select("ticker", "asset_type")), "ticker", "left").select("id", F.coalesce("asset_type", F.lit("unknown")).alias("category"))


@BOOK.add("src24_join14_search_queries", "SELECT ticker, term, strftime(m, '%Y-%m-%d') AS month_start, strftime(last_day(m), '%Y-%m-%d') AS month_end, term || ' after:' || strftime(m, '%Y-%m-%d') || ' before:' || strftime(last_day(m), '%Y-%m-%d') AS query FROM (SELECT ticker, unnest(search_terms) AS term FROM asset_dim), (SELECT unnest(generate_series(TIMESTAMP '2023-01-01', TIMESTAMP '2023-12-01', INTERVAL 1 MONTH)) AS m)")
def search_queries(s: SparkSession, d: str) -> DataFrame:
    terms = table(s, d, "asset_dim").select("ticker", F.explode("search_terms").alias("term"))
    rows = terms.select("ticker", "term", F.explode(F.sequence(F.lit("2023-01-01").cast("date"), F.lit("2023-12-01").cast("date"), F.expr("interval 1 month"))).alias("m"))
    a, b = F.date_format("m", "yyyy-MM-dd"), F.date_format(F.last_day("m"), "yyyy-MM-dd")
    return rows.select("ticker", "term", a.alias("month_start"), b.alias("month_end"), F.concat("term", F.lit(" after:"), a, F.lit(" before:"), b).alias("query"))


@BOOK.add("agg13_totals_and_groups", f"WITH {DOCS} SELECT source, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars, grouping(source) AS is_total FROM d GROUP BY GROUPING SETS ((source), ())")
def totals(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).groupingSets([[F.col("source")], []], "source").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"), num(F.grouping("source")).alias("is_total"))


@BOOK.add("agg14_distinct_counts", "SELECT count(DISTINCT site) AS sites, count(DISTINCT strftime(received_at, '%Y-%m')) AS months, count(DISTINCT publisher) AS publishers FROM news_item")
def distinct_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_item").agg(F.countDistinct("site").alias("sites"), F.countDistinct(F.date_format("received_at", "yyyy-MM")).alias("months"), F.countDistinct("publisher").alias("publishers"))


@BOOK.add("agg30_min_max_scaling", "SELECT asset, round((original_count - min(original_count) OVER ()) / nullif(max(original_count) OVER () - min(original_count) OVER (), 0), 6) AS scaled FROM cleaning_stats")
def scaling(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "cleaning_stats").select("asset", "original_count")
    ends = c.agg(F.min("original_count").alias("a"), F.max("original_count").alias("b"))
    return rounded(c.join(F.broadcast(ends), F.lit(True)).select("asset", ((F.col("original_count") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0))).alias("scaled")))


@BOOK.add("topk3_longest_lines", f"WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line DESC) AS k FROM l) SELECT doc_id, string_agg(line, ' ' ORDER BY k) AS value FROM r WHERE k <= 20 GROUP BY 1")
def longest_lines(s: SparkSession, d: str) -> DataFrame:
    sized = F.sort_array(F.transform(F.split("t", "\n"), lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))), False)
    return docs(s, d).select("doc_id", F.array_join(F.transform(F.slice(sized, 1, 20), lambda x: x["line"]), " ").alias("value"))


@BOOK.add("set3_distinct_words", rf"WITH {POSTS}, u AS (SELECT DISTINCT id, file_name, t FROM p), w AS (SELECT id, file_name, unnest({WORDS}) AS word, unnest(range(1, len({WORDS}) + 1)) AS k FROM u), f AS (SELECT id, file_name, word, min(k) AS k FROM w GROUP BY 1, 2, 3), v AS (SELECT id, file_name, string_agg(word, ' ' ORDER BY k) AS value FROM f GROUP BY 1, 2) SELECT id, coalesce(value, '') AS value FROM u LEFT JOIN v USING (id, file_name)")
def distinct_words(s: SparkSession, d: str) -> DataFrame:
    return posts(s, d).select("id", "file_name", "t").distinct().select("id", F.array_join(F.array_distinct(T.words(F.col("t"))), " ").alias("value"))


@BOOK.add("cond2_default_strings", rf"SELECT delivery_id, trim(coalesce(symbol, '')) AS symbol, trim(coalesce(title, '')) AS title, trim(coalesce(image, '')) AS image FROM news_item")
def default_strings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_item").select("delivery_id", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("symbol", "title", "image")])


@BOOK.add("html2_main_text", None)
def main_text(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", html.main_text("t").alias("value"))


@BOOK.add("html1_html2_page_parts", None)
def page_parts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", html.page_parts("t").alias("p")).select("doc_id", "p.*")


@BOOK.add("html2_article_text", None)
def article_text(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", html.article_text("t").alias("value"))


@BOOK.add("html3_paragraphs", None)
def page_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", html.page_paragraphs("t").alias("p")).select("doc_id", "p.*")


@BOOK.add("src25_page_links", None)
def page_links(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.explode(html.page_links(F.col("t"))).alias("url"))


WORDS_OF = lambda t: WORDS.replace("regexp_replace(t,", f"regexp_replace({t},")
QUOTED = "replace(translate(t, '“”‘’–—', '\"\"''''--'), '…', '...')"
ARTICLES = rf"""{DOCS}, e AS (SELECT doc_id, t, {WORDS_OF('lower(t)')} AS w FROM d WHERE length(regexp_replace(regexp_replace(t, '^[{WS}]+', ''), '[{WS}]+$', '')) > 20),
g AS (SELECT doc_id, t FROM e WHERE length(regexp_replace(t, '[^a-zA-Z0-9 \t\n\r\f.,!?;:''"()-]', '', 'g')) / nullif(length(t), 0) >= 0.7 OR len(list_filter(w, lambda x: list_contains([{", ".join(map(lit, T.ENGLISH_WORDS))}], x))) / nullif(least(len(w), 100), 0) > 0.1),
b AS (SELECT doc_id, {boiler_sql(QUOTED)} AS t FROM g),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda y: {STRIPPED.replace('regexp_replace(y', 'regexp_replace(lower(y)')}), lambda x: length(x) >= 10 AND {PLAIN}) AS kept FROM b),
c AS (SELECT doc_id, array_to_string(list_filter(list_transform(list_transform(kept, lambda y: regexp_replace(y, '\b(ad|ads|advertisement|sponsored)\b', '', 'g')), lambda y: {STRIPPED}), lambda x: length(x) > 5), chr(10)) AS t FROM l),
k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9{WS}%+\-.,!?$''";:()@#&]', ' ', 'g'), '[{WS}]+', ' ', 'g')) AS t FROM c),
m AS (SELECT doc_id, '[NEWS]' || t AS t FROM k WHERE len({WORDS}) BETWEEN 20 AND 5000 AND coalesce(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / nullif({SOLID}, 0), 0) >= 0.7 AND len(regexp_extract_all(t, '[.!?]+')) >= 1),
h AS (SELECT doc_id, t, md5(trim(regexp_replace(lower(substring(t, 1, 1000)), '[{WS}]+', ' ', 'g'))) AS content_hash FROM m)"""


@BOOK.add("flt5_cleaned_articles", f"WITH {ARTICLES} SELECT doc_id, t AS text, content_hash, CAST(len({WORDS}) AS INTEGER) AS word_count, CAST(length(t) AS INTEGER) AS char_count FROM h QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1")
def articles(s: SparkSession, d: str) -> DataFrame:
    return corpus.clean_articles(table(s, d, "documents").select("doc_id", "text"), min_words=20, unicode_form=False)


@BOOK.add("str1_cleaned_articles_nfkc", None)
def articles_nfkc(s: SparkSession, d: str) -> DataFrame:
    return corpus.clean_articles(table(s, d, "documents").select("doc_id", "text"), min_words=20)


def lexicon_model():
    """A model of three logits a text, by words of rise and fall, to be used where no other is given."""
    import re

    import numpy as np

    up, down = (re.compile("|".join(rf"\b{re.escape(k)}\b" for k in ks)) for ks in (T.POSITIVE, T.NEGATIVE))
    return lambda texts: np.array([[len(up.findall(x.lower())), len(down.findall(x.lower())), 0.5] for x in texts], float)


@BOOK.add("ml2_batched_scores", None)
def batched_scores(s: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.score_batches(table(s, d, "news_item"), "delivery_id", "text", lexicon_model, ("Positive", "Negative", "Neutral")))
