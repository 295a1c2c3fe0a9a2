import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from marlstone.functions import html, text, web
from marlstone.operators import corpus

TEXTS = ["", "  ", "Buy $ABC now! http://x.co/1 up", "a b　c", "P/E and EPS +5% long-term a+b", "éup up", "$ABC $XYZ $9", "<p>hi</p> www.a.b c", "Ｆｕｌｌ ①", None, "x " * 600]


def values(spark, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_counts_match_python(spark):
    count = lambda t, ks: sum(len(re.findall(r"\b" + re.escape(k) + r"\b", t.lower())) for k in ks)
    for ks in (text.POSITIVE, text.NEGATIVE, text.FINANCE_KEYWORDS):
        assert values(spark, text.keyword_count(F.col("t"), ks)) == [None if t is None else count(t, ks) for t in TEXTS]
    assert values(spark, text.n_words(F.col("t")))[:9] == [len(t.split()) for t in TEXTS[:9]]


def test_squeeze_and_words(spark):
    assert values(spark, text.squeeze(F.col("t")))[3] == "a b c"
    assert len(values(spark, text.first_words(F.col("t"), 500))[10].split()) == 500


def test_nfkc(spark):
    assert values(spark, text.nfkc(F.col("t"))) == [None if t is None else unicodedata.normalize("NFKC", t) for t in TEXTS]


def test_tag_share(spark):
    assert values(spark, text.tag_share(F.col("t")))[6] == pytest.approx(2 / 3)


def test_lexicon_and_signed_average(spark):
    df = spark.createDataFrame([("g", "up up down"), ("g", "down"), ("h", "nothing"), ("h", " "), ("h", None)], "k string, t string")
    label, score = corpus.lexicon_label(F.col("t"))
    rows = df.select("k", label.alias("label"), score.alias("score"))
    assert [r.label for r in rows.collect()] == ["Positive", "Negative", "Neutral", "Error", "Error"]
    got = corpus.monthly_sentiment(rows, ["k"]).collect()
    assert [(r.k, r.average_score) for r in got] == [("g", pytest.approx((1 / 3 - 1) / 2))]


def test_pad_neutral_makes_no_rows(spark):
    m = spark.createDataFrame([(2011, 1, None), (2012, 1, None), (2012, 2, 0.5)], "year int, month int, A double")
    assert [(r.year, r.month, r.A) for r in corpus.pad_neutral(m, 2012, 2024).collect()] == [(2011, 1, None), (2012, 1, 0.0), (2012, 2, 0.5)]


def test_pages_and_moments(spark):
    df = spark.createDataFrame([("http://WWW.A.example/B/?x=1&utm_source=q#f", "2020-01-02T03:04:05+02:00"), (None, "bad"), ("a.example", "2020-01-02")], "u string, m string")
    got = [(r.p, r.s) for r in df.select(web.page(F.col("u")).alias("p"), F.unix_micros(web.moment(F.col("m"))).alias("s")).collect()]
    assert got == [("a.example/B?x=1", 1577927045_000000), ("", None), ("a.example", 1577923200_000000)]


LONG = "The board of the firm said on Monday that sales had grown faster than planned in spring. " * 8
PAGE = f"""<html><head><title>Site - Story</title><meta name="description" content="short"><meta property="og:description" content="A longer description of it">
<meta property="article:published_time" content="2024-05-01"></head><body><nav>Home News</nav><h1> The  story </h1><script>var x</script><p class="byline">By A. Writer</p>
<div class="content"><p>Too short here.</p></div><article><p>{LONG}</p><a href="https://x.example/1">a</a><a href="https://skip.example/2">b</a><a href="/rel">c</a><a href="https://x.example/1">d</a></article>
<div class="post-list">{"x " * 40}</div><footer>Copyright</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([("<title>T</title><script>x</script><p>One <b>two</b></p><nav>n</nav><div>three</div>",), (None,), ("<![8 x>y",), ("",)], "h string")
    assert [r[0] for r in pages.select(html.main_text("h")).collect()][:2] == ["One two\nthree", None]
    assert pages.select(html.title("h")).first()[0] == "T"
    for f in (html.page_parts, html.page_paragraphs):
        assert len(pages.select(f("h").alias("p")).select("p.*").collect()) == 4
    df = spark.createDataFrame([(PAGE,), (None,)], "h string")
    assert df.select(html.page_links(F.col("h"), ("skip.example",))).collect()[0][0] == ["https://x.example/1"] and df.select(html.article_text("h")).collect()[1][0] is None


def test_parts_of_a_page():
    title, description, content, date, author = html.parts(PAGE)
    assert (title, description, date, author) == ("The  story", "A longer description of it", "2024-05-01", "By A. Writer")
    assert content == (LONG.strip() + " a b c d")  # the longest content element
    assert html.parts("<p>plain words of a page without any element for its content</p>")[2] == "plain words of a page without any element for its content"
    assert html.parts("<title>" + "t" * 300 + "</title>")[0] == "t" * 200 + "..." and html.parts("")[:3] == ("", "", "")
    assert html.parts("<time datetime='2020-01-01'>May</time>")[3] == "2020-01-01" and html.parts("<span class='x date'>May</span>")[3] == "May"


def test_article_of_a_page():
    assert html.article(PAGE) == LONG.strip() + " a b c d"  # more than 100 words in a content element
    words = " ".join(["sales rose again in the south and fell in the north of the land"] * 3)
    pieces = "".join(f"<p>{words} {'x ' * i}</p>" for i in range(25))
    text = html.article(f"<body><div class='sidebar'><p>{words} left out</p></div><p>our news: {words}</p>{pieces}</body>")
    assert text.split(" x")[0].startswith(words) and "news" not in text and "left out" not in text
    assert len(text.split()) == 20 * len(words.split()) + sum(range(5, 25))  # the 20 longest
    flat = "<body><b>" + ". ".join(f"This is the plain sentence number {i} of the page" for i in range(30)) + ". Read more. Short one</b></body>"
    assert html.article(flat).startswith("This is the plain sentence number 0") and "Read more" not in html.article(flat)
    assert html.article("<p>short</p>") == ""


def test_paragraphs_of_a_page():
    assert html.paragraphs("<title>T</title><p>a b</p>x<p>c</p>", 2) == ("T", "a b")
    assert html.paragraphs("<p>a</p>") == ("No title found", "a")


def test_article_cleaner(spark):
    body = "The Ads market rose again in the south and the firm said that sales grew. " * 3 + "\nabout us here\nSee www.x.example/1 for the rest of it\nad ads 12\nShares of the firm were up and they had grown — “fast” §"
    rows = [(2, "A title of it!", body), (1, "A title of it", body), (3, "T", body + " more"), (4, "x", "короткий текст"), (5, "x", None), (6, "x", "the and for " * 10)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id int, title string, text string, word_count int")
    got = {r.doc_id: r for r in corpus.clean_articles(df, title="title", min_words=20).collect()}
    assert set(got) == {1, 3}
    assert got[1].text.startswith("[NEWS]A title of it.the  market rose".replace("  ", " ")) and "about us" not in got[1].text and "www" not in got[1].text and 'grown - "fast"' in got[1].text and "§" not in got[1].text
    assert got[3].text.startswith("[NEWS]the market") and got[3].word_count == len(got[3].text.split())
    assert corpus.clean_articles(df.limit(0), title="title").count() == 0


def test_batched_scores(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["up", "down", " ", None, "even"] * 20)], "id int, text string")

    def load():
        import numpy as np

        def model(texts):
            assert len(texts) <= 8
            return np.array([[3.0 * (t == "up"), 3.0 * (t == "down"), 1.0] for t in texts])

        return model

    got = corpus.score_batches(rows, "id", "text", load, ("P", "N", "U"), batch=8).orderBy("id").collect()
    assert [r.label for r in got[:5]] == ["P", "N", "Error", "Error", "U"] and len(got) == 100 and got[2].score == 0 and got[0].score > 0.8
    a = corpus.accuracy(spark.createDataFrame([("P", "P"), ("P", "N"), (None, "P"), ("N", None)], "t string, g string"), F.col("t"), F.col("g")).first()
    assert (a.n, a.correct, a.accuracy) == (3, 1, pytest.approx(1 / 3))


def test_small_text_functions(spark):
    assert values(spark, text.keep_allowed_spaced(F.col("t")))[:3] == ["", "", "Buy $ABC now! http: x.co 1 up"]
    df = spark.createDataFrame([("^GSPC/x", "a, b,,C "), (None, None)], "n string, l string")
    assert [tuple(r) for r in df.select(text.safe_name(F.col("n")), text.symbol_list(F.col("l"))).collect()] == [("GSPC_x", ["A", "B", "C"]), (None, None)]


def test_clean_posts_keeps_the_first_of_equal_texts(spark):
    rows = [(2, "f", "the market will rise again soon"), (1, "f", "the market will rise again soon http://a.b"), (3, "g", "the market will rise again soon"), (4, "f", "short text here"), (5, "f", None), (6, "f", "$A $B $C $D $E $F"), (7, "f", "1234567 8901234 text more words x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, file_name string, text string, was_cut string")
    got = corpus.clean_posts(df)
    assert {(r.id, r.text) for r in got.collect()} == {(1, "[STOCKTWITS] the market will rise again soon"), (3, "[STOCKTWITS] the market will rise again soon")}
    assert corpus.clean_posts(df.limit(0)).count() == 0


def test_main_text_sees_every_document(spark, tmp_path):
    from marlstone.plans import corpus_queries

    texts = ["<p>One</p><p>two", "<p>cut pa", "plain  text", "a<br>b", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, corpus_queries.main_text(spark, str(tmp_path)).collect()))
    assert got == {0: "One\ntwo", 1: "cut pa", 2: "plain text", 3: "a\nb", 4: "", 5: ""}
