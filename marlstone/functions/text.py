"""Column expressions of the corpus cleaner: all but the Unicode form run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# White space as Unicode has it, spelled out as engines differ in what \s means.
WS = r" \t\n\r\f\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Remains of web pages.
WEB_KEYWORDS = ("http", "www", ".com", ".org", "href=", "<div", "<p", "<br", "&amp;", "&#39;")
# Words of finance.
FINANCE_KEYWORDS = (
    "stock", "stocks", "equity", "equities", "share", "shares", "market", "trading", "trade", "invest", "investment", "portfolio", "price", "prices", "valuation", "value", "premium", "discount",
    "PE", "P/E", "EPS", "dividend", "yield", "ROI", "return", "bond", "bonds", "commodity", "commodities", "future", "futures", "inflation", "deflation", "GDP", "unemployment", "interest rate",
    "earnings", "revenue", "profit", "loss", "merger", "acquisition", "bull", "bear", "rally", "crash", "volatility", "liquidity",
)
# Words of rise and fall.
POSITIVE = ("+", "rise", "rising", "rose", "up", "gain", "gaining", "gained", "higher", "high", "peak", "surge", "jump", "increase", "increasing", "bull", "bullish", "buy", "long", "outperform", "beat")
NEGATIVE = ("-", "fall", "falling", "fell", "down", "loss", "losing", "lost", "lower", "low", "bottom", "plunge", "drop", "decrease", "decreasing", "bear", "bearish", "sell", "short", "underperform", "miss")
# Terms that mark an article as financial.
TERMS = (
    "stock", "market", "price", "index", "invest", "trade", "share", "dollar", "euro", "yen", "pound", "currency", "exchange", "rate", "yield", "dividend", "profit", "revenue", "earnings", "economic", "economy", "growth", "inflation", "interest",
    "federal", "central bank", "monetary", "policy", "crisis", "volatility", "risk", "return", "portfolio", "asset", "bond", "commodity", "future", "option", "derivative", "hedge", "bull", "bear", "rally", "crash", "correction", "recession",
)
# Words of page furniture, and of a page's navigation.
REMOVED = (
    "cookie", "privacy policy", "terms of use", "subscribe", "newsletter", "related articles", "share this", "comment", "login", "sign up", "advertisement", "sponsored content", "follow us", "copyright", "all rights reserved", "reprint", "click here", "read more",
    "sign in", "register", "log in", "sign out", "follow",
)
NAVIGATION = ("home", "news", "business", "sports", "entertainment", "technology", "health", "science", "world", "politics", "opinion", "life", "travel", "video", "photos", "weather", "market data", "search", "menu", "navigation", "navbar", "sidebar")
JUNK = REMOVED + NAVIGATION
# Boilerplate, from the phrase to the end of the text for those that end in .*
BOILERPLATE = (
    "Advertisement", "Sponsored", "Click here.*", "Read more.*", "Sign up.*", "Subscribe.*", "Follow us.*", "Like us.*", "Share this.*", "Comment.*", "Related:.*", "Also read.*", "More from.*", "Previous article.*", "Next article.*", "©.*", "Copyright.*", "All rights reserved.*",
    "Terms of Use.*", "Privacy Policy.*", "Cookie Policy.*", r"var\s+.*?=.*?;", r"function\s+.*?\(.*?\)\s*\{.*?\}", "<script.*?>.*?</script>", "<style.*?>.*?</style>", r"\[.*?\]", r"\(.*?\)",
)
# Common English words of the crawled-text test.
ENGLISH_WORDS = ("the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use").split()


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def strip_web(t: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(t, rf"http[^{WS}]+|www\.[^{WS}]+", ""), "<[^>]+>", "")
    return reduce(lambda c, k: F.replace(c, F.lit(k), F.lit("")), WEB_KEYWORDS, t)


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, f"[{WS}]+", " "))


def keep_allowed(t: Column) -> Column:
    """Letters, digits and % + . ? ! $ of ASCII; others are deleted, so that double blanks may come back."""
    return F.regexp_replace(t, r"[^A-Za-z0-9 %+.?!$]", "")


def ascii_quotes(t: Column) -> Column:
    return F.replace(F.translate(t, "“”‘’–—", "\"\"''--"), F.lit("…"), F.lit("..."))


def solid(t: Column) -> Column:
    """Length without blanks."""
    return F.length(F.replace(t, F.lit(" "), F.lit("")))


def _left(t: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(t, pattern, ""))


def english_share(t: Column) -> Column:
    """ASCII letters and white space by the length without blanks; may be above 1."""
    return _left(t, r"[^A-Za-z \t\n\r\f\x0B]") / F.nullif(solid(t), F.lit(0))


def is_english(t: Column, least: float = 0.7) -> Column:
    return F.coalesce((F.length(squeeze(t)) >= 10) & (english_share(t) >= least), F.lit(False))


def letter_share(t: Column) -> Column:
    return _left(t, r"[^\p{L}]") / F.nullif(solid(t), F.lit(0))


def ascii_share(t: Column) -> Column:
    return F.coalesce(_left(t, "[^A-Za-z]") / F.nullif(solid(t), F.lit(0)), F.lit(0.0))


def digit_share(t: Column) -> Column:
    return F.coalesce(_left(t, "[^0-9]") / F.nullif(solid(t), F.lit(0)), F.lit(0.0))


def words(t: Column) -> Column:
    s = squeeze(t)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def n_words(t: Column) -> Column:
    return F.size(words(t))


def tag_share(t: Column) -> Column:
    """Share of words that begin with $ and a sign that is no digit."""
    w = words(t)
    return F.coalesce(F.size(F.filter(w, lambda x: x.rlike(r"^\$[^0-9]"))) / F.nullif(F.size(w), F.lit(0)), F.lit(0.0))


def first_words(t: Column, n: int) -> Column:
    w = words(t)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(t)


def _escaped(k: str) -> str:
    return "".join("\\" + c if c in "+-/.$" else c for c in k)


def keyword_counts(t: Column, **lists: tuple[str, ...]) -> Column:
    """A struct of counts: occurrences of each list's keywords between word boundaries in the lower-case text, added up.

    The text is cut into words once for all lists; keywords that are no single word are searched for in the text. A keyword
    with capitals is in no lower-case text. Null for a null text.
    """
    bound = F.transform(F.array(F.lower(t)), lambda low: F.struct(low.alias("low"), F.split(low, r"[^\p{L}\p{M}\p{N}_]+").alias("words")))

    def count(x: Column, keywords: tuple[str, ...]) -> Column:
        small = [k for k in keywords if k == k.lower()]
        words = [k for k in small if k.isalpha()]
        total = F.size(F.filter(x["words"], lambda w: w.isin(words))) if words else F.lit(0)
        for k in small:
            if k not in words:
                total = total + F.when(F.contains(x["low"], F.lit(k)), F.regexp_count(x["low"], F.lit(rf"\b{_escaped(k)}\b"))).otherwise(0)
        return total

    return F.when(t.isNotNull(), F.transform(bound, lambda x: F.struct(*[count(x, ks).alias(n) for n, ks in lists.items()]))[0])


def keyword_count(t: Column, keywords: tuple[str, ...]) -> Column:
    """Occurrences of one list's keywords, as in keyword_counts."""
    return keyword_counts(t, n=keywords)["n"]


def found_terms(t: Column, terms: tuple[str, ...] = TERMS, most: int = 10) -> Column:
    """The first terms, in the dictionary's order, that the lower-case text contains."""
    low = F.lower(t)
    return F.slice(F.filter(F.array(*map(F.lit, terms)), lambda k: F.contains(low, k)), 1, most)


def sentences(t: Column) -> Column:
    return F.regexp_count(t, F.lit("[.!?]+"))


def content_key(t: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(F.lower(F.substring(t, 1, 1000)), f"[{WS}]+", " ")))


def strip_boilerplate(t: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, f"(?is){p}", " "), BOILERPLATE, t)


def strip(t: Column) -> Column:
    """The text without white space around it."""
    return F.regexp_replace(t, f"^[{WS}]+|[{WS}]+$", "")


def content_lines(t: Column) -> Column:
    """Lines of ten or more characters without page furniture, address or short navigation, less words of advertising; lower case.

    What has five characters or fewer without those words is dropped too.
    """
    low = F.transform(F.split(t, "\n"), lambda x: strip(F.lower(x)))
    junk = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(k)) for k in JUNK])
    address = lambda x: x.rlike(r"https?://|www\.|\.[a-z]{2,3}/")
    lead = lambda x: (n_words(x) < 5) & x.rlike("^(home|news|about)")
    kept = F.filter(low, lambda x: (F.length(x) >= 10) & ~junk(x) & ~address(x) & ~lead(x))
    said = F.transform(kept, lambda x: strip(F.regexp_replace(x, r"\b(ad|ads|advertisement|sponsored)\b", "")))
    return F.array_join(F.filter(said, lambda x: F.length(x) > 5), "\n")


def keep_allowed_spaced(t: Column) -> Column:
    """Letters, digits and common punctuation of ASCII; every other sign is a blank, and blanks are squeezed."""
    return squeeze(F.regexp_replace(t, rf"""[^a-zA-Z0-9{WS}%+\-.,!?$'";:()@#&]""", " "))


def sentence_length(t: Column) -> Column:
    """Words a sentence, 0 without sentence end, in two places."""
    return F.round(F.coalesce(n_words(t) / F.nullif(sentences(t), F.lit(0)), F.lit(0.0)), 2)


def news_format(title: Column, content: Column) -> Column:
    """[NEWS]title.content with the title's word signs, blanks and hyphens, if it has more than two words, else [NEWS]content."""
    clean = strip(F.substring(F.regexp_replace(title, rf"(?U)[^\w{WS}\-]", ""), 1, 150))
    return F.when(F.coalesce(n_words(clean) > 2, F.lit(False)), F.concat(F.lit("[NEWS]"), clean, F.lit("."), content)).otherwise(F.concat(F.lit("[NEWS]"), content))


def safe_name(t: Column) -> Column:
    """A ticker as a file name: without ^, and with _ for /."""
    return F.translate(t, "/^", "_")


def symbol_list(t: Column) -> Column:
    """Upper-case symbols of a comma-separated list, blank ones left out."""
    return F.filter(F.transform(F.split(t, ","), lambda x: F.upper(strip(x))), lambda x: x != "")


def crawled_english(t: Column) -> Column:
    """Mostly Latin signs, or more than a tenth of the words common English ones."""
    share = _left(t, r"""[^a-zA-Z0-9 \t\n\r\f.,!?;:'"()-]""") / F.nullif(F.length(t), F.lit(0))
    w = words(F.lower(t))
    common = F.size(F.filter(w, lambda x: x.isin(ENGLISH_WORDS))) / F.nullif(F.least(F.size(w), F.lit(100)), F.lit(0))
    return F.coalesce((F.length(F.trim(t)) >= 20) & ((share >= 0.7) | (common > 0.1)), F.lit(False))


def clean_address(u: Column, redirects: dict[str, str] | None = None, skipped: tuple[str, ...] = ()) -> Column:
    """Trimmed address with a scheme, single slashes and no anchor; '' for a host that is skipped."""
    u = F.regexp_replace(F.coalesce(u, F.lit("")), f"[{WS}]+", "")
    for a, b in (redirects or {}).items():
        u = F.replace(u, F.lit(a), F.lit(b))
    u = F.when(u == "", u).when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    u = F.regexp_replace(F.regexp_replace(u, "(?<!:)/{2,}", "/"), "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^[^:]+://([^/?]*)", 1))
    bad = reduce(lambda a, b: a | b, [F.contains(host, F.lit(s)) for s in skipped]) if skipped else F.lit(False)
    return F.when(bad, "").otherwise(u)


def domain(u: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^:]+://([^/?#]*)", 1)), r"^www\.", "")
