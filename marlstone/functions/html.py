"""Parts of web pages with the standard parser, in Arrow batches.

A page becomes a small tree of elements; parts are chosen by selectors `tag.class[attribute="value"]` in the order of their
lists. Every function gives null for a null page, and an empty part for one that isn't there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from marlstone.functions.text import JUNK, NAVIGATION

# Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements that are no content.
FURNITURE = "script style nav footer aside header iframe noscript form button".split()
BODY_FURNITURE = "script style nav footer header aside iframe form button input select textarea svg canvas noscript".split()
FURNITURE_CLASS = re.compile("nav|menu|sidebar|ad|banner|promo|popup|modal|cookie")
BLOCKS = frozenset("p div article section main td li h1 h2 h3 br tr".split())
# Selectors of each part, in the order of their priority.
TITLE = ("h1", 'h1[class*="title"]', 'h1[class*="headline"]', "title", 'meta[property="og:title"]', 'meta[name="twitter:title"]', 'meta[name="title"]', '[data-testid="headline"]', ".headline", ".article-title", ".post-title", ".entry-title", ".story-title", ".news-title")
DESCRIPTION = ('meta[name="description"]', 'meta[property="og:description"]', 'meta[name="twitter:description"]', 'meta[name="snippet"]', ".article-excerpt", ".post-excerpt", ".summary", ".deck", ".subhead", ".article-summary")
CONTENT = (
    "article", "main", '[role="main"]', ".article-content", ".post-content", ".entry-content", ".story-body", ".content", ".article-body", ".post-body", '[class*="content"]', '[class*="article"]', '[class*="post"]', '[class*="story"]',
    'div[itemprop="articleBody"]', "div.zn-body__paragraph", ".article-text", ".story-text", ".text-content", ".fin-content", ".market-news-content", ".financial-content", ".news-article-body",
)
DATE = ("time[datetime]", 'meta[property="article:published_time"]', 'meta[name="publish_date"]', 'meta[name="date"]', 'meta[property="og:published_time"]', '[itemprop="datePublished"]', ".date", ".published", ".timestamp", ".article-date", ".post-date", ".dateline", ".publish-date")
AUTHOR = ('meta[name="author"]', 'meta[property="article:author"]', '[itemprop="author"]', ".author", ".byline", ".article-author", ".post-author", '[rel="author"]', ".writer", ".reporter")
ARTICLE = (
    "article", '[class*="article"]', '[class*="content"]', '[class*="story"]', '[class*="post-content"]', '[class*="article-body"]', '[class*="article-content"]', ".article__content", ".story-body", ".post-content", ".entry-content", ".article-text",
    ".articleBody", ".content-article", ".story-content", ".article-content", '[itemprop="articleBody"]', ".article__body",
)


class Node:
    """An element: its tag, attributes and what is in it."""

    __slots__ = ("tag", "attrs", "inner")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.inner = tag, attrs, []

    def elements(self) -> Iterator[Node]:
        """The elements inside, in the order of the page."""
        stack = [x for x in reversed(self.inner) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.inner) if isinstance(x, Node)]

    def strings(self) -> list[str]:
        """Trimmed texts inside that aren't blank, in the order of the page."""
        out, stack = [], list(reversed(self.inner))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.inner)
            elif x := x.strip():
                out.append(x)
        return out

    def raw(self) -> str:
        out, stack = [], list(reversed(self.inner))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.inner)
            else:
                out.append(x)
        return "".join(out)

    def without(self, unwanted: Callable[[Node], bool]) -> Node:
        """Takes the unwanted elements out, in place."""
        for node in (self, *self.elements()):
            node.inner = [x for x in node.inner if not (isinstance(x, Node) and unwanted(x))]
        return self

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inner.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].inner.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].inner.append(data)


def tree(page: str) -> Node:
    t = Tree()
    try:
        t.feed(page)
        t.close()
    except AssertionError:  # signs that look like a declaration: no page, its tags are just dropped
        t.root.inner.append(re.sub("<[^>]*>", " ", page))
    return t.root


@cache
def selector(text: str) -> Callable[[Node], bool]:
    """Whether an element fits `tag.class[attribute]`, `[attribute="value"]` or `[attribute*="part"]`."""
    tag, classes, attributes = re.fullmatch(r"(\w*)((?:\.[\w-]+)*)((?:\[[^\]]+\])*)", text).groups()
    wanted = [c for c in classes.split(".") if c]
    asked = re.findall(r'\[([\w-]+)(?:(\*?=)"([^"]*)")?\]', attributes)

    def fits(node: Node) -> bool:
        if tag and node.tag != tag or wanted and not set(wanted) <= set(node.classes()):
            return False
        for name, how, value in asked:
            have = node.attrs.get(name)
            if have is None or how == "*=" and value not in have or how == "=" and value != have:
                return False
        return True

    return fits


def matches(root: Node, text: str) -> Iterator[Node]:
    fits = selector(text)
    return (n for n in root.elements() if fits(n))


def first_value(root: Node, selectors: tuple[str, ...], by_attribute: Callable[[str], tuple[str, ...]], least: int = 0) -> str:
    """The first selector's value that has more than `least` characters; of each selector the first element counts."""
    for s in selectors:
        node = next(matches(root, s), None)
        if node is None:
            continue
        names = by_attribute(s)
        value = next((node.attrs[n] for n in names if n in node.attrs), None)
        if value is None and (not names or s.startswith(("time", '[itemprop="date'))):
            value = "".join(node.strings())
        if value and len(value) > least:
            return value.strip()
    return ""


def parts(page: str) -> tuple[str, str, str, str, str]:
    """(title, description, content, publish_date, author) of a page.

    Content is the longest element of a content selector if it has more than 100 characters, else the body, in one line; none
    if it has 20 characters or fewer. A title is cut behind 200 characters, a description has more than 20.
    """
    root = tree(page).without(lambda n: n.tag in FURNITURE)
    meta = lambda s: ("content",) if s.startswith("meta") else ()
    title = first_value(root, TITLE, meta)
    title = title[:200] + "..." if len(title) > 200 else title
    description = first_value(root, DESCRIPTION, meta, 20)
    date = first_value(root, DATE, lambda s: ("datetime", "content") if s.startswith(("time", "[itemprop")) else meta(s))
    author = first_value(root, AUTHOR, lambda s: ("content",) if s.startswith(("meta", "[itemprop")) else ())
    best, most = None, 100
    for s in CONTENT:
        for node in matches(root, s):
            if (n := sum(map(len, node.strings()))) > most:
                best, most = node, n
    best = best or next(matches(root, "body"), root)
    content = " ".join(" ".join(best.strings()).split())
    return title, description, content if len(content) > 20 else "", date, author


def article(page: str) -> str:
    """The article of a page of at least 1000 characters, '' if none is found.

    The first content element of more than 100 words; else the 20 longest paragraphs of 10 to 500 words that name no
    navigation, if they have more than 50 words; else the sentences of 6 to 99 words without furniture, if more than 30.
    """
    if len(page.strip()) < 1000:
        return ""
    root = tree(page)
    for s in ARTICLE:
        for node in matches(root, s):
            text = " ".join(node.strings())
            if len(text.split()) > 100:
                return text
    root.without(lambda n: n.tag in BODY_FURNITURE or any(FURNITURE_CLASS.search(c) for c in n.classes()))
    found = [" ".join(n.strings()) for n in root.elements() if n.tag in ("p", "div")]
    found = [t for t in found if 10 <= len(t.split()) <= 500 and not any(k in t.lower() for k in NAVIGATION)]
    text = " ".join(sorted(found, key=len, reverse=True)[:20])
    if len(text.split()) > 50:
        return text
    said = (x.strip() for x in " ".join(" ".join(root.strings()).split()).split(". "))
    text = ". ".join(x for x in said if 5 < len(x.split()) < 100 and not any(k in x.lower() for k in JUNK))
    return text if len(text.split()) > 30 else ""


def blocks(page: str) -> str:
    """The text of the blocks that are content, one a line."""
    root = tree(page).without(lambda n: n.tag in FURNITURE or n.tag == "title")
    out, stack = [""], list(reversed(root.inner))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out[-1] += x
        elif x is not None and x.tag in BLOCKS:
            out.append("")
            stack += [None, *reversed(x.inner)]
        elif x is not None:
            stack += reversed(x.inner)
        else:
            out.append("")
    return "\n".join(b for b in (" ".join(b.split()) for b in out) if b)


def paragraphs(page: str, most: int = 500) -> tuple[str, str]:
    """(title, first words): the page's title or a note that there is none, and the first words of its paragraphs."""
    root = tree(page)
    title = next(matches(root, "title"), None)
    words = " ".join(n.raw() for n in matches(root, "p")).split()
    return (title.raw() if title is not None else "No title found"), " ".join(words[:most])


def links(page: str, excluded: tuple[str, ...] = ()) -> list[str]:
    """The https addresses of a page's anchors without those of excluded hosts, each once, in the order of the page."""
    found = (n.attrs.get("href", "") for n in matches(tree(page), "a"))
    return list(dict.fromkeys(u for u in found if "https://" in u and not any(h in u for h in excluded)))


def _named(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


@pandas_udf(StringType())
def main_text(pages: pd.Series) -> pd.Series:
    """Blocks that have text, one a line."""
    return pages.map(lambda x: None if x is None else blocks(x))


@pandas_udf(StringType())
def article_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: None if x is None else article(x))


@pandas_udf(_named("title", "description", "content", "publish_date", "author"))
def page_parts(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None,) * 5 if x is None else parts(x) for x in pages], columns=["title", "description", "content", "publish_date", "author"])


@pandas_udf(_named("title", "first_500_words"))
def page_paragraphs(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None else paragraphs(x) for x in pages], columns=["title", "first_500_words"])


def page_links(pages: Column, excluded: tuple[str, ...] = ()) -> Column:
    @pandas_udf(ArrayType(StringType()))
    def found(x: pd.Series) -> pd.Series:
        return x.map(lambda p: None if p is None else links(p, excluded))

    return found(pages)


@pandas_udf(StringType())
def title(pages: pd.Series) -> pd.Series:
    """The page's first heading, or its title."""
    return pages.map(lambda x: None if x is None else first_value(tree(x), TITLE, lambda s: ("content",) if s.startswith("meta") else ()))
