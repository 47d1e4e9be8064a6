"""Articles from HTML: main text, title and Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import trim

MAX_BODY_BYTES = 10 * 1024 * 1024


def article_html(html: Column) -> Column:
    """The inside of the first article element, else of body, else all."""
    inner = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.when(inner != "", inner).when(body != "", body).otherwise(html)


def article_text(html: Column) -> Column:
    return plain(article_html(html))


def plain(html: Column) -> Column:
    """HTML without tags, white space squeezed; the five basic entities are resolved."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title(html: Column) -> Column:
    return trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def title_or(extracted: Column, given: Column) -> Column:
    """The given title where the extracted one is blank."""
    return F.when(trim(F.coalesce(extracted, F.lit(""))) == "", given).otherwise(extracted)


def fetchable(status: Column, body: Column) -> Column:
    return status.between(200, 299) & (F.octet_length(body) <= MAX_BODY_BYTES)


class _Markdown(HTMLParser):
    BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
    SKIPPED = {"script", "style", "nav", "footer", "head", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag in self.BLOCKS:
            self.out.append("\n\n" + ("#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else ""))
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    lines = [line.strip() for line in "".join(parser.out).split("\n")]
    return "\n".join(line for i, line in enumerate(lines) if line or (i and lines[i - 1])).strip()


@F.pandas_udf(T.StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)
