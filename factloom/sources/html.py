"""HTML documents to articles and links, by the standard library's parser inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is never part of an article, and elements that end a line.
SKIPPED = ("script", "style", "nav", "footer", "head", "noscript")
BLOCKS = ("p", "br", "div", "li", "h1", "h2", "h3", "tr", "section", "article")


class _Article(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links = [], [], []
        self.skip, self.in_title = 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        self.in_title = self.in_title or tag == "title"
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag in BLOCKS:
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.text.append(data)


def parse(html: str | None) -> tuple[str, str, list[str]]:
    """Title, text with a line for each block, and the targets of the links."""
    p = _Article()
    p.feed(html or "")
    p.close()
    lines = (" ".join(line.split()) for line in "".join(p.text).split("\n"))
    return " ".join("".join(p.title).split()), "\n".join(x for x in lines if x), p.links


_ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(_ARTICLE)
def article_of(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in html:
        yield pd.DataFrame([parse(h) for h in batch], columns=["title", "body", "links"])


def articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, body and links."""
    return pages.withColumn("_a", article_of(F.col(html))).select(*pages.columns, "_a.title", "_a.body", "_a.links")


def title_of(html: Column) -> Column:
    """The first title as it is written, trimmed, with its &lt;, &gt; and &amp; read; other references, and those cut off, stay."""
    found = F.regexp_extract(html, r"<title>[\t\n\f\r ]*([^<]*?)[\t\n\f\r ]*</title>", 1)
    for reference, letter in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        found = F.replace(found, F.lit(reference), F.lit(letter))
    return found


def canonical_url(url: Column) -> Column:
    """Host without www. or m., and path, without scheme, query, fragment and closing slash: a stable id."""
    host = F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^(www|m)\.", "")
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(host, path)
