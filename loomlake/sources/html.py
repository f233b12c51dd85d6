"""HTML: a whitelist cleaner for wiki pages (Arrow batches over the standard library's parser) and tables from rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# What a cleaned page may hold.
TAGS = set("h1 h2 h3 h4 h5 h6 p ul ol li table thead tbody tr th td pre code blockquote strong em a br".split())
ATTRIBUTES = {"a": {"href"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}}
DROPPED = {"script", "style", "nav", "footer", "aside", "form", "noscript", "template"}
VOID = {"br", "img", "hr", "meta", "link", "input"}


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list] = [["", []]]  # open elements: opening tag and content
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        tag = tag.rpartition(":")[2]  # a namespace prefix is unwrapped
        if tag in DROPPED:
            self.skip += 1
        elif self.skip:
            pass
        elif tag == "img":
            label = dict(attrs).get("alt") or (dict(attrs).get("src") or "").rpartition("/")[2]
            self.out[-1][1].append(f"[image: {label}]" if label else "")
        elif tag == "br":
            self.out[-1][1].append("<br>")
        elif tag in TAGS:
            kept = "".join(f' {k}="{v}"' for k, v in attrs if k in ATTRIBUTES.get(tag, ()) and v)
            self.out.append([f"<{tag}{kept}>", [], tag])

    def handle_endtag(self, tag):
        tag = tag.rpartition(":")[2]
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in TAGS and tag not in VOID and any(e[2:] == [tag] for e in self.out):
            while True:
                opened, content, name = self.out.pop()
                body = "".join(content)
                if body.strip():  # empty elements go, and so, from inside out, those that held only them
                    self.out[-1][1].append(f"{opened}{body}</{name}>")
                if name == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            self.out[-1][1].append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def clean_html(html: str | None) -> str:
    c = _Cleaner()
    c.feed((html or "").replace("<![CDATA[", "").replace("]]>", ""))
    c.close()
    while len(c.out) > 1:
        c.handle_endtag(c.out[-1][2])
    return "".join(c.out[0][1]).strip()


def clean_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `cleaned` instead of the raw HTML."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def clean(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(clean_html)

    return pages.withColumn("cleaned", clean(html)).drop(html)


def sheet_to_html(rows: DataFrame, sheet: str, order: str, columns: list[str], most: int) -> DataFrame:
    """One HTML table per sheet from its first `most` rows."""
    from ..operators.relational import latest_by

    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    top = latest_by(rows.select(sheet, order, cells.alias("tr")), [sheet], [F.asc(order)], most)
    return top.groupBy(sheet).agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "tr"))), lambda s: s["tr"]), ""), F.lit("</table>")).alias("html"))
