"""Web pages: their blocks of text, sections and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements that make blocks, and those without text to read.
BLOCKS = {"h1", "h2", "h3", "h4", "p", "li", "td", "th", "blockquote", "pre", "figcaption", "dt", "dd"}
DROPPED = {"head", "nav", "script", "style", "noscript", "template", "svg"}
VOID = {"br", "hr", "img", "input", "link", "meta", "wbr"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.loose: list[str] = []
        self.tag, self.text, self.hidden = "", [], []

    def flush(self) -> None:
        if clean := " ".join("".join(self.text).split()):
            self.blocks.append((self.tag or "body", clean))
        self.tag, self.text = "", []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        names = dict(attrs)
        if tag not in VOID and (self.hidden or tag in DROPPED or "hidden" in names or names.get("aria-hidden") == "true"):
            self.hidden.append(tag)
        elif tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS:
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:  # an end closes what was left open inside
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif tag in BLOCKS or tag in ("body", "div", "article", "section", "ul", "ol", "table"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) in order. Inline elements add no space; text outside any block counts as the body's."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_no, tag, text) of each page; pages without text have no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, tag, text) for k, page in zip(frame[key], frame[html], strict=True) for i, (tag, text) in enumerate(blocks_of(page))]
            yield pd.DataFrame(rows, columns=[key, "block_no", "tag", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, block_no int, tag string, text string")


def html_blocks_plain(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """As html_blocks, by patterns only: for pages whose paragraphs, headings and items are closed and not nested."""
    body = F.col(html)
    for name in sorted(DROPPED):
        body = F.regexp_replace(body, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:h[1-4]|p|li|td|th)\b[^>]*>.*?</(?:h[1-4]|p|li|td|th)\s*>"), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("at", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"(?i)<br\s*/?>", " "), "<[^>]*>", ""), r"\s+", " "))
    rows = rows.select(key, "at", F.lower(F.regexp_extract("raw", r"^<(\w+)", 1)).alias("tag"), text.alias("text")).filter("text <> ''")
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("block_no"), "tag", "text")


def html_sections(blocks: DataFrame, labels: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(key, section, title, evidence, first_block, n_blocks, text): a page cut at its headings.

    What stands before the first heading is a section without evidence of its own ("spine"). Where labels (key, block_no,
    label) name a block, as a table of contents does, that label is the title and the block begins a section.
    """
    heads = blocks.withColumn("label", F.lit(None).cast("string")) if labels is None else blocks.join(labels.groupBy(key, "block_no").agg(F.min("label").alias("label")), [key, "block_no"], "left")
    heading = F.col("tag").isin("h1", "h2", "h3", "h4")
    starts = (heading | F.col("label").isNotNull()).cast("int")
    order = Window.partitionBy(key).orderBy("block_no")
    numbered = heads.withColumns({"starts": starts, "heading": heading}).withColumn("part", F.sum("starts").over(order))
    first = F.min_by(F.struct(F.coalesce("label", F.when(F.col("heading"), F.col("text"))).alias("title"), F.when(F.col("label").isNotNull(), "table-of-contents").when(F.col("heading"), "heading").otherwise("spine").alias("evidence")), "block_no")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("heading"), F.struct("block_no", "text")))), lambda x: x["text"]), " ")
    out = numbered.groupBy(key, "part").agg(first.alias("first"), F.min("block_no").alias("first_block"), F.count(F.lit(1)).alias("n_blocks"), text.alias("text"))
    section = F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1
    return out.select(key, section.alias("section"), F.coalesce("first.title", F.lit("Untitled")).alias("title"), "first.evidence", "first_block", "n_blocks", "text")


def resolve_href(href: Column, base_path: Column) -> tuple[Column, Column, Column]:
    """(path, fragment, ok) of a relative reference on a page at base_path. Schemes, hosts and ways out of the root are
    refused: ok is false and the path null."""
    fragment = F.when(href.contains("#"), F.regexp_extract(href, r"#(.*)$", 1))
    raw = F.regexp_replace(href, r"[?#].*$", "")
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    full = F.when(raw == "", base_path).when(raw.startswith("/"), raw).otherwise(F.concat(folder, raw))
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(full, r"\+", "%2B")), full)
    none = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(d: Column, part: Column) -> Column:
        up = part == ".."
        return F.struct(
            F.when(up, F.slice(d["parts"], F.lit(1), F.greatest(F.size(d["parts"]) - 1, F.lit(0)))).when(part.isin("", "."), d["parts"]).otherwise(F.concat(d["parts"], F.array(part))).alias("parts"),
            (d["out"] | (up & (F.size(d["parts"]) == 0))).alias("out"),
        )

    walked = F.aggregate(F.split(decoded, "/"), none, step)
    ok = ~href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~href.startswith("//") & ~walked["out"]
    return F.when(ok, F.concat(F.lit("/"), F.array_join(walked["parts"], "/"))), fragment, ok


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, link_no, href, label, path, fragment, ok) of each anchor with a quoted reference, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*?\bhref=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0))
    base = F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    rows = pages.select(key, base.alias("base"), F.posexplode(found).alias("link_no", "raw"))
    rows = rows.select(key, "link_no", "base", F.regexp_extract("raw", r"(?i)\bhref=\"([^\"]*)\"", 1).alias("href"), F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", ""), r"\s+", " ")).alias("label"))
    path, fragment, ok = resolve_href(F.col("href"), F.col("base"))
    return rows.select(key, "link_no", "href", "label", path.alias("path"), fragment.alias("fragment"), ok.alias("ok"))
