"""Raw web pages to blocks, and blocks to overlapping chunks with a context header."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi.functions.text import gazette_numbers, split_words, squeeze, standard_numbers

# Functions that run in Python workers travel with the task: workers need no package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENS_PER_WORD = 1.3
MIN_TOKENS, MAX_TOKENS = 400, 800
OVERLAP_SHARE = 0.15
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SKIPPED = {"script", "style", "noscript"}
_BLOCK_LEVEL = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt",
                "fieldset", "figcaption", "figure", "footer", "form", "head", "header", "hr", "html", "legend", "main", "menu",
                "nav", "ol", "option", "pre", "section", "select", "summary", "textarea", "ul"}
_BREAKS = _BLOCK_LEVEL | _HEADINGS | {"p", "li", "br"}


class _Blocks(HTMLParser):
    """Collects (kind, text) blocks of one page; tables become markdown rows. No text is lost.

    Every block-level tag ends the block before it. Text outside headings, paragraphs, items and tables
    is a block of kind ``other``, which a user may leave out.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.kind, self.words, self.skip = None, [], 0
        self.rows, self.cells, self.in_cell = None, None, False

    def _text(self):
        text, self.words = " ".join("".join(self.words).split()), []
        return text

    def _flush(self):
        text = self._text()
        if text:
            self.blocks.append((self.kind or "other", text))
        self.kind = None

    def _end_row(self):
        if self.cells is not None:
            if self.in_cell:
                self.cells.append(self._text())
            self.rows.append(self.cells)
        self.cells, self.in_cell = None, False

    def _end_table(self):
        self._end_row()
        rows = [r for r in self.rows if r]
        if rows:
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            lines.insert(1, "|" + " --- |" * len(rows[0]))
            self.blocks.append(("table", "\n".join(lines)))
        self.rows = None
        self._flush()

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "table":
            if self.rows is not None:
                self._end_table()
            self._flush()
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self._end_row()
                self._flush()
                self.cells = []
            elif tag in ("td", "th"):
                if self.cells is None:
                    self._flush()
                    self.cells = []
                elif self.in_cell:
                    self.cells.append(self._text())
                else:
                    self._flush()
                self.in_cell = True
            elif tag in _BREAKS:
                self.words.append(" ")
        elif tag in _HEADINGS or tag in ("p", "li", "title"):
            self._flush()
            self.kind = {"p": "paragraph", "li": "paragraph", "title": "title"}.get(tag, "heading")
        elif tag in _BLOCK_LEVEL:
            self._flush()
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.rows is not None:
            self._end_table()
        elif self.rows is not None:
            if tag in ("td", "th") and self.in_cell:
                self.cells.append(self._text())
                self.in_cell = False
            elif tag == "tr":
                self._end_row()
            elif tag in _BREAKS:
                self.words.append(" ")
        elif tag in _BLOCK_LEVEL or tag in _HEADINGS or tag in ("p", "li", "title"):
            self._flush()

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)

    def finish(self):
        self.close()
        if self.rows is not None:
            self._end_table()
        self._flush()


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, text) of every HTML page; PDF bytes are left to another reader."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, html in zip(pdf["page_id"], pdf["html"]):
                parser = _Blocks()
                parser.feed(html)
                parser.finish()
                out.extend((page_id, i, kind, text) for i, (kind, text) in enumerate(parser.blocks))
            yield pd.DataFrame(out, columns=["page_id", "pos", "kind", "text"])

    readable = pages.where(F.col("html").isNotNull() & ~F.startswith("html", F.lit("%PDF-")))
    return readable.select("page_id", "html").mapInPandas(
        parse, "page_id bigint, pos int, kind string, text string"
    )


def block_chunks(blocks: DataFrame) -> DataFrame:
    """Chunks of 400 to 800 estimated tokens per page; a block is never split.

    A chunk closes once it holds the minimum and the next block would pass the maximum. The
    blocks of one page are folded inside one row. About 15% of a chunk's last words open
    the next one. The header names the title and the heading in force where a chunk starts.
    """
    target = int(MAX_TOKENS / TOKENS_PER_WORD)
    enough = int(MIN_TOKENS / TOKENS_PER_WORD)
    per_page = blocks.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "kind", "text"))).alias("b")
    )
    start = F.struct(
        F.lit("").alias("title"), F.lit("").alias("heading"), F.lit("").alias("at"),
        F.lit("").alias("buf"), F.lit(0).alias("n"), F.lit(0).alias("fresh"),
        F.array().cast("array<struct<header:string,text:string,words:int>>").alias("out"),
    )

    def closed(s):
        header = F.concat_ws(" > ", *[F.when(s[c] != "", s[c]) for c in ("title", "at")])
        return F.concat(s["out"], F.array(F.struct(
            header.alias("header"), s["buf"].alias("text"), s["n"].alias("words"))))

    def step(s, b):
        words = F.size(split_words(b["text"]))
        is_title, is_heading = b["kind"] == "title", b["kind"] == "heading"
        cut = (s["fresh"] > 0) & (s["n"] >= enough) & (s["n"] + words > target)
        old = split_words(s["buf"])
        keep = F.floor(F.size(old) * OVERLAP_SHARE).cast("int")
        tail = F.when(keep > 0, F.array_join(F.slice(old, F.size(old) - keep + 1, keep), " ")).otherwise("")
        base = F.when(cut, tail).otherwise(s["buf"])
        base_n = F.when(cut, keep).otherwise(s["n"])
        heading = F.when(is_heading, b["text"]).otherwise(s["heading"])
        opens = cut | (s["fresh"] == 0)
        added = F.struct(
            s["title"].alias("title"), heading.alias("heading"),
            F.when(opens, heading).otherwise(s["at"]).alias("at"),
            F.when(base == "", b["text"]).otherwise(F.concat(base, F.lit("\n"), b["text"])).alias("buf"),
            (base_n + words).alias("n"),
            (F.when(cut, F.lit(0)).otherwise(s["fresh"]) + 1).alias("fresh"),
            F.when(cut, closed(s)).otherwise(s["out"]).alias("out"),
        )
        titled = F.struct(
            b["text"].alias("title"), s["heading"].alias("heading"), s["at"].alias("at"),
            s["buf"].alias("buf"), s["n"].alias("n"), s["fresh"].alias("fresh"), s["out"].alias("out"),
        )
        return F.when(is_title, titled).otherwise(added)

    chunks = F.aggregate("b", start, step, lambda s: F.when(s["fresh"] > 0, closed(s)).otherwise(s["out"]))
    return per_page.select("page_id", F.posexplode(chunks).alias("ordinal", "c")).select(
        "page_id", "ordinal", "c.header", "c.text", "c.words",
        F.ceil(F.col("c.words") * TOKENS_PER_WORD).cast("int").alias("tokens"),
    )


def page_titles(pages: DataFrame) -> DataFrame:
    """Title tag and identifiers of each raw page."""
    return pages.select(
        "page_id", squeeze(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.array_join(F.concat(standard_numbers(F.col("html")), gazette_numbers(F.col("html"))), " | ").alias("identifiers"),
    )
