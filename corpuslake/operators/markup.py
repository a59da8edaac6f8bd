"""HTML as Markdown: headings, paragraphs, lists, quotes, tables, bold and italic. One pass over a page's tags."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT_OUT = frozenset({"head", "script", "style", "template", "nav", "noscript"})
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
BREAKS = frozenset("p div section article main header footer aside figure ul ol dl dt dd form hr body html".split())
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*"}


class Writer(HTMLParser):
    """Collects blocks of Markdown. Tables inside cells are read as text of their cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.prefix, self.hidden, self.quotes = "", 0, 0
        self.lists: list[str] = []
        self.items: list[str] = []
        self.tables, self.rows = 0, []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in LEFT_OUT:
            self.hidden += 1
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.flush()
                self.rows = []
        elif self.tables == 1 and tag == "tr":
            self.end_cell()
            self.row = []
            self.rows.append(self.row)
        elif self.tables == 1 and tag in ("td", "th"):
            self.end_cell()
            if self.row is None:
                self.row = []
                self.rows.append(self.row)
            self.cell = []
        elif tag in MARKS:
            self.put(MARKS[tag])
        elif self.tables:
            self.put(" ")
        elif tag in HEADINGS:
            self.flush()
            self.prefix = HEADINGS[tag]
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append("- " if tag == "ul" else "1. ")
        elif tag == "li":
            self.flush()
            self.prefix = self.lists[-1] if self.lists else "- "
        elif tag == "blockquote":
            self.flush()
            self.quotes += 1
        elif tag == "br":
            self.put("\n")
        elif tag in BREAKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in LEFT_OUT:
            self.hidden = max(self.hidden - 1, 0)
        elif tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                self.end_table()
        elif self.tables == 1 and tag in ("td", "th", "tr"):
            self.end_cell()
            self.row = None if tag == "tr" else self.row
        elif tag in MARKS:
            self.put(MARKS[tag])
        elif self.tables:
            self.put(" ")
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = self.lists[:-1]
            if not self.lists:
                self.end_list()
        elif tag == "blockquote":
            self.flush()
            self.quotes = max(self.quotes - 1, 0)
        elif tag in HEADINGS or tag in BREAKS or tag == "li":
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.put(re.sub(r"\s+", " ", data))

    def put(self, text: str) -> None:
        if self.tables:
            if self.cell is not None:
                self.cell.append(text)
        else:
            self.text.append(text)

    def flush(self) -> None:
        text, prefix = shown("".join(self.text)), self.prefix
        self.text, self.prefix = [], ""
        if not text:
            return
        if prefix and self.lists and not prefix.startswith("#"):
            self.items.append(prefix + text.replace("\n", " "))
        else:
            self.end_list()
            self.blocks.append("\n".join("> " * self.quotes + prefix + line for line in text.split("\n")))

    def end_list(self) -> None:
        if self.items:
            self.blocks.append("\n".join(self.items))
            self.items = []

    def end_cell(self) -> None:
        if self.cell is not None:
            self.row.append(shown("".join(self.cell)).replace("\n", " "))
            self.cell = None

    def end_table(self) -> None:
        self.end_cell()
        self.row = None
        rows = [r for r in self.rows if r]
        self.end_list()
        if rows and len(rows[0]) == 2 and re.match(r"\*{0,2}\d{3,}", rows[0][0]):
            self.blocks.append("\n".join(f"> **{plain(r[0])}** {plain(r[1])}" for r in rows if len(r) == 2))
        elif rows:
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            self.blocks.append("\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]))


def shown(text: str) -> str:
    """One space for several, none at the ends of lines, no empty marks."""
    text = re.sub(r"[\xa0 ]+", " ", re.sub(r"\*{4}", "", text))
    return "\n".join(line.strip() for line in text.strip().split("\n"))


def plain(text: str) -> str:
    return text.replace("*", "")


def blocks_of(html: str | None) -> list[str]:
    writer = Writer()
    writer.feed(html or "")
    writer.close()
    if writer.tables:
        writer.tables = 0
        writer.end_table()
    writer.flush()
    writer.end_list()
    return writer.blocks


def parts_of(html: str | None) -> list[str]:
    """Parts of a page: each second-level heading opens one; on a page without such, each paragraph that is all bold does."""
    found = blocks_of(html)
    by_heading = any(b.startswith("## ") for b in found)
    opens = (lambda b: b.startswith("## ")) if by_heading else (lambda b: re.fullmatch(r"\*\*[^*]+\*\*", b) is not None)
    parts: list[list[str]] = []
    for block in found:
        if opens(block) or not parts:
            parts.append([])
        parts[-1].append(block)
    return ["\n\n".join(p) for p in parts]


def markdown(html: str | Column) -> Column:
    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: "\n\n".join(blocks_of(h)))

    return convert(html)


def blocks(html: str | Column) -> Column:
    @F.pandas_udf("array<string>")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(parts_of)

    return convert(html)
