"""HTML pages: a small event reader in Python, the text rules in the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as tx

# Elements whose content is dropped, elements that break the
# line, and heading elements.
MUTED_TAGS = frozenset({"button", "footer", "header", "nav", "script", "style"})
BLOCK_TAGS = frozenset(
    {
        "article", "blockquote", "br", "div", "li", "p", "pre", "section",
        "table", "td", "th", "tr", "ul", "ol",
    }
)
HEADING_TAGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

READ_SCHEMA = "struct<body:string,title:string,headings:array<string>,error:string>"


def _events(html: str) -> list[tuple[str, str]]:
    from html.parser import HTMLParser

    seen: list[tuple[str, str]] = []
    reader = HTMLParser(convert_charrefs=True)
    reader.handle_starttag = lambda tag, attrs: seen.append(("open", tag))
    reader.handle_endtag = lambda tag: seen.append(("close", tag))
    reader.handle_data = lambda data: seen.append(("text", data))
    reader.feed(html)
    return seen


def _read(html: str) -> dict:
    body, title, found = [], [], []
    muted, in_title, heading = 0, False, None
    for event, value in _events(html):
        if event != "text" and value in MUTED_TAGS:
            muted = muted + 1 if event == "open" else max(muted - 1, 0)
        elif muted:
            continue
        elif event == "text":
            if in_title:
                title.append(value)
                continue
            body.append(value)
            if heading is not None:
                heading.append(value)
        elif value == "title":
            in_title = event == "open"
        elif value in HEADING_TAGS:
            if event == "open":
                heading = []
                body.append(f"\n{'#' * int(value[1])} ")
            else:
                found.append("".join(heading or ()))
                heading = None
                body.append("\n")
        elif value in BLOCK_TAGS:
            body.append("\n")
    return {"body": "".join(body), "title": "".join(title), "headings": found}


def _read_page(data: bytes) -> dict:
    return _read(data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))


def _read_batch(content: pa.Array) -> pa.Array:
    kind = pa.struct(
        [
            ("body", pa.string()),
            ("title", pa.string()),
            ("headings", pa.list_(pa.string())),
            ("error", pa.string()),
        ]
    )
    return tx.read_each(_read_page, content, kind, "HTML")


def read_html(content: Column) -> Column:
    """Raw text, title and headings of each page; undecodable bytes are ignored."""
    return tx.evaluated_once(_read_batch, READ_SCHEMA)(content)


def normalize(body: Column) -> Column:
    """One space per blank run, stripped lines, at most one empty line in a row."""
    flat = F.regexp_replace(tx.unify_breaks(body), "[ \t]+", " ")
    edges = rf"(?md)^{tx.BLANK}++|(?<!{tx.BLANK}){tx.BLANK}++$"
    return tx.strip(F.regexp_replace(F.regexp_replace(flat, edges, ""), "\n{3,}", "\n\n"))


def headings(raw: Column) -> Column:
    return F.filter(F.transform(raw, tx.clean_heading), lambda h: h != "")


def title(raw_title: Column, found: Column, site_suffix: str) -> Column:
    """First heading, else the document title without its site suffix."""
    named = tx.clean_heading(raw_title)
    if site_suffix:
        named = tx.strip(F.regexp_replace(named, rf"{tx.WS}+\|{tx.WS}+\Q{site_suffix}\E\n?\z", ""))
    return F.coalesce(F.try_element_at(found, F.lit(1)), named)
