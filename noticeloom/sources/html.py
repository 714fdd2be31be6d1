"""HTML pages: text with table cells and label pairs on one line, titles, attachment links, inline images."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Tags that break lines, that are left out, and class hints of a page's body.
BLOCKS = frozenset("p div li ul ol dl dt dd tr table thead tbody tfoot caption h1 h2 h3 h4 h5 h6 section article aside header footer nav main blockquote pre form fieldset legend address figure figcaption hr details summary option br".split())
SKIPPED = frozenset("script style noscript svg iframe nav header footer aside".split())
BODY_HINT = regex.compile(r"board_view|bbs_?view|board_?body|view_cont|view_contents", regex.I)
WRAPPER_HINT = regex.compile(r"contents?_wrap|contents_inner|sub_?content|content_area|contentViewHtml", regex.I)
FILE_KINDS = regex.compile(r"\.(pdf|hwpx|hwp|txt|docx|zip|xlsx)\b", regex.I)
DOWNLOAD = regex.compile(r"download|filedown|atchfile|getfile", regex.I)
NOT_PHOTOS = regex.compile(r"logo|icon|btn|button|banner|bullet|blank|spacer", regex.I)
MIN_BODY, MAX_TEXT, MAX_LINKS, MAX_IMAGES = 400, 200_000, 10, 3
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


class _Walk(HTMLParser):
    """One pass over a page: text with marks for cells and lines, the spans of body candidates, links and images."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, int]] = []
        self.skip = 0
        self.spans: dict[int, list[tuple[int, int]]] = {0: [], 1: [], 2: [], 3: []}
        self.title: list[str] = []
        self.og: str | None = None
        self.links: list[tuple[str, list[str]]] = []
        self.images: list[str] = []
        self.label = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("property") == "og:title":
            self.og = self.og or a.get("content")
        if tag == "img" and a.get("src"):
            self.images.append(a["src"])
        if tag == "a" and a.get("href"):
            self.links.append((a["href"], []))
        hidden = "hidden" in a or "display:none" in a.get("style", "").replace(" ", "")
        rank = -1
        if tag == "div" and BODY_HINT.search(" ".join(a.values())):
            rank = 0
        elif tag in ("main", "article"):
            rank = 1 if tag == "main" else 2
        elif tag == "div" and WRAPPER_HINT.search(" ".join(a.values())):
            rank = 3
        classes = a.get("class", "").lower().split()
        if tag in ("td", "th"):
            self.out.append("\x01")
        elif tag == "dd" and self.label == "dt" or "txt" in classes and self.label == "tit":
            self.out.append("\x01")
        elif tag in BLOCKS:
            self.out.append("\n")
        self.label = "dt" if tag == "dt" else "tit" if "tit" in classes else self.label if tag in ("dd", "span", "b", "strong") else ""
        if tag in VOID:
            return
        self.stack.append((tag, rank if rank < 0 else rank * 1_000_000_000 + len(self.out)))
        if tag in SKIPPED or hidden:
            self.skip += 1
            self.stack[-1] = (tag, -2)

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            t, mark = self.stack.pop()
            if mark == -2:
                self.skip -= 1
            elif mark >= 0:
                self.spans[mark // 1_000_000_000].append((mark % 1_000_000_000, len(self.out)))
            if t == tag:
                break
        if tag in BLOCKS and tag not in ("dt",):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        elif not self.skip:
            self.out.append(data.replace("\n", " "))
        if self.links and any(t == "a" for t, _ in self.stack):
            self.links[-1][1].append(data)


def _tidy(parts: list[str]) -> str:
    lines = []
    for line in "".join(parts).split("\n"):
        cells = [" ".join(c.split()) for c in regex.split(r"[\x01|]", line)]
        if line := " | ".join(c for c in cells if c):
            lines.append(line)
    return "\n".join(lines)[:MAX_TEXT]


def page_parts(page: str | None, base: str = "") -> tuple[str, str | None, list[dict], list[str]]:
    """(text, title, attachment links, image addresses) of a page; null gives empty parts.

    The text is that of the first body candidate with enough of it, else of the whole page.
    """
    if not page:
        return "", None, [], []
    w = _Walk()
    w.feed(regex.sub(r"<!--.*?-->", " ", page, flags=regex.S))
    w.close()
    candidates = [s for rank in range(4) for s in w.spans[rank][:4]]
    texts = (_tidy(w.out[a:b]) for a, b in candidates)
    text = next((t for t in texts if len(t) >= MIN_BODY), None) or _tidy(w.out)
    title = " ".join((html.unescape(w.og) if w.og else "".join(w.title)).split())[:200] or None
    links, seen = [], set()
    for href, label in w.links:
        if regex.match(r"#|javascript:|mailto:|tel:", href, flags=regex.I):
            continue
        url, name = urljoin(base, href), " ".join("".join(label).split())[:120]
        kind = FILE_KINDS.search(urlsplit(url).path) or FILE_KINDS.search(name)
        if url not in seen and (kind or DOWNLOAD.search(url)) and len(links) < MAX_LINKS:
            seen.add(url)
            links.append({"url": url, "label": name, "kind": kind[1].lower() if kind else "unknown"})
    images = [u for u in dict.fromkeys(urljoin(base, s) for s in w.images if not s.startswith("data:")) if regex.search(r"\.(?:png|jpe?g)\b|image", u, flags=regex.I) and not NOT_PHOTOS.search(u)]
    return text, title, links, images[:MAX_IMAGES]


_PARTS = "text string, title string, links array<struct<url:string,label:string,kind:string>>, images array<string>"


def with_parts(pages: DataFrame, page: str, url: str, out: str = "parts") -> DataFrame:
    """Adds a struct (text, title, links, images) made from the HTML of each row."""

    def parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for htmls, bases in batches:
            yield pd.DataFrame([page_parts(h, b or "") for h, b in zip(htmls, bases, strict=True)], columns=["text", "title", "links", "images"])

    return pages.withColumn(out, F.pandas_udf(parts, _PARTS)(page, url))
