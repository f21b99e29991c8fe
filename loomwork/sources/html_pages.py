"""HTML documents as link rows and dates, in Arrow batches, with the standard library's tolerant parser."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK_SCHEMA = "page_id long, pos int, tag string, href string, text string, xpath string, class_xpath string"
DATE_SCHEMA = "page_id long, pos int, source string, value string, xpath string"
ELEMENT_SCHEMA = "page_id long, pos int, tag string, xpath string, text string"
MOST_TEXT = 2000  #: characters of an element's text; longer ones are no titles
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of the head, parts of tables, and what ends a paragraph.
HEAD = frozenset("base link meta noscript script style template title".split())
TABLE = frozenset("caption colgroup tbody td tfoot th thead tr".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_SCOPE = frozenset("table td th caption button object template".split())
#: start tag -> (elements that it ends, elements that keep it from ending those around them)
ENDS = {t: (frozenset({"p"}), _SCOPE) for t in BLOCKS} | {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"td", "th", "tr"}), frozenset({"tbody", "thead", "tfoot", "table"})),
    "tbody": (frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), frozenset({"table"})),
    "thead": (frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), frozenset({"table"})),
    "a": (frozenset({"a"}), _SCOPE),
}
KINDS = ("category", "tag")
AT_ONCE = 100  #: pages that are parsed before their rows leave


def _classes(value: str | None) -> str:
    return ".".join(sorted(c.lower() for c in (value or "").split() if not re.fullmatch(r"post-\d+", c.lower())))


class _Walker(HTMLParser):
    """Keeps the open elements with their indexed paths, and collects links and dates."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, str]] = [("", "", "")]  # name, xpath, class path
        self.counts: list[Counter[str]] = [Counter()]
        self.links: list[dict] = []
        self.dates: list[dict] = []
        self.within: list[dict] = []
        self.named: list[dict] = []
        self.naming: list[tuple[int, dict]] = []
        self.had_body = False
        self.elements: list[list] = []  # tag, xpath, where its text begins and ends
        self.marks: list[int] = [-1]  # of the open elements
        self.texts: list[str] = []
        self.length = 0

    def _push(self, tag: str, attrs: dict[str, str | None]) -> tuple[str, str]:
        """Open an element; its paths."""
        self.counts[-1][tag] += 1
        path = f"{self.open[-1][1]}/{tag}[{self.counts[-1][tag]}]"
        by_class = f"{self.open[-1][2]}/{tag}({_classes(attrs.get('class'))})[{self.counts[-1][tag]}]"
        self._opened(tag, path, by_class)
        return path, by_class

    def _opened(self, tag: str, path: str, by_class: str) -> None:
        self.open.append((tag, path, by_class))
        self.counts.append(Counter())
        self.marks.append(len(self.elements))
        self.elements.append([tag, path, self.length, None])

    def _said(self, text: str) -> None:
        self.texts.append(text)
        self.length += len(text)

    def _imply(self, tag: str) -> None:
        """Open and close what the standard has a start tag open and close: html, head, body, rows of tables, items without end tags."""
        names = [name for name, _, _ in self.open]
        if "html" not in names:
            self._push("html", {})
            names.append("html")
        if "body" not in names:
            if tag in HEAD and not self.had_body:
                if "head" not in names:
                    self._push("head", {})
            else:
                while self.open[-1][0] != "html":
                    self._close()
                if tag != "body":
                    self._push("body", {})
                self.had_body = True
        if tag in ENDS:
            ended, stops = ENDS[tag]
            for name, _, _ in reversed(self.open[1:]):
                if name in stops:
                    break
                if name in ended:
                    while self.open[-1][0] != name:
                        self._close()
                    self._close()
                    if tag not in TABLE:
                        break
        if tag in ("tr", "td", "th") and self.open[-1][0] == "table":
            self._push("tbody", {})
        if tag in ("td", "th") and self.open[-1][0] in ("tbody", "thead", "tfoot"):
            self._push("tr", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "head", "body") and any(name == tag for name, _, _ in self.open):
            return
        if tag not in ("html", "head"):
            self._imply(tag)
        elif tag == "head":
            if not any(name == "html" for name, _, _ in self.open):
                self._push("html", {})
        self.counts[-1][tag] += 1
        at = dict(attrs)
        path = f"{self.open[-1][1]}/{tag}[{self.counts[-1][tag]}]"
        by_class = f"{self.open[-1][2]}/{tag}({_classes(at.get('class'))})[{self.counts[-1][tag]}]"
        rel = (at.get("rel") or "").lower()
        if at.get("href") is not None and (tag in ("a", "area") or tag == "link" and rel in ("next", "prev")):
            self.links.append({"tag": tag, "href": at["href"], "text": "", "xpath": path, "class_xpath": by_class, "label": at.get("aria-label")})
            if tag == "a":
                self.within.append(self.links[-1])
        if tag == "meta" and (at.get("property") or at.get("name") or "").lower() in ("article:published_time", "dc.date.issued"):
            name = "property" if at.get("property") else "name"
            self.dates.append({"source": "meta", "value": at.get("content") or "", "xpath": f"{self.open[-1][1]}/meta[@{name}='{at[name].lower()}']"})
        if tag == "time" and at.get("datetime"):
            self.dates.append({"source": "time", "value": at["datetime"] or "", "xpath": path})
        if tag == "a" and (kinds := {k for k in KINDS if re.search(rf"(?:^|[\s_-]){k}(?:$|[\s_-])", rel)}):
            self.named.append({"kinds": sorted(kinds), "name": ""})
            self.naming.append((len(self.open), self.named[-1]))
        if tag not in VOID:
            self._opened(tag, path, by_class)
        else:
            self.elements.append([tag, path, self.length, self.length])
            if tag == "br":
                self._said("\n")

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _, _ in self.open[1:]):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def _close(self) -> None:
        if self.open[-1][0] == "a" and self.within:
            self.within.pop()
        if self.naming and self.naming[-1][0] == len(self.open) - 1:
            self.naming.pop()
        self.open.pop()
        self.counts.pop()
        self.elements[self.marks.pop()][3] = self.length

    def handle_data(self, data: str) -> None:
        for link in self.within:
            link["text"] += data
        for _, link in self.naming:
            link["name"] += data
        self.counts[-1]["text()"] += 1
        path = f"{self.open[-1][1]}/text()[{self.counts[-1]['text()']}]"
        self.elements.append(["text()", path, self.length, self.length + len(data)])
        self._said(data)
        text = data.strip()
        if self.open[-1][0] not in ("script", "style", "") and re.search(r"[0-9]", text) and len(text) <= 128:
            self.dates.append({"source": "text", "value": text, "xpath": path})


def _walked(html: str | None) -> _Walker:
    walker = _Walker()
    walker.feed(html or "")
    walker.close()
    return walker


def read_links(pages: DataFrame) -> DataFrame:
    """Link rows (see LINK_SCHEMA) of pages (page_id, html): a, area, and link elements for the next or previous page.

    Anchors without text are left out unless they have a label. xpath has an index at every step.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in LINK_SCHEMA.split(", ")]
        for frame in (whole[i : i + AT_ONCE] for whole in frames for i in range(0, len(whole), AT_ONCE)):
            rows = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                kept = [x for x in _walked(html).links if x["tag"] != "a" or x["text"].strip() or x["label"]]
                rows += [{"page_id": page, "pos": i, **x} for i, x in enumerate(kept)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "html").mapInPandas(run, LINK_SCHEMA)


def read_dates(pages: DataFrame) -> DataFrame:
    """Date candidates (see DATE_SCHEMA) of pages: published-time metas (by their attribute), time elements, text nodes with digits, in document order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in DATE_SCHEMA.split(", ")]
        for frame in (whole[i : i + AT_ONCE] for whole in frames for i in range(0, len(whole), AT_ONCE)):
            rows = [{"page_id": p, "pos": i, **x} for p, h in zip(frame["page_id"], frame["html"], strict=True) for i, x in enumerate(_walked(h).dates)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "html").mapInPandas(run, DATE_SCHEMA)


def read_elements(pages: DataFrame) -> DataFrame:
    """Elements and text nodes (see ELEMENT_SCHEMA) of pages (page_id, html) in document order, each with its path and all text within it; null where that is longer than MOST_TEXT."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ELEMENT_SCHEMA.split(", ")]
        for frame in (whole[i : i + AT_ONCE] for whole in frames for i in range(0, len(whole), AT_ONCE)):
            rows = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                walker = _walked(html)
                text = "".join(walker.texts)
                for pos, (tag, path, begin, end) in enumerate(walker.elements):
                    end = len(text) if end is None else end
                    rows.append((page, pos, tag, path, text[begin:end] if end - begin <= MOST_TEXT else None))
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "html").mapInPandas(run, ELEMENT_SCHEMA)


def read_categories(pages: DataFrame, default: str = "Uncategorized") -> DataFrame:
    """(page_id, kind, name) of pages (page_id, html): categories and tags by the rel of links; a page without any of a kind is in the default one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (whole[i : i + AT_ONCE] for whole in frames for i in range(0, len(whole), AT_ONCE)):
            rows = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                named = _walked(html).named
                for kind in KINDS:
                    own = list(dict.fromkeys(" ".join(x["name"].split()) for x in named if kind in x["kinds"]))
                    rows += [(page, kind, name) for name in own or [default]]
            yield pd.DataFrame(rows, columns=["page_id", "kind", "name"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, kind string, name string")


def page_title(html: Column, url: Column) -> Column:
    """og:title, else the title element, else the URL."""
    og = F.nullif(F.regexp_extract(html, r"""(?i)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return F.coalesce(og, title, url)


def meta_refresh(html: Column) -> Column:
    """struct(delay, target) of a meta refresh; null without one."""
    pattern = r"""(?is)<meta[^>]*http-equiv=["']?refresh["']?[^>]*content=["']\s*(\d+)\s*;\s*url=['"]?([^"'>]+)"""
    target = F.regexp_extract(html, pattern, 2)
    return F.when(target != "", F.struct(F.regexp_extract(html, pattern, 1).try_cast("int").alias("delay"), F.trim(target).alias("target")))


#: Ends of addresses that usually are feeds, types of feeds, and the path of feeds of comments.
FEED_ENDS = (
    "/feed.xml", "/feed", "/feed/", "/index.xml", "/rss.xml", "/atom.xml", "/default", "/rss", "/rss/", "/all.atom.xml", "/feed.rss", "/feed.atom", "/index.rss",
)
FEED_TYPES = ("application/rss+xml", "application/atom+xml")
COMMENT_FEED = r"/comments/(feed|default)/?$"


def is_feed_link(href: Column, rel: Column | None = None, kind: Column | None = None) -> Column:
    """Is the link one to a feed of posts, by the end of its address or as an alternate of a feed's type?

    Feeds of comments and addresses that end in ?alt=rss don't count.
    """
    found = F.lit(False)
    for end in FEED_ENDS:
        found = found | href.endswith(end)
    if rel is not None and kind is not None:
        found = found | (F.coalesce(rel == "alternate", F.lit(False)) & F.coalesce(kind.isin(*FEED_TYPES), F.lit(False)))
    path = F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return found & ~F.regexp_replace(href, r"#.*$", "").endswith("?alt=rss") & ~path.rlike(COMMENT_FEED)
