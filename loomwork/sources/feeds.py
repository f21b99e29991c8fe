"""RSS, RDF and Atom documents as rows, in Arrow batches.

A document's text is sanitised (characters that XML doesn't allow are dropped), parsed, and read by one of three small
readers. What isn't well-formed is read by a tolerant reader; what is no feed is a row with its error, never a failed job.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, kind string, title string, root_link string, generator string, error string, "
    "entries array<struct<pos:int,url:string,title:string,published:string>>"
)
_BAD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_DECLARED = re.compile(r"^\s*<\?xml[^>]*\?>")


def sniffed_kind(content):
    """rss, rdf, atom or null from the name of the first element, as a column."""
    name = F.lower(F.regexp_extract(content, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(?:[A-Za-z0-9_]+:)?([A-Za-z]+)", 1))
    return F.when(name == "rss", "rss").when(name == "rdf", "rdf").when(name == "feed", "atom")


_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<![^>]*>|</(?P<end>[^\s>]+)[^>]*>|<(?P<start>[A-Za-z_][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def _tolerant(content: str) -> ET.Element:
    """The elements of a document that isn't well-formed.

    Names of entities are looked up as in HTML, and stay as they are where there is none; prefixes needn't be declared; an end tag ends what is
    open inside its element, and is passed over without one; what is open at the end is ended.
    """
    root, stack = None, []
    for m in _TOKEN.finditer(content):
        if m["start"]:
            prefix, _, name = m["start"].rpartition(":")
            attrs = {k: html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m["attrs"].rstrip("/"))}
            e = ET.Element(f"{{{prefix}}}{name}" if prefix else name, attrs)
            if stack:
                stack[-1].append(e)
            elif root is None:
                root = e
            else:
                break
            if not m["attrs"].endswith("/"):
                stack.append(e)
        elif m["end"]:
            name = m["end"].rpartition(":")[2]
            if any(_name(e) == name for e in stack):
                while _name(stack.pop()) != name:
                    pass
        elif stack and (text := m["cdata"] if m["cdata"] is not None else html.unescape(m["text"] or "")):
            if len(stack[-1]):
                stack[-1][-1].tail = (stack[-1][-1].tail or "") + text
            else:
                stack[-1].text = (stack[-1].text or "") + text
    if root is None:
        raise ET.ParseError("no element")
    return root


def _root(content: str) -> ET.Element:
    try:
        return ET.fromstring(content)
    except ET.ParseError:
        return _tolerant(content)


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: ET.Element, name: str, space: str | None = None) -> str | None:
    """The text of the first child of that name; `space` is a part of its namespace, without one it has none or RSS's own."""
    for c in e:
        if _name(c) == name and ((space in c.tag) if space else not ("}" in c.tag and "feedburner" in c.tag)):
            return "".join(c.itertext()).strip()
    return None


def title_text(raw: str | None, fallback: str) -> str:
    """Unescaped, breaks as line ends, white space as single spaces; without any the fallback."""
    out = re.sub(r"(?i)<br\s*/?>", "\n", html.unescape(raw or ""))
    return " ".join(out.replace(" ", " ").split()) or fallback


def _generator(raw: str | None) -> str:
    raw = (raw or "").lower()
    return "tumblr" if raw.startswith("tumblr") else raw if raw in ("blogger", "medium", "substack") else "other"


def _item(item: ET.Element) -> tuple[str | None, str | None, str | None]:
    guid = next((c for c in item if _name(c) == "guid"), None)
    permalink = guid.text.strip() if guid is not None and guid.text and guid.get("isPermaLink", "true").lower() == "true" else None
    return _text(item, "origLink", "feedburner") or _text(item, "link") or permalink, _text(item, "title"), _text(item, "pubDate") or _text(item, "date")


def _atom_link(e: ET.Element) -> str | None:
    links = [c for c in e if _name(c) == "link" and c.get("href")]
    for rel in ("alternate", None):
        found = [c.get("href") for c in links if c.get("rel") == rel]
        if found:
            return found[0] if len(found) == 1 else None
    return None


def parse(content: str | None, url: str | None) -> dict:
    """kind, title, root_link, generator, error and entries of a document; entries in document order."""
    out = {"kind": None, "title": None, "root_link": None, "generator": None, "error": None, "entries": []}
    try:
        root = _root(_DECLARED.sub("", _BAD.sub("", content or "")))
    except ET.ParseError as e:
        return out | {"error": f"not XML: {e}"}
    name, host = _name(root).lower(), urlsplit(url or "").netloc
    if name == "rss" or name == "rdf":
        channel = next((c for c in root if _name(c) == "channel"), None)
        if channel is None:
            return out | {"kind": name, "error": "no channel"}
        items = [c for c in (channel if name == "rss" else root) if _name(c) == "item"]
        rows = [_item(i) for i in items]
        out |= {"kind": name, "title": title_text(_text(channel, "title"), host), "root_link": _text(channel, "link") or None, "generator": _generator(_text(channel, "generator"))}
    elif name == "feed":
        rows = [
            (_text(e, "origLink", "feedburner") or _atom_link(e), _text(e, "title"), _text(e, "published") or _text(e, "updated"))
            for e in root
            if _name(e) == "entry"
        ]
        out |= {"kind": "atom", "title": title_text(_text(root, "title"), host), "root_link": _atom_link(root), "generator": _generator(_text(root, "generator"))}
    else:
        return out | {"error": "no feed"}
    if any(not r[0] for r in rows):
        return out | {"error": "an entry has no link"}
    return out | {"entries": [{"pos": i, "url": u, "title": title_text(t, ""), "published": p} for i, (u, t, p) in enumerate(rows)]}


def read_feeds(docs: DataFrame) -> DataFrame:
    """A row (see SCHEMA) for each document of docs (doc_id, content, url)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (whole[i : i + 100] for whole in frames for i in range(0, len(whole), 100)):
            rows = [{"doc_id": i, **parse(c, u)} for i, c, u in zip(frame["doc_id"], frame["content"], frame["url"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "title", "root_link", "generator", "error", "entries"])

    return docs.select("doc_id", "content", "url").mapInPandas(run, SCHEMA)


def read_heads(docs: DataFrame) -> DataFrame:
    """read_feeds without the entries, and with `sniffed`, the kind by the first element's name: a document passes once, and its entries stay in the worker."""
    names = ["doc_id", "kind", "title", "root_link", "generator", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (whole[i : i + 100] for whole in frames for i in range(0, len(whole), 100)):
            parsed = [parse(c, u) for c, u in zip(frame["content"], frame["url"], strict=True)]
            rows = [(i, *(p[name] for name in names[1:]), s) for i, p, s in zip(frame["doc_id"], parsed, frame["sniffed"], strict=True)]
            yield pd.DataFrame(rows, columns=[*names, "sniffed"])

    schema = SCHEMA[: SCHEMA.index(", entries")] + ", sniffed string"
    return docs.select("doc_id", "content", "url", sniffed_kind(F.col("content")).alias("sniffed")).mapInPandas(run, schema)


def entries(feeds: DataFrame) -> DataFrame:
    """(doc_id, pos, url, title, published): a row for each entry."""
    return feeds.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.*")
