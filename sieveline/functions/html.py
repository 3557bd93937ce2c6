"""HTML reading with the standard library: a light tree, its texts, links and linked data."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlparse

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))
# an & that begins no reference with a semicolon, outside comments and raw texts
LOOSE = re.compile(r"(?is)(<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\2\s*>|\Z))|&(?!(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);)")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parts: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self):
        """This node and all below it, in document order; no recursion, so depth is no limit."""
        stack: list[Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))

    def text(self, hidden: bool = False) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node.strip())
            elif hidden or node is self or node.tag not in HIDDEN:
                stack.extend(reversed(node.parts))
        return " ".join(" ".join(x for x in out if x).split())

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def parse(html: str | None, closed: bool = False) -> Node:
    """The tree of a page. HTML reads some references without a semicolon (`&amp`); with `closed` those stay as they are, as in normalize.unescape."""
    b = _Builder()
    b.feed(LOOSE.sub(lambda m: m[1] or "&amp;", html or "") if closed else html or "")
    b.close()
    return b.root


def find(root: Node, *tags: str) -> list[Node]:
    return [n for n in root.walk() if n.tag in tags]


def meta(root: Node, name: str) -> str:
    for kind in ("property", "name"):
        for n in find(root, "meta"):
            if n.attrs.get(kind) == name:
                return n.attrs.get("content", "").strip()
    return ""


def title(root: Node) -> str:
    found = find(root, "title")
    return found[0].text() if found else ""


def canonical(root: Node, url: str) -> str:
    for n in find(root, "link"):
        if "canonical" in n.attrs.get("rel", "").split() and n.attrs.get("href"):
            return urljoin(url, n.attrs["href"])
    p = urlparse(url)
    return f"{p.scheme}://{p.netloc}" if p.scheme and p.netloc else url


def linked_data(root: Node) -> list[dict]:
    """Objects of application/ld+json scripts: single, in lists or under @graph; broken ones are skipped."""
    out = []
    for n in find(root, "script"):
        if "ld+json" not in n.attrs.get("type", "").lower():
            continue
        try:
            data = json.loads(n.text(hidden=True))
        except ValueError:
            continue
        items = data if isinstance(data, list) else data.get("@graph", []) if isinstance(data, dict) and "@graph" in data else [data]
        out += [x for x in items if isinstance(x, dict)]
    return out


def children(item: dict) -> list[dict]:
    """Objects inside a linked-data object that may be entities of their own."""
    out = []
    for key in ("itemListElement", "review", "department", "makesOffer"):
        value = item.get(key)
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, dict):
                out.append(x["item"] if isinstance(x.get("item"), dict) else x)
    return out


def links(root: Node, url: str, hosts: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(links to the hosts without queries, absolute image URLs), different ones in order."""
    found, images = {}, {}
    for n in find(root, "a"):
        href = urljoin(url, n.attrs.get("href", "")) if "href" in n.attrs else ""
        if any(h in urlparse(href).netloc.lower() for h in hosts):
            found[href.split("?")[0]] = None
    for n in find(root, "img"):
        src = urljoin(url, n.attrs.get("src", "")) if n.attrs.get("src") else ""
        if src.startswith(("http://", "https://")):
            images[src] = None
    return list(found), list(images)


def unwrap_redirect(url: str) -> str:
    """The target of a search engine's redirect link."""
    p = urlparse(url)
    target = parse_qs(p.query).get("uddg")
    return unquote(target[0]) if "duckduckgo.com" in p.netloc and p.path.startswith("/l/") and target else url


def result_list(html: str, kind: str) -> list[dict]:
    """Hits (title, url, snippet, rank) of a search result page: kind "a" marks hits by anchors, kind "b" by list items."""
    root, out = parse(html), []
    if kind == "a":
        for rank, n in enumerate((x for x in find(root, "a") if x.has_class("result__a")), 1):
            box = n.parent
            while box is not None and not box.has_class("result"):
                box = box.parent
            notes = [x for x in box.walk() if x.has_class("result__snippet")] if box else []
            if n.attrs.get("href"):
                out.append({"title": n.text(), "url": unwrap_redirect(n.attrs["href"]), "snippet": notes[0].text() if notes else "", "rank": rank})
        return out
    for rank, n in enumerate((x for x in find(root, "li") if x.has_class("b_algo")), 1):
        anchors = [a for h in find(n, "h2") for a in find(h, "a") if a.attrs.get("href")]
        notes = find(n, "p")
        if anchors:
            out.append({"title": anchors[0].text(), "url": anchors[0].attrs["href"], "snippet": notes[0].text() if notes else "", "rank": rank})
    return out
