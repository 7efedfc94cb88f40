"""Main text of web pages by tree scoring.

The page is read into a light tree (unclosed paragraphs and list items are closed as browsers do). Every paragraph gives
points for its length and commas to its ancestors, half as many per step after the first; a container's points are discounted by
its share of link text. The best container is kept with siblings that score well or read like paragraphs.
Boilerplate (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), known by element,
role or the words of class and id, takes no part in scoring and is left out wherever it stands; headers and footers of an article are
its own, and a part that holds nearly all text of a page stays whatever its class.

Defined results: null or empty html, or html without text, gives an empty text of 0 characters; repeated rows are extracted each;
an empty table gives no rows; extra columns are not read. Time and memory are linear in a page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import source_rows

#: Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head nav footer aside form menu search script style noscript template svg math canvas iframe object audio video button select option textarea input label fieldset dialog".split()
)
PARAGRAPH = frozenset("p pre blockquote li td th dd dt figcaption caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related reply replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())

#: A part named like boilerplate stays if all other text is less than this share of it.
LOSS = 0.1
#: Elements whose content is no markup, or is never shown.
RAW = frozenset("script style noscript template textarea svg iframe xmp title".split())
#: Class words that name a part of an article as well as a part of a page.
ARTICLE_PARTS = frozenset("header masthead banner footer".split())

_name = re.compile(r"[a-zA-Z][^\s/>]*")
_quote_or_end = re.compile("[\"'>]")
_attribute = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?")
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|</{tag}\Z", re.I) for tag in RAW}
_word = re.compile(r"[a-z]+")


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of repeated ones the first holds."""
    out: dict[str, str] = {}
    for m in _attribute.finditer(text):
        out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "")
    return attributes.get("role") in UNLIKELY_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _unlikely(attributes: dict[str, str], in_article: bool) -> bool:
    """Whether class or id name a part of a page that is no article."""
    words = _word.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    return any(w in UNLIKELY and not (in_article and w in ARTICLE_PARTS) for w in words)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of each piece of a page, kind being text, open, close or gap. Each character is looked at a fixed number of times, whatever the markup."""
    at, last_end, last_comment, closes = 0, html.rfind(">"), html.rfind("<!--"), {q: html.rfind(q) for q in "\"'"}
    quotes = True  # until a tag's quotes swallow the rest of the page
    while (start := html.find("<", at)) >= 0:
        name = _name.match(html, start + 1 + html.startswith("/", start + 1)) if start < last_end else None
        if not name and not html.startswith(("<!", "<?", "</"), start) or start > last_end and not html.startswith("<!--", start):
            if start > max(last_end, last_comment):
                break  # no tag can end any more: the rest is text
            yield "text", "", html[at : start + 1]
            at = start + 1
            continue
        if start > at:
            yield "text", "", html[at:start]
        if not name:
            stop = html.find("-->", start + 4) + 3 if html.startswith("<!--", start) else html.find(">", start) + 1
            at = stop if stop > 2 else len(html)
            continue
        stop, i = -1, name.end()
        while quotes and (m := _quote_or_end.search(html, i)):
            if m[0] == ">":
                stop = m.start()
                break
            if m.start() >= closes[m[0]]:
                break
            i = html.index(m[0], m.end()) + 1
        if stop < 0:
            quotes, stop = quotes and i < last_end, html.find(">", name.end())
        tag, at = name[0].lower(), stop + 1
        if html[start + 1] == "/":
            yield "close", tag, ""
            continue
        if tag in RAW:
            end = _raw_end[tag].search(html, at)
            at = end.end() if end else len(html)
            yield "gap", tag, ""
            continue
        yield "open", tag, html[name.end() : stop]
    if at < len(html):
        yield "text", "", html[at:]


class Page:
    """Nodes as parallel lists; blocks of text parts in page order."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.dropped, self.link = ["#page"], [0], [False], [False]
        #: whether a node is within an article, its nearest block, and the topmost node above it that only its class or id drops
        self.in_article, self.block, self.soft = [False], [0], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self.owner: list[int] = []
        self._read(html)

    def _open(self, tag: str, under: int, text: str) -> int:
        attributes, node = _attributes(text) if text else {}, len(self.tag)
        shell = tag in ("html", "body", "article", "main")
        hard = tag in DROPPED or tag == "header" and not self.in_article[under] or not shell and _hidden(attributes)
        soft = not shell and _unlikely(attributes, self.in_article[under])
        self.tag.append(tag)
        self.parent.append(under)
        self.dropped.append(self.dropped[under] or hard)
        self.soft.append(self.soft[under] or (node if soft else 0))
        self.link.append(self.link[under] or tag == "a")
        self.in_article.append(self.in_article[under] or tag in ("article", "main"))
        self.block.append(node if tag in BLOCK else self.block[under])
        return node

    def _read(self, html: str) -> None:
        stack, parts, opened = [0], [], Counter()

        def flush() -> None:
            nonlocal parts
            if parts:
                self.owner.append(self.block[stack[-1]])
                self.blocks.append(parts)
                parts = []

        def close_to(k: int) -> None:
            gone = [self.tag[n] for n in stack[k:]]
            if any(t in BLOCK for t in gone):
                flush()
            opened.subtract(gone)
            del stack[k:]

        for kind, tag, rest in tokens(html):
            if kind == "text":
                parts.append((stack[-1], rest))
            elif kind == "gap":
                parts.append((stack[-1], " "))
            elif kind == "close":
                k = len(stack) - 1 if opened[tag] > 0 else 0
                while k and self.tag[stack[k]] != tag:
                    if tag not in BLOCK and self.tag[stack[k]] in BLOCK:
                        k = 0
                        break
                    k -= 1
                if k:
                    close_to(k)
            elif tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    parts.append((stack[-1], " "))
            else:
                if tag in BLOCK:
                    flush()
                    for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():  # an open paragraph ends where a block begins
                        if self.tag[stack[k]] == "p":
                            close_to(k)
                            break
                        if self.tag[stack[k]] in BLOCK:
                            break
                    ends, stops = CLOSES.get(tag, ("", ()))
                    found = 0
                    for k in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in ends.split()) else ():
                        if self.tag[stack[k]] in stops:
                            break
                        if self.tag[stack[k]] in ends.split():
                            found = k
                    if found:
                        close_to(found)
                node = self._open(tag, stack[-1], rest)
                if not rest.endswith("/") or tag in BLOCK:
                    stack.append(node)
                    opened[tag] += 1
        flush()

    def settle(self) -> None:
        """Decide on what only class or id drop: it goes, unless it holds nearly all text that is not dropped otherwise."""
        inside, outside = Counter(), 0
        for owner, parts in zip(self.owner, self.blocks, strict=True):
            if not self.dropped[owner] and not self.link[owner]:
                n = sum(len(t) for m, t in parts if not self.link[m])
                inside[self.soft[owner]] += n
        outside = inside.pop(0, 0)
        kept = {r for r, n in inside.items() if outside < LOSS * n and n == max(inside.values())}
        self.dropped = [d or bool(s) and s not in kept for d, s in zip(self.dropped, self.soft, strict=True)]

    def texts(self) -> list[tuple[int, str, int]]:
        """(owner, text, link characters) of every block that has kept text, in page order."""
        self.settle()
        out = []
        for owner, parts in zip(self.owner, self.blocks, strict=True):
            if self.dropped[owner]:
                continue
            kept = [(n, t) for n, t in parts if not self.dropped[n]]
            text = " ".join(unescape("".join(t for _, t in kept)).split())
            if text:
                linked = sum(len(t) for n, t in kept if self.link[n])
                out.append((owner, text, min(linked, len(text))))
        return out


def main_text(html: str | None) -> str:
    """The page's main text, one block per line."""
    if not html:
        return ""
    page = Page(html)
    blocks = page.texts()
    if not blocks:
        return ""
    size, linked, score = Counter(), Counter(), {}
    for owner, text, links in blocks:
        size[owner] += len(text)
        linked[owner] += links
    for node in range(len(page.tag) - 1, 0, -1):  # parents have smaller numbers
        if node in size:
            size[page.parent[node]] += size[node]
            linked[page.parent[node]] += linked[node]
    for owner, text, links in blocks:
        if page.tag[owner] in HEADING:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text)) * (1 if len(text) >= 25 else 0.1)
        node, step = (page.parent[owner] if page.tag[owner] in PARAGRAPH else owner), 1.0
        while node and step > 0.01:
            score[node] = score.get(node, 0) + points * step
            node, step = page.parent[node], step / 2
    final = {n: s * (1 - linked[n] / size[n]) + (25 if page.tag[n] in ("article", "main") else 0) for n, s in score.items() if page.tag[n] not in ("html",)}
    if not final:
        keep = {0}
    else:
        best = max(final, key=lambda n: (final[n], -n))
        node = best
        while node:  # a part of an article stands for the article
            if page.tag[node] == "article":
                best = node
            node = page.parent[node]
        keep = {best}
        limit = max(10, 0.2 * final.get(best, 0))
        if page.tag[best] not in ("body", "article", "main"):
            for n, up in enumerate(page.parent):
                if n and up == page.parent[best] and not page.dropped[n] and n in size:
                    if final.get(n, 0) >= limit or page.tag[n] in HEADING or page.tag[n] == "p" and (size[n] > 80 and linked[n] < 0.25 * size[n] or not linked[n]):
                        keep.add(n)
        elif page.tag[best] == "article":  # an article in several parts
            keep |= {n for n, up in enumerate(page.parent) if n and up == page.parent[best] and page.tag[n] == "article" and final.get(n, 0) >= max(limit, 0.5 * final.get(best, 0))}
    out, inside = [], {}

    def under(n: int) -> bool:
        path = []
        while n not in inside:
            if n in keep:
                inside[n] = True
                break
            if not n:
                inside[n] = False
                break
            path.append(n)
            n = page.parent[n]
        for p in path:
            inside[p] = inside[n]
        return inside[n]

    for owner, text, _ in blocks:
        if under(owner):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html). No shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = source_rows(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
