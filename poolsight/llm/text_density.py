"""The main text of web pages by composite text density.

A page is read into a tree of elements, without those that by their tag, role or name hold no main
text. Every element gets a density: characters a tag, raised or lowered by how many characters and
tags lie in links, against the share of links on the whole page. An element's sum adds the densities
of its children. The element with the largest sum is the core. The smallest density on its path to
the body is a threshold: elements beside that path that reach it belong to the text as well, and so do
headings, paragraphs, lists and tables next to the core. Where a page names `article` or `main`
elements the core is sought in them, and the whole element around it is the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements deeper than this become siblings, as in browsers.
DEEPEST = 512
#: Characters of results gathered before they are handed on.
BATCH_CHARS = 1 << 24

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body caption html legend optgroup option tbody tfoot thead tr".split())
#: Open elements that a start tag ends, and elements that such an end does not pass.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(("table",))),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(("table",))),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
NO_TEXT = frozenset(
    "head script style template noscript iframe object canvas svg audio video map nav footer aside form button select textarea input "
    "datalist dialog menu title meter progress applet embed noembed noframes".split()
)
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tablist".split())
#: Words of class and id that name parts outside the main text.
NO_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsors sponsored promo promos promoted promotion "
    "banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar cookie cookies "
    "consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login comment "
    "comments disqus replies respond related recommended recommendations share sharing social widget widgets pager pagination paging skip "
    "header copyright disclaimer paywall".split()
)
MAIN = frozenset(("article", "main"))
#: Beside the core, these belong to the text unless they are mostly links.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote ul ol dl table figure section".split())

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG_PART = re.compile(r"""[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=]""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """Elements in page order (parents first); text as pieces between breaks."""

    def __init__(self, html: str):
        self.tags, self.parents, self.hidden, self.called = ["html"], [-1], [False], [""]
        #: (element, text) in page order; None for the border of a block.
        self.texts: list[tuple[int, str | None]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, opened = [0], {}
        at, n = 0, len(html)
        while at < n:
            start = html.find("<", at)
            if start < 0:
                start = n
            if start > at:
                self._text(stack[-1], unescape(html[at:start]))
            if start == n:
                return
            after = html[start + 1 : start + 2]
            if after.isascii() and after.isalpha():
                name = _NAME.match(html, start + 1).group().lower()
                at, attributes = self._attributes(html, start + 1 + len(name))
                self._start(name, attributes, stack, opened)
                if name in RAW and stack[-1] and self.tags[stack[-1]] == name:
                    at = self._raw(html, at, name, stack, opened)
                elif name == "plaintext":
                    return self._text(stack[-1], html[at:])
            elif after == "/" and html[start + 2 : start + 3].isascii() and html[start + 2 : start + 3].isalpha():
                name = _NAME.match(html, start + 2).group().lower()
                at, _ = self._attributes(html, start + 2 + len(name))
                self._end(name, stack, opened)
            elif html.startswith("<!--", start):
                if html.startswith((">", "->"), start + 4):
                    at = html.index(">", start + 4) + 1
                else:
                    stop = html.find("-->", start + 4)
                    at = n if stop < 0 else stop + 3
            elif after in ("!", "?", "/"):
                stop = html.find(">", start + 2)
                at = n if stop < 0 else stop + 1
            else:
                self._text(stack[-1], "<")
                at = start + 1

    @staticmethod
    def _attributes(html: str, at: int) -> tuple[int, str]:
        """(position after the tag, its attributes as text); a quoted value may hold `>`."""
        begin, n = at, len(html)
        if html.startswith(">", at):
            return at + 1, ""
        while at < n and html[at] != ">":
            at = _TAG_PART.match(html, at).end()
        return min(at + 1, n), html[begin:at]

    def _raw(self, html: str, at: int, name: str, stack: list[int], opened: dict) -> int:
        """Skip the text of a raw element and close it."""
        closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
        self._end(name, stack, opened)
        if closing is None:
            return len(html)
        return self._attributes(html, closing.end())[0]

    def _text(self, element: int, text: str) -> None:
        if not self.hidden[element]:
            self.texts.append((element, text))

    def _pop(self, stack: list[int], opened: dict) -> None:
        tag = self.tags[stack.pop()]
        opened[tag] -= 1
        self._border(tag, stack[-1])

    def _border(self, tag: str, element: int) -> None:
        if tag in BLOCKS:
            self.texts.append((element, None))
        elif tag in CELLS:
            self.texts.append((element, " "))

    def _start(self, name: str, attributes: str, stack: list[int], opened: dict) -> None:
        if name in ENDS_P and opened.get("p"):
            self._end("p", stack, opened)
        if name in CLOSES:
            ended, limits = CLOSES[name]
            while any(opened.get(t) for t in ended):
                last = next((i for i in range(len(stack) - 1, 0, -1) if self.tags[stack[i]] in ended or self.tags[stack[i]] in limits), 0)
                if not last or self.tags[stack[last]] in limits:
                    break
                while len(stack) > last:
                    self._pop(stack, opened)
        if name in ("html", "body") and (name == "html" or opened.get("body")):
            return
        parent = stack[-1]
        if name == "br":
            return self._text(parent, " ")
        self._border(name, parent)
        if name in VOID:
            return
        element = len(self.tags)
        self.tags.append(name)
        self.parents.append(parent)
        outside, called = _outside(name, attributes)
        self.hidden.append(self.hidden[parent] or outside)
        self.called.append(called)
        if len(stack) >= DEEPEST:
            self._pop(stack, opened)
        stack.append(element)
        opened[name] = opened.get(name, 0) + 1

    def _end(self, name: str, stack: list[int], opened: dict) -> None:
        if name == "br":
            return self._text(stack[-1], " ")
        if name in ("html", "body") or not opened.get(name):
            return
        while self.tags[stack[-1]] != name:
            self._pop(stack, opened)
        self._pop(stack, opened)


def _outside(name: str, attributes: str) -> tuple[bool, str]:
    """(whether an element holds no main text, "header" or "named" if it may hold none by what it is called)."""
    if name in NO_TEXT:
        return True, ""
    if name == "header":
        return False, "header"
    if not attributes.strip(" /") or name == "body":
        return False, ""
    values = {}
    for key, double, single, bare in _ATTRIBUTE.findall(attributes):
        values.setdefault(key.lower(), unescape(double or single or bare))
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True, ""
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True, ""
    if values.get("role", "").lower() in NO_TEXT_ROLES:
        return True, ""
    words = {w.lower() for w in _WORD.findall(values.get("class", "") + " " + values.get("id", ""))}
    found = words & NO_TEXT_WORDS
    return False, "header" if found == {"header"} else "named" if found else ""


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by line breaks; empty if there is none.

    References are decoded, white space inside a block is one space; nothing of the chosen parts is
    dropped or cut. Markup may be broken: unclosed elements end with their parent, stray end tags are
    ignored, cut off tags and comments end with the page. Equal sums go to the first element.
    """
    if not html:
        return ""
    page = Page(html)
    n = len(page.tags)
    parents = page.parents
    holds_main, in_main = [False] * n, [False] * n
    for i in range(1, n):
        in_main[i] = in_main[parents[i]] or page.tags[i] in MAIN
    hidden = page.hidden
    for i in range(n - 1, 0, -1):
        if holds_main[i] or (page.tags[i] in MAIN and not hidden[i] and not page.called[i]):
            holds_main[parents[i]] = True
    for i in range(1, n):
        # a header inside the main text carries its title; a named part around the main text is a wrapper
        named = page.called[i] and not holds_main[i] and not (page.called[i] == "header" and in_main[i])
        hidden[i] = bool(hidden[i] or hidden[parents[i]] or named)
    chars, linked, tags, link_tags = _counts(page, hidden)
    share = max(linked[0], 1) / max(chars[0], 1)
    density = [_density(*x, share) for x in zip(chars, linked, tags, link_tags)]
    chosen = _choose(page, hidden, density, chars, linked)
    if chosen is None:
        return ""
    blocks, now = [], []
    for element, text in page.texts:
        if text is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif chosen[element] and not hidden[element]:
            now.append(text)
    if now:
        blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def _counts(page: Page, hidden: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters, characters in links, tags and link tags below each element, itself included."""
    n = len(page.tags)
    chars, linked = [0] * n, [0] * n
    tags = [0 if h else 1 for h in hidden]
    in_link, link_tags = [False] * n, [0] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parents[i]] or page.tags[i] == "a"
        link_tags[i] = int(page.tags[i] == "a" and not hidden[i])
    for element, text in page.texts:
        if text is not None and not hidden[element]:
            size = sum(map(len, text.split()))
            chars[element] += size
            if in_link[element]:
                linked[element] += size
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        chars[up] += chars[i]
        linked[up] += linked[i]
        tags[up] += tags[i]
        link_tags[up] += link_tags[i]
    return chars, linked, tags, link_tags


def _density(c: int, lc: int, t: int, lt: int, share: float) -> float:
    """Composite text density: C/T times the log of (C/LC * T/LT) to the base ln(C/-LC * LC + share * C + e).

    C, LC and -LC are the characters below an element, those in and out of links, T and LT its tags and
    link tags, `share` the part of the page's characters that lies in links; LC, -LC, LT of 0 count as 1.
    """
    if not c or not t:
        return 0.0
    base = log(c / max(c - lc, 1) * max(lc, 1) + share * c + e)
    inside = c / max(lc, 1) * t / max(lt, 1)
    return c / t * log(max(inside, 1.0)) / log(base)


def _choose(page: Page, hidden: list[bool], density: list[float], chars: list[int], linked: list[int]) -> list[bool] | None:
    """The elements whose text belongs to the result."""
    n, parents = len(page.tags), page.parents
    sums = [0.0] * n
    for i in range(1, n):
        if not hidden[i]:
            sums[parents[i]] += density[i]
    # the text directly in an element counts like a child of one tag
    own = [0] * n
    for element, text in page.texts:
        if text is not None and not hidden[element]:
            own[element] += sum(map(len, text.split()))
    share = max(linked[0], 1) / max(chars[0], 1)
    sums = [s + _density(o, 0, 1, 0, share) for s, o in zip(sums, own)]
    named = [page.tags[i] in MAIN and not hidden[i] and chars[i] > 0 for i in range(n)]
    inside = [False] * n
    for i in range(1, n):
        inside[i] = named[i] or inside[parents[i]]
    some_named = any(named)
    scope = [i for i in range(n) if not hidden[i] and chars[i] and (inside[i] or not some_named)]
    if not scope:
        return None
    core = max(scope, key=lambda i: (sums[i], -i))
    if some_named:
        # the outermost article around the core, or else the main element
        path = [core]
        while parents[path[-1]] >= 0:
            path.append(parents[path[-1]])
        around = [i for i in path if named[i]]
        article = [i for i in around if page.tags[i] == "article"]
        return _below(parents, {(article or around)[-1]})
    path = [core]
    while parents[path[-1]] >= 0 and page.tags[path[-1]] != "body":
        path.append(parents[path[-1]])
    threshold = min(density[i] for i in path)
    on_path, top = set(path), path[-1]
    beside = set()
    for i in range(1, n):
        if parents[i] in on_path and i not in on_path and i != core and not hidden[i] and chars[i]:
            prose = page.tags[i] in PROSE and 2 * linked[i] < chars[i] and parents[i] != top
            if density[i] >= threshold or prose or page.tags[i] == "h1":
                beside.add(i)
    return _below(parents, beside | {core})


def _below(parents: list[int], roots: set[int]) -> list[bool]:
    out = [i in roots for i in range(len(parents))]
    for i in range(1, len(out)):
        out[i] = out[i] or out[parents[i]]
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, size, texts = 0, 0, []

        def result(stop: int) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            columns = [batch.column(c).slice(begin, stop - begin) for c in ("page_id", "url")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(lengths)], ["page_id", "url", "text", "n_chars"])

        for i, html in enumerate(batch.column("html")):
            texts.append(main_text(html.as_py()))
            size += len(texts[-1])
            if size >= BATCH_CHARS:
                yield result(i + 1)
                begin, size, texts = i + 1, 0, []
        if texts:
            yield result(batch.num_rows)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html, any other columns).

    Null and empty pages give an empty text, as do pages without any text outside the left out parts;
    repeated rows stay, null ids and addresses are passed on, an empty table gives an empty result.
    Pages are read whole, one at a time, and nothing is shuffled.
    """
    kept = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = kept.schema["page_id"].dataType.simpleString()
    return kept.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
