"""The main text of a page, whether or not its author marked it.

The page is read into a tree of blocks.  Every block of running text gives
points, for its length and its commas, to the block around it and half of them
to the one around that; a block's points count by the share of its text that is
no link, and by what its class and id say.  The best block is the main text,
with neighbours that are about as good or that are plain paragraphs.  A single
article element with text is taken as it stands.  Navigation, footers, forms and
blocks named as advertising or comments are cut out.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators.html import to_markdown

BLOCKS = {"body", "div", "section", "article", "main", "td", "th", "tr", "table", "ul", "ol", "li", "dl", "dd", "dt", "blockquote", "pre", "p", "h1", "h2", "h3", "h4", "h5", "h6", "header", "figure", "nav", "footer", "aside", "form"}
HOLDERS = {"body", "div", "section", "article", "main", "td"}  # what may be the main text
LEFT_OUT = {"nav", "footer", "aside", "form"}
UNREAD = {"script", "style", "noscript", "template", "head"}
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr"}
LEAST_TEXT, LEAST_PARAGRAPH = 25, 80  # characters of a block that counts, of a neighbour that stays
NEIGHBOUR = 0.2  # of the best block's points

_GOOD = re.compile(r"article|body|content|entry|main|post|story|text", re.IGNORECASE)
_BAD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|footer|menu|nav\w*|promo\w*|related|share|sidebar|social|sponsor\w*|widget)(?:$|[\s_-])", re.IGNORECASE)


class _Block:
    def __init__(self, tag: str, hint: str, parent: _Block | None, start: int, inner: int):
        self.tag, self.parent, self.start, self.inner, self.end = tag, parent, start, inner, inner
        self.children: list[_Block] = []
        self.own, self.linked, self.commas, self.points = 0, 0, 0, 0.0
        self.all, self.all_linked = 0, 0  # with the blocks inside
        self.left_out = tag in LEFT_OUT or bool(_BAD.search(hint)) or (parent is not None and parent.left_out)
        self.weight = 1.25 if _GOOD.search(hint) or tag in ("article", "main") else 1.0
        if parent is not None:
            parent.children.append(self)


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.root = _Block("body", "", None, 0, 0)
        self.open, self.unread, self.links = [self.root], 0, 0
        self.feed(html)
        self.close()
        for block in self.open:
            block.end = len(html)
        for block in reversed(list(_walk(self.root))):
            block.all, block.all_linked = block.all + block.own, block.all_linked + block.linked
            if block.parent is not None:
                block.parent.all, block.parent.all_linked = block.parent.all + block.all, block.parent.all_linked + block.all_linked

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, upto: int, end: int) -> None:
        while len(self.open) > upto:
            self.open.pop().end = end

    def handle_starttag(self, tag, attrs):
        if tag in UNREAD:
            self.unread += 1
        elif tag == "a":
            self.links += 1
        elif tag in BLOCKS:
            at = self._at()
            if self.open[-1].tag == "p" or tag in ("li", "dd", "dt", "tr", "td") and self.open[-1].tag == tag:
                self._shut(len(self.open) - 1, at)  # left open by the author
            given = dict(attrs)
            hint = f"{given.get('class') or ''} {given.get('id') or ''}"
            self.open.append(_Block(tag, hint, self.open[-1], at, at + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag):
        if tag in UNREAD:
            self.unread = max(0, self.unread - 1)
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    self._shut(k, self._at())
                    break

    def handle_data(self, data):
        if not self.unread:
            n, block = len(" ".join(data.split())), self.open[-1]
            block.own += n
            block.linked += n if self.links else 0
            block.commas += data.count(",") + data.count("，") + data.count("、")


def _walk(block: _Block):
    """A block and all in it, in the page's order."""
    waiting = [block]
    while waiting:
        block = waiting.pop()
        yield block
        waiting += reversed(block.children)


def _share_of_links(block: _Block) -> float:
    return block.all_linked / block.all if block.all else 0.0


def _scored(root: _Block, least: int) -> list[tuple[float, _Block]]:
    """Holders with points from blocks of `least` characters, in the page's order."""
    for block in _walk(root):
        if block.left_out or block.own < least or block.tag[0] == "h" and block.tag[1:].isdigit():
            continue
        points = 1 + block.commas + min(block.own / 100, 3)
        around = block if block.tag in HOLDERS else block.parent
        around.points += points
        if around.parent is not None:
            around.parent.points += points / 2
    return [(b.points * b.weight * (1 - _share_of_links(b)), b) for b in _walk(root) if b.tag in HOLDERS and b.points and not b.left_out]


def _cut(html: str, block: _Block, whole: bool) -> str:
    """A block's source, from its own tag on where it is `whole`, without what is left out in it."""
    out, at = [], block.start if whole else block.inner
    for part in _walk(block):
        if part is not block and part.left_out and part.start >= at:
            out.append(html[at : part.start])
            at = max(html.find(">", part.end) + 1, part.end) if html.startswith("</", part.end) else part.end
    stop = html.find(">", block.end) + 1 if whole and html.startswith("</", block.end) else block.end
    return "".join(out) + html[at:stop]


def main_html(html: str | None) -> str | None:
    """The source of the main text; all of a page that has none."""
    if html is None:
        return None
    root = _Tree(html).root
    marked = [b for b in _walk(root) if b.tag == "article"]
    if len(marked) == 1 and marked[0].all:
        return _cut(html, marked[0], False)
    scored = _scored(root, LEAST_TEXT) or _scored(root, 1)  # a page of short lines has its main text, too
    if not scored:
        return html
    most, best = max(scored, key=lambda s: (s[0], -s[1].start))
    points = {id(b): s for s, b in scored}
    if best.parent is None:
        return _cut(html, best, False)
    kept = [
        b for b in best.parent.children
        if b is best or not b.left_out and (points.get(id(b), 0) >= max(NEIGHBOUR * most, 10) or b.tag == "p" and b.own >= LEAST_PARAGRAPH and _share_of_links(b) < 0.25)
    ]
    return _cut(html, best, False) if kept == [best] else "\n".join(_cut(html, b, True) for b in kept)


@F.pandas_udf(T.StringType())
def main_part(html: pd.Series) -> pd.Series:
    return html.map(main_html)


@F.pandas_udf(T.StringType())
def main_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: to_markdown(main_html(h)))
