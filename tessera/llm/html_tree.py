"""HTML as a tree of blocks with the features that the graphical model sees.

Pages are cut into tags and text by patterns that never go back, so that the time
for a page is in proportion to its length, whatever stands in it. Every text is a
page: a tag or comment that never ends takes the rest with it, as in browsers; odd
declarations count as comments.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# HTML's void, inline and never-shown elements, and what an opening tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "picture", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "object", "svg", "g", "text", "tspan", "textpath", "math", "mrow", "mi", "mo",
    "mn", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose",
    "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mtable", "mtr", "mtd", "semantics",
    "annotation", "annotation-xml",
}
HIDDEN = {
    "script", "style", "template", "noscript", "title", "iframe", "canvas", "audio", "video",
    "map", "select", "option", "textarea", "datalist", "head", "noframes", "dialog",
    "annotation", "annotation-xml",
}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements whose inside is no markup, up to their own end tag.
RAW = {"script", "style", "textarea", "title", "iframe", "noframes"}
#: What a head may hold; anything else ends it, as its end tag may be left out.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head", "html"}
IN_SELECT = {"option", "optgroup", "hr", "script", "template"}
#: Parts of a page that stand in none of the hidden elements that have blocks inside; they end one that was left open.
PARTS = {"article", "main", "section", "header", "footer", "nav", "aside", "body", "h1", "h2", "h3"}
LEFT_OPEN = {"noscript", "canvas", "audio", "video", "map", "datalist"}
LIMITS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}

#: Groups of block tags that share weights; every other tag is "other".
GROUPS = {
    "article": "article", "main": "article", "p": "text", "blockquote": "text", "pre": "text", "h1": "heading",
    "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list",
    "dl": "list", "li": "item", "dt": "item", "dd": "item", "nav": "frame", "menu": "frame", "header": "header",
    "footer": "frame", "aside": "frame", "form": "form", "fieldset": "form", "button": "form", "body": "root",
    "html": "root", "div": "box", "section": "box", "figure": "figure", "figcaption": "figure", "table": "table",
    "tbody": "table", "thead": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell",
}
#: Words in class, id and role that tell what a block is for.
HINTS = {
    "away": {
        "nav", "menu", "navbar", "navigation", "footer", "sidebar", "side", "ad", "ads", "advert", "advertisement", "banner",
        "cookie", "cookies", "notice", "consent", "gdpr", "promo", "sponsor", "sponsored", "related", "share", "social",
        "subscribe", "newsletter", "breadcrumb", "breadcrumbs", "widget", "popup", "modal", "login", "search", "masthead",
        "toolbar", "pagination", "pager", "complementary", "contentinfo", "alert", "tags", "toc", "recommended",
    },
    "comments": {"comment", "comments", "reply", "replies", "discussion", "respond", "disqus"},
    "towards": {"article", "content", "entry", "post", "story", "text", "main", "body", "articlebody"},
}


class Block:
    """A block element: its parent's number, text runs as (order, text), and counts over its subtree."""

    __slots__ = ("chars", "features", "group", "label", "linked", "parent", "runs", "stops", "tag", "words")

    def __init__(self, tag: str, parent: int, attrs: list):
        self.tag, self.parent = tag, parent
        self.group = GROUPS.get(tag, "other")
        self.runs: list[tuple[int, str]] = []
        self.chars = self.linked = self.stops = 0
        self.label: int | None = None
        words = set()
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                words.update(value.lower().replace("-", " ").replace("_", " ").split())
            elif key == "data-label" and value in ("0", "1"):  # of training pages; others use the name for words
                self.label = int(value)
        self.words = words


_ATTRIBUTE = r"""=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)?+"""
_TAG = re.compile(rf"<(/?+)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>")
_ATTRIBUTES = re.compile(r"""(=?+[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]++))?+)?+""")
_LETTER = re.compile("[a-zA-Z]")


def attributes(inside: str) -> list[tuple[str, str | None]]:
    """The names and values within a tag."""
    found = []
    for m in _ATTRIBUTES.finditer(inside):
        value = next((v for v in m.groups()[1:] if v is not None), None)
        found.append((m[1].lower(), None if value is None else unescape(value)))
    return found


class Tree:
    """Blocks of a page in document order; a parent stands before its children."""

    def __init__(self):
        self.blocks = [Block("html", -1, [])]
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.open = Counter(["html"])  # tags on the stack
        self.hidden, self.links, self.order = 0, 0, 0
        self.run: list[str] = []
        self.linked = 0

    def feed(self, html: str) -> None:
        """Read a page to its end."""
        at, endless = 0, set()  # endless: elements without markup that have no end tag from here on
        while at < len(html):
            start = html.find("<", at)
            if start < 0:
                self.handle_data(html[at:])
                return
            if start > at:
                self.handle_data(html[at:start])
            after = html[start + 1 : start + 2]
            if after == "!" and html.startswith("--", start + 2):
                short = html.startswith((">", "->"), start + 4)
                end = html.find(">", start + 4) + 1 if short else html.find("-->", start + 4) + 3
                if end < (1 if short else 3):
                    return
                at = end
            elif after in ("!", "?") or after == "/" and not _LETTER.match(html, start + 2):
                at = html.find(">", start + 1) + 1
                if not at:
                    return
            elif after == "/" or after and _LETTER.match(after):
                tag = _TAG.match(html, start)
                if not tag:
                    return
                at, of = tag.end(), tag[2].lower()
                if tag[1]:
                    self.handle_endtag(of)
                    continue
                self.handle_starttag(of, attributes(tag[3]) if tag[3] and of not in INLINE else [])
                if of in RAW:
                    close = re.compile(rf"</{of}(?=[\s/>])", re.IGNORECASE)
                    end = None if of in endless else close.search(html, at)
                    if end:
                        at = end.start()
                    elif of in ("script", "style"):
                        return
                    else:  # the others lost their end tag: what follows is the page
                        endless.add(of)
                        self.handle_endtag(of)
            else:
                self.handle_data("<")
                at = start + 1

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            block = self.blocks[self.stack[-1][1]]
            block.runs.append((self.order, text))
            block.chars += len(text)
            block.linked += min(self.linked, len(text))
            block.stops += sum(map(text.count, ".!?。"))
            self.order += 1
        self.run, self.linked = [], 0

    def _pop(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            self.open[tag] -= 1
        if any(tag not in INLINE for tag, _ in self.stack[at:]):
            self.flush()
        del self.stack[at:]

    def _end(self, ended: set[str]) -> None:
        """Close the outermost open one of these elements and what stands in it."""
        for at in range(1, len(self.stack)):
            if self.stack[at][0] in ended:
                self._pop(at)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            if self.open["head"] and tag not in IN_HEAD:
                self._end({"head"})
            if self.open["select"] and tag not in IN_SELECT:
                self._end({"select"})
            if tag in PARTS and any(self.open[x] for x in LEFT_OPEN):
                self._end(LEFT_OPEN)
        if tag in ("br", "text", "mtr", "mtd"):  # parts that stand apart without a block
            self.run.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in ("html", "body") and self.open[tag]:
            return
        if tag not in INLINE:
            # an open paragraph ends before any block, an open list item before the next, ...
            closes, limits = CLOSES.get(tag, ()), LIMITS.get(tag, ())
            for at in range(len(self.stack) - 1, 0, -1) if closes or self.open["p"] else ():
                have = self.stack[at][0]
                if have == "p" or have in closes:
                    self._pop(at)
                    if have == "p" or tag not in ("tr", "tbody", "tfoot"):
                        break
                elif have not in INLINE and (have in limits or not closes or have in ("div", "section", "article", "table", "ul", "ol", "dl")):
                    break
            self.flush()
            self.blocks.append(Block(tag, self.stack[-1][1], attrs))
            self.stack.append((tag, len(self.blocks) - 1))
        else:
            self.stack.append((tag, self.stack[-1][1]))
        self.open[tag] += 1
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                self._pop(at)
                return
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return  # a stray end of an inline element closes no block

    def handle_data(self, data: str) -> None:
        if self.open["head"] and self.stack[-1][0] == "head" and not data.isspace():
            self._end({"head"})
        if not self.hidden:
            data = unescape(data)
            self.run.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str) -> list[Block]:
    """The blocks of a page, with features; any text is a page, an empty one has a root only."""
    tree = Tree()
    tree.feed(html)
    tree.flush()
    found = tree.blocks
    own = [(b.chars, b.stops) for b in found]
    for b in reversed(found[1:]):
        above = found[b.parent]
        above.chars, above.linked, above.stops = above.chars + b.chars, above.linked + b.linked, above.stops + b.stops
    for b, (chars, stops) in zip(found, own, strict=True):
        density = 4 if not b.chars else min(3, int(3 * b.linked / b.chars + 0.3))
        size = sum(b.chars > limit for limit in (0, 25, 80, 300))
        hints = [f"hint {kind}" for kind, words in HINTS.items() if words & b.words]
        b.features = [
            "bias", f"group {b.group}", f"tag {b.tag}", f"links {density}", f"size {size}", *hints,
            f"stops {min(2, b.stops)}", f"own {chars > 0} {b.group}", f"prose {min(4, stops)} {chars > 120}", f"within {found[b.parent].group if b.parent >= 0 else 'none'} {b.group}",
        ]
    return found
