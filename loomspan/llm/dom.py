"""A small, forgiving HTML reader: the tree of block elements and the text blocks in page order.

Siblings of one key in a row are one node of the tree, as the repeated element of a list; a key is the tag with
its class, id and role. Inline elements leave no node. ``br`` is white space inside a block.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Elements of HTML by kind, and words that mark regions which are not the main text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUTSIDE = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "embed", "canvas", "svg", "button", "select", "option", "textarea", "input", "dialog", "menu", "search", "audio", "video", "map"}
REGIONS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice",
    "popup", "modal", "newsletter", "subscribe", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "comment", "comments", "commentlist", "disqus", "respond", "share", "social", "pagination", "login", "hidden",
}
PARTS = {"area", "bar", "block", "bottom", "box", "container", "inner", "item", "left", "list", "outer", "right", "section", "slot", "top", "widget", "wrap", "wrapper"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
#: Closing tags that reach beyond a table's cell.
BEYOND_CELLS = {"tr", "table", "tbody", "thead", "tfoot", "body", "html", "article", "main", "section"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


#: Elements of running text, whose classes and ids say nothing of regions; inline ones can only be hidden by their class.
RUNNING = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "li", "dt", "dd", "tr", "td", "th", "caption", "figure", "figcaption", "article", "main", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "dt", "th", "caption", "figcaption", "legend", "summary"}
INLINE = {"abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var"}


def names_region(name: str, strict: bool = False) -> bool:
    """Whether a class or id names a region that is not the main text: as a whole or with words for parts of a layout, and
    unless ``strict`` also by its last word.

    >>> [names_region(x) for x in ("ad", "cookie-notice", "commentList", "tasting-menu", "side-effects", "notice-of-results", "share-prices")]
    [True, True, True, True, False, False, False]
    >>> [names_region(x, strict=True) for x in ("ad", "cookie-notice", "commentList", "tasting-menu")]
    [True, True, True, False]
    """
    own = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    if not own or "of" in own:
        return False
    return own[0] in REGIONS and all(w in PARTS or w in REGIONS for w in own[1:]) or (not strict and own[-1] in REGIONS)


@dataclass
class Page:
    """``keys`` and ``parents`` of the tree's nodes in order of opening; ``blocks`` of (node, text, inside, linked characters)."""

    keys: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str, bool, int]] = field(default_factory=list)

    def structure(self) -> tuple:
        return tuple(zip(self.keys, self.parents))


def _marks(tag: str, raw: str, inside: bool) -> tuple[str, bool, bool]:
    """(key, whether it is outside the main text, whether it is the main region) of an element, which may stand inside that region.

    Names count for containers alone; inside the main region, and for ids, only those that are nothing but a region's name.
    """
    if not raw or raw.isspace():
        return tag, tag in OUTSIDE, tag in ("article", "main")
    name, outside, main = [tag], tag in OUTSIDE, tag in ("article", "main")
    for m in ATTRIBUTE.finditer(raw):
        k = m[1].lower()
        v = m[2] or m[3] or m[4] or ""
        if k in ("class", "id"):
            own = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", v).lower())
            if tag in INLINE:
                outside |= "hidden" in v.lower().split()
            elif tag not in RUNNING:
                outside |= any(names_region(x, inside or k == "id") for x in v.split())
            outside |= v.lower() == "header" and tag not in ("h1", "h2", "h3")
            name.append("-".join(w for w in own if not w.isdigit()))
        elif k == "role":
            outside |= v.lower() in OUTSIDE_ROLES
            main |= v.lower() == "main"
            name.append(v.lower())
        elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true"):
            outside = True
        elif k == "style":
            outside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v.lower()))
    return ".".join(name), outside, main


def parse(source: str) -> Page:
    page = Page()
    keys, parents, blocks = page.keys, page.parents, page.blocks
    kids: list[dict[str, int]] = [{}]  # by node, 0 is the root: kids by key
    last: list[str] = [""]
    again: list[bool] = [False]
    keys.append("")
    parents.append(-1)
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, node, outside, inside the main region
    opened: dict[str, list[int]] = {}  # places on the stack by tag, and those of block elements
    block_at: list[int] = []
    place = lambda *tags: max((opened[t][-1] for t in tags if opened.get(t)), default=0)
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, node, outside, inside = stack[-1]
                if not outside:
                    blocks.append((node, joined, inside, linked))
            text.clear()
        linked = 0

    def pop(k: int) -> None:
        if block_at and block_at[-1] >= k:
            flush()
        for tag, *_ in reversed(stack[k:]):
            opened[tag].pop()
            if tag in BLOCKS:
                block_at.pop()
        del stack[k:]

    at, n = 0, len(source)
    while at < n:
        m = TAG.search(source, at)
        end = m.start() if m else n
        if end > at and not stack[-1][2]:
            piece = source[at:end]
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            if opened.get("a"):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            k = place(tag)
            if tag == "p" and not k:
                flush()
            if k and (tag in BEYOND_CELLS or k >= place("td", "th", "table")):
                pop(k)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = close.end() if close else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            if tag in CLOSES:
                these, stop = CLOSES[tag]
                if (k := place(*these)) > place(*stop):
                    pop(k)
            if block_at and stack[block_at[-1]][0] == "p":
                pop(block_at[-1])
            flush()
        if tag in VOID:
            continue
        raw = m[3] or ""
        if raw.endswith("/"):
            raw = raw[:-1]
        _, node, was_outside, inside = stack[-1]
        key, outside, main = _marks(tag, raw, inside)
        if tag == "header" and not inside:
            outside = True
        if block or outside:
            if block or not was_outside:
                own = kids[node]
                if last[node] == key or (again[node] and key in own):
                    node = own[key]
                    again[node] = True
                else:
                    parents.append(node)
                    keys.append(key)
                    kids.append({})
                    last.append("")
                    again.append(False)
                    own[key] = len(keys) - 1
                    last[node] = key
                    node = len(keys) - 1
        opened.setdefault(tag, []).append(len(stack))
        if block:
            block_at.append(len(stack))
        stack.append((tag, node, was_outside or outside, inside or main))
    pop(1)
    flush()
    return page
