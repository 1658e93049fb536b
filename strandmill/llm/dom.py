"""A page's blocks as a tree in document order, forgiving of faulty markup.

Elements that shape blocks are nodes, and so is every run of text between two block
boundaries; inline elements belong to the run they are in. A node's subtree is the
range from its place to its ``end``. Scripts, styles and the like have no nodes.
"""

from __future__ import annotations

import functools
import html as references
import re
from dataclasses import dataclass, field

_MARKUP = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?+)*+)>|</[^a-zA-Z>][^>]*>",
    re.DOTALL,
)
#: Elements without text of the page; the first are read as text up to their end tag.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_SKIPPED = _RAW | frozenset("noscript template svg select button object video audio canvas datalist".split())
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Kinds of blocks; an element's kind is its feature.
KINDS = ("root", "article", "main", "nav", "header", "footer", "aside", "form", "box", "p", "heading", "item", "list", "cell", "table", "quote", "address")
_NAMED = {
    "article": "article", "main": "main", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset legend search",
    "box": "div section html body center details summary dialog hgroup head frameset ins", "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "item": "li dd dt",
    "list": "ul ol dl dir menu", "cell": "td th caption", "table": "table tbody thead tfoot tr", "quote": "blockquote pre figure figcaption", "address": "address",
}
_KIND = {name: KINDS.index(kind) for kind, names in _NAMED.items() for name in names.split()}
_P, _HEADING = KINDS.index("p"), KINDS.index("heading")
#: What a start tag closes, and where the search for that ends.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "dir", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())

#: Groups of words in class, id, role and itemprop that tell what a block is for.
GROUPS = ("content", "nav", "ad", "comment", "footer", "header", "side", "notice", "form", "share", "hidden")
_WORDS = {
    "content": "content article articlebody post entry story main body text prose copy", "nav": "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs crumbs pager pagination toc tabs links",
    "ad": "ad ads adv advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promoted promotion banner dfp outbrain taboola", "comment": "comment comments commentlist respond responses reply replies discussion disqus feedback",
    "footer": "footer foot colophon copyright legal bottom contentinfo imprint", "header": "header head masthead banner top logo brand branding topbar",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending complementary rail more", "notice": "notice cookie cookies consent gdpr alert popup modal overlay privacy warning announcement",
    "form": "form search login signup signin subscribe newsletter register contact", "share": "share sharing social follow tools buttons toolbar tags meta", "hidden": "hidden hide invisible sr",
}
_STEMS = {
    "nav": "navig menu bread pagin", "ad": "advert sponsor promo", "comment": "comment disqus respon", "footer": "footer copyr", "header": "header mast",
    "side": "sidebar widget relat recommend", "notice": "cookie consent notic", "form": "newslet subscri search login", "share": "share social",
}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_UNSEEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _of_token() -> dict[str, int]:
    found: dict[str, int] = {}
    for group, words in _WORDS.items():
        for word in words.split():
            found[word] = found.get(word, 0) | 1 << GROUPS.index(group)
    return found


_TOKENS = _of_token()
_PREFIXES = [(stem, 1 << GROUPS.index(group)) for group, stems in _STEMS.items() for stem in stems.split()]


@functools.lru_cache(maxsize=4096)
def attribute_groups(attributes: str) -> int:
    """Bits of the groups that an element's attributes name."""
    mask = 0
    for _, value in _ATTRIBUTE.findall(attributes):
        for token in _TOKEN.findall(_CAMEL.sub("-", value).lower()):
            mask |= _TOKENS.get(token, 0)
            for stem, bit in _PREFIXES:
                if token.startswith(stem):
                    mask |= bit
    if _UNSEEN.search(attributes):
        mask |= 1 << GROUPS.index("hidden")
    return mask


@dataclass
class Page:
    """Nodes in document order, one list per property; text runs have a text."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    above_kinds: list[int] = field(default_factory=list)
    above_groups: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)

    def add(self, parent: int, kind: int, level: int, groups: int, linked: int, text: str | None) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.end.append(at + 1)
        self.kind.append(kind)
        self.level.append(level)
        self.depth.append(0 if parent < 0 else self.depth[parent] + 1)
        self.groups.append(groups)
        self.above_kinds.append(0 if parent < 0 else self.above_kinds[parent] | 1 << self.kind[parent])
        self.above_groups.append(0 if parent < 0 else self.above_groups[parent] | self.groups[parent])
        self.linked.append(linked)
        self.texts.append(text)
        return at


def parse(markup: str) -> Page:
    """The page's tree; never fails, whatever is open, closed twice or cut off."""
    page = Page()
    root = page.add(-1, 0, 0, 0, 0, None)
    stack: list[tuple[int, str]] = [(root, "")]
    run: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(markup)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                node = stack[-1][0]
                page.add(node, page.kind[node], page.level[node], page.groups[node], min(linked, len(text)), text)
            run.clear()
            linked = 0

    def close(depth: int) -> None:
        """Closes all elements from ``depth`` of the stack on."""
        flush()
        n = len(page.parent)
        while len(stack) > depth:
            page.end[stack.pop()[0]] = n

    while at < size:
        found = _MARKUP.search(markup, at)
        begin = found.start() if found else size
        if begin > at:
            piece = markup[at:begin]
            if "&" in piece:
                piece = references.unescape(piece)
            run.append(piece)
            if in_link:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        closing = found.group(1)
        if name == "a":
            in_link = not closing
        elif name in _SKIPPED:
            if not closing and not (name == "svg" and found.group(3).endswith("/")):
                over = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(markup, at)
                if over:
                    at = over.end()
                elif name in _RAW:
                    at = size
        elif name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                run.append(" ")
        elif name in _KIND:
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    other = stack[depth][1]
                    if other == name:
                        close(depth)
                        break
                    if name not in _TABLE and other in ("td", "th", "caption", "table"):
                        break
                else:
                    flush()
                flush()
                in_link = False
                continue
            kind = _KIND[name]
            flush()
            top = stack[-1][1]
            if top == "p" and (name not in _TABLE or name == "table"):
                close(len(stack) - 1)
            elif kind == _HEADING and _KIND.get(top) == _HEADING:
                close(len(stack) - 1)
            if name in _CLOSES:
                ends, limits = _CLOSES[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][1] in ends:
                        close(depth)
                        break
                    if stack[depth][1] in limits:
                        break
            node = stack[-1][0]
            level = int(name[1]) if kind == _HEADING else 0
            attributes = found.group(3)
            stack.append((page.add(node, kind, level, attribute_groups(attributes) if attributes else 0, 0, None), name))
    close(0)
    return page
