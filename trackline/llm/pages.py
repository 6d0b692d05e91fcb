"""A lenient parse of one HTML page into elements, text runs and block breaks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
# One attribute: its whole name, and its value if it has one.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
READ = frozenset("class id role itemprop style hidden".split())
NAME_PART = re.compile(r"[a-z]+")
# Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
# An element that ends open ones of the listed kinds, up to the nearest enclosing one of the second list.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
# What pages call their parts besides the article.
SIDE_TAGS = frozenset("nav footer aside form script style noscript iframe template svg button select textarea title head object canvas dialog menu".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
SIDE_NAMES = frozenset(
    "ad ads adsbygoogle adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie "
    "cookies copyright discussion disqus feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
HEAD_NAMES = frozenset(("header", "top", "topbar"))
MAIN_NAMES = frozenset("article content entry main post story articlebody".split())
# Words that only say where or how a part stands. A name speaks of something beside the article only if all its words
# are of these kinds: ``cookie-notice`` and ``nav-left`` do, ``no-sidebar`` and ``story-share-price`` do not.
PLACE_NAMES = frozenset(
    "area bar block bottom box container fixed global inner item items left link links list main module outer page panel primary right "
    "row secondary section site slot sticky top unit wrap wrapper article articles entry post posts reader story user".split()
)
BESIDE = SIDE_NAMES | HEAD_NAMES | PLACE_NAMES
KNOWN_NAMES = BESIDE | MAIN_NAMES


@dataclass
class Page:
    """Elements in page order with their parents, and what happens inside them.

    ``events`` holds (element, text); a None text is a block break.
    """

    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: ["#page"])
    keys: list[str] = field(default_factory=lambda: ["#page"])
    side: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    events: list[tuple[int, str | None]] = field(default_factory=list)


def described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The element's key (kind and names, digits left out), and whether it is beside or is the article."""
    side, main = tag in SIDE_TAGS, tag in ("article", "main")
    if not attributes or attributes == "/":
        return tag, side or tag == "header", main
    names, key = [], [tag]
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), (a or b or c).lower()
        if kind not in READ:
            continue
        if kind == "hidden":
            side = True
        elif kind == "style":
            side |= "display:none" in value.replace(" ", "")
        elif kind == "role":
            side |= value in SIDE_ROLES
            main |= value in ("main", "article")
        else:
            for name in value.split():
                parts = NAME_PART.findall(name)
                names.append(frozenset(parts))
                # Class names are a site's own and few; ids are often a page's own, so only known words distinguish.
                key += [p for p in parts if kind == "class" and tag != "article" or p in KNOWN_NAMES]
    if tag in ("html", "body", "main"):
        return tag, side, main
    side |= any(n & SIDE_NAMES and n <= BESIDE for n in names)
    header = tag == "header" or any(n & HEAD_NAMES and n <= BESIDE for n in names) and not any(n & MAIN_NAMES for n in names)
    return ".".join(key), side or header, main or any("articlebody" in n for n in names)


def parse(html: str | None) -> Page:
    """The page; markup that never ends, wrong nesting and left-out end tags are taken as browsers mostly do."""
    page = Page()
    if not html:
        return page
    stack, at, events = [0], 0, page.events

    def close(to: int) -> None:
        for node in stack[to:]:
            if page.tags[node] in BLOCK:
                events.append((page.parents[node], None))
                break
        del stack[to:]

    def implied(ends: tuple[str, ...], limits: tuple[str, ...]) -> None:
        first = None
        for i in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[i]]
            if tag in limits:
                break
            if tag in ends:
                first = i
        if first is not None:
            close(first)

    while True:
        token = TOKEN.search(html, at)
        text = html[at : token.start() if token else len(html)]
        if text:
            events.append((stack[-1], unescape(text) if "&" in text else text))
        if not token:
            return page
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            if token[0].startswith("<![CDATA["):
                events.append((stack[-1], token[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if token[1] or token[4]:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = page.tags[stack[i]]
                if open_tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and open_tag in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            implied(("p",), ("table", "button", "object"))
        if tag in IMPLIED:
            implied(*IMPLIED[tag])
        attributes = token[3] or token[6] or ""
        key, side, main = described(tag, attributes)
        node = len(page.tags)
        page.parents.append(stack[-1])
        page.tags.append(tag)
        page.keys.append(key)
        page.side.append(side)
        page.main.append(main)
        if tag in BLOCK:
            events.append((stack[-1], None))
        elif tag == "br":
            events.append((stack[-1], " "))
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append(node)
