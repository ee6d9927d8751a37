"""Leaf blocks of an HTML page, with the features that the extractor's model sees."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+")

#: elements whose content is no page text
SKIPPED = frozenset("script style noscript template textarea title iframe svg object select option datalist canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements inside a block; every other element begins and ends blocks
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mtable mtr "
    "mtd semantics annotation".split())
#: elements that hold one piece of text of a larger one
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th tbody thead tfoot table caption figure figcaption blockquote pre header address".split())
#: an open element of the key is closed by the start of any of the values
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hr main menu nav ol p pre section table ul li dt dd".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]),
}
FURNITURE = frozenset("nav aside footer form dialog menu button".split())
LANDMARKS = frozenset("article main nav aside header footer form section dialog menu button address figure blockquote table".split())

#: words in class, id and role names -> what they tell of an element
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager toc tabs toolbar skip",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner adsense dfp outbrain taboola",
    "side": "sidebar side aside rail widget widgets complementary",
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay paywall warning message dialog disclaimer",
    "comment": "comment comments commentary reply replies discussion disqus respond reader responses",
    "share": "share sharing social follow buttons tags tagcloud tag categories",
    "related": "related recommended recommendations more popular trending latest teaser teasers suggestions also recirculation",
    "foot": "footer foot bottom copyright legal contentinfo colophon",
    "head": "header masthead top logo branding site brand",
    "form": "form newsletter subscribe subscription signup login search searchbox register contact",
    "hidden": "hidden invisible offscreen print",
    "main": "article content main post entry story text body articlebody hentry page",
}
_HINT_OF = {word: hint for hint, words in HINTS.items() for word in words.split()}
#: words that also tell when they begin a longer one (commentlist, sidebarLeft)
_STEMS = tuple(w for w in _HINT_OF if len(w) >= 6 and _HINT_OF[w] not in ("main", "hidden"))


@lru_cache(maxsize=4096)
def _hint(word: str) -> str | None:
    word = word.lower()
    return _HINT_OF.get(word) or next((_HINT_OF[w] for w in _STEMS if word.startswith(w)), None)


@dataclass
class Block:
    """Text of one leaf block and its features."""

    text: str
    features: tuple[str, ...]


def page_blocks(html: str | None) -> list[Block]:
    """The page's leaf blocks with text, in page order.

    Character references are decoded, runs of white space become one space, ends
    are trimmed.  Unclosed and stray tags are tolerated; a null page has no blocks."""
    html = html or ""
    stack: list[tuple[str, tuple[str, ...], int]] = []  # name, hints, number of the element
    opened = 0
    parts: list[str] = []
    linked = at = 0
    in_link = 0
    blocks: list[tuple[str, tuple, int]] = []

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((text, tuple(stack), linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text)

    find = _MARKUP.search
    while m := find(html, at):
        add(html[at: m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in SKIPPED:
            if name == "head":  # its elements are skipped one by one; it may be unclosed
                continue
            if not closing and not (attributes or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                if end:
                    at = end.end()
                elif name in ("script", "style", "textarea", "title"):
                    at = len(html)
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name in ("br", "wbr", "img"):
                parts.append(" " if name != "wbr" else "")
            continue
        flush()
        in_link = 0
        if name in VOID:
            continue
        if closing:
            names = [n for n, *_ in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name):]
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        if not attributes.endswith("/"):
            opened += 1
            stack.append((name, _hints(attributes), opened))
    add(html[at:])
    flush()
    own = [_features(k, len(blocks), text, path, links) for k, (text, path, links) in enumerate(blocks)]
    around = _surroundings(blocks)
    return [Block(text, own[k] + around[k]) for k, (text, _, _) in enumerate(blocks)]


def _hints(attributes: str) -> tuple[str, ...]:
    found = []
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                found += [hint for hint in map(_hint, _NAME.findall(value)) if hint]
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "none" in value.lower():
                found.append("hidden")
    return tuple(dict.fromkeys(found))


def _length(text: str) -> str:
    words = text.count(" ") + 1
    return "1" if words == 1 else "2-4" if words < 5 else "5-11" if words < 12 else "12-29" if words < 30 else "30+"


def _linked(text: str, links: int) -> str:
    return "none" if not links else "some" if 2 * links < len(text) else "most"


def _container(path: tuple) -> tuple[int, tuple[str, ...]]:
    """The element that a block's text is one piece of: its number, and what its name says."""
    for name, hints, number in reversed(path):
        if name not in LEAVES:
            return number, hints
    return 0, ()


def _surroundings(blocks: list[tuple[str, tuple, int]]) -> list[tuple[str, ...]]:
    """Features of a block's place among the others: how much of the page's running text its
    container holds, and what stands before and after it."""
    mass: dict[int, int] = {}
    homes = [_container(path)[0] for _, path, _ in blocks]
    for (text, path, links), home in zip(blocks, homes):
        furniture = any(name in FURNITURE for name, *_ in path) or {h for _, own, _ in path for h in own} - {"main", "head"}
        if not furniture and 2 * links < len(text) and text.count(" ") >= 4:
            mass[home] = mass.get(home, 0) + len(text)
    most = max(mass.values(), default=0)
    top = next((home for home, n in mass.items() if n == most), None)
    out = []
    for k, home in enumerate(homes):
        share = mass.get(home, 0) / most if most else 0.0
        mine = ["home=" + ("top" if home == top else "much" if share > 0.5 else "some" if share > 0.1 else "little" if share else "none")]
        if top is not None and any(number == top for *_, number in blocks[k][1]):
            mine.append("home-inside-top")
        for side, other in (("before", k - 1), ("after", k + 1)):
            if 0 <= other < len(blocks):
                text, _, links = blocks[other]
                mine += [f"{side}-words={_length(text)}", f"{side}-links={_linked(text, links)}", f"{side}-home={'same' if homes[other] == home else 'other'}"]
            else:
                mine.append(f"{side}=nothing")
        out.append(tuple(mine))
    return out


def _features(k: int, n: int, text: str, path: tuple, links: int) -> tuple[str, ...]:
    """Ancestor-tag and text features of a block; all are true-or-false."""
    out = ["bias"]
    tags = [name for name, *_ in path]
    out += {f"in={t}" for t in tags if t not in ("html", "body", "div")}
    out.append("tag=" + (tags[-1] if tags else "none"))
    inner = next((t for t in reversed(tags) if t in LANDMARKS), "none")
    out.append("landmark=" + inner)
    hints = {h for _, own, _ in path for h in own}
    out += ["hint=" + h for h in hints]
    nearest = next((own for _, own, _ in reversed(path) if own), ())
    out += ["near=" + h for h in nearest]
    if any(t in ("article", "main") for t in tags) or "main" in hints:
        out.append("inside")
        if hints - {"main", "head"} or any(t in ("nav", "aside", "footer", "form", "button") for t in tags):
            out.append("inside-but")
    out.append("words=" + _length(text))
    out.append("links=" + _linked(text, links))
    # a name on the piece itself, in a container without one, often says how it looks and not what it is
    if path and path[-1][0] in ("p", "div") and path[-1][1] and not any(set(own) - {"main"} for _, own, _ in path[:-1]):
        out += [f"named-piece={h}/{_linked(text, links)}" for h in path[-1][1]]
    container = _container(path)[1]
    out += ["container=" + h for h in container] or ["container=unnamed"]
    out.append("ends=" + ("stop" if text[-1] in ".!?…\"”’»:;" else "other"))
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    out.append("place=" + ("first" if k == 0 else "last" if k == n - 1 else "early" if 4 * k < n else "middle"))
    return tuple(out)
