"""Text blocks and structural tokens of an HTML page, read in one tolerant pass; no tree is kept, only the way to the open element."""

from __future__ import annotations

import hashlib
import re
from html import unescape
from typing import NamedTuple

# Element names and words by which pages mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg math textarea select button canvas audio video datalist title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
ASIDE = frozenset("nav aside footer form menu dialog head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert alertdialog".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promos promotion promoted banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer foot colophon copyright "
    "sidebar sidebars aside rail widget widgets notice notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond reply replies discussion disqus share sharing social follow related recommended recommendations trending search searchbox form skip".split()
)
HEADER_WORDS = frozenset(["header", "head", "top"])
NOT_FOR = frozenset(["has", "with", "no", "without", "hide", "show"])  # body classes such as has-sidebar say nothing of the element itself
CLOSED_BY = {name: frozenset(["p"]) for name in BLOCK} | {"li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "tr": frozenset(["p", "tr", "td", "th"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "option": frozenset(["option"]), "body": frozenset(["p", "head"])}
SCOPE = frozenset("ul ol dl table div section article main aside nav form body html header footer blockquote menu details figure".split())  # an implied end stops here
LONG = 12  # words of a block beyond which it is one token instead of a token a word

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*?)>|[!?/][^>]*>|/?[a-zA-Z!?][^>]*\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in SKIPPED}


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Node:
    """The way to an open element, shared by all pages that have it."""

    __slots__ = ("name", "parent", "aside", "article", "main", "depth", "way", "opens", "closes", "roles", "children")

    def __init__(self, parent: Node | None, name: str, marks: tuple[str, ...], aside: bool, article: bool, main: bool):
        self.name, self.parent, self.aside, self.article, self.main = name, parent, aside, article, main
        self.depth = parent.depth + 1 if parent else 0
        self.way = f"{parent.way}/{name}{''.join('.' + m for m in marks)}" if parent and parent.depth < 60 else name
        self.opens, self.closes = digest(f"<{self.way}") | 1, digest(f">{self.way}") | 1  # roles of tags are odd, those of text even
        self.roles: dict[str, int] = {}
        self.children: dict[tuple[str, str], Node] = {}

    def role(self, text: str) -> int:
        found = self.roles.get(text)
        if found is None:
            if len(self.roles) > 20_000:
                self.roles.clear()
            found = self.roles[text] = digest(f"{self.way} {text}") & ~1
        return found


class Block(NamedTuple):
    text: str
    node: Node
    linked: int  # characters within links
    first: int  # its tokens in the page's sequence
    last: int


class Page(NamedTuple):
    title: str
    blocks: list[Block]
    tokens: list[int]


def _described(name: str, attributes: str, parent: Node) -> Node:
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    marks = tuple(re.findall(r"[a-zA-Z][\w-]*", unescape(f"{found.get('class', '')} {found.get('id', '')}")))
    words: list[str] = []
    for m in marks:
        parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", m)]
        if not NOT_FOR.intersection(parts):
            words += parts
    role = found.get("role", "").lower()
    article = parent.article or name == "article" or found.get("itemprop") == "articleBody"
    main = parent.main or name == "main" or role == "main"
    said = bool(ASIDE_WORDS.intersection(words)) and name not in ("html", "body", "main")
    top = (name == "header" or bool(HEADER_WORDS.intersection(words)) and name not in ("html", "body", "main", "article")) and not (parent.article or parent.main)
    hidden = "hidden" in found or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    aside = parent.aside or name in ASIDE or role in ASIDE_ROLES or said or top or hidden
    steady = tuple(re.sub(r"\d+", "0", m) for m in marks[:4])  # numbered classes and ids are one
    return Node(parent, name, steady, aside, article and not (said and name == "article"), main)


def new_root() -> Node:
    return Node(None, "", (), False, False, False)


def read_page(html: str, root: Node, known: dict[int, int]) -> Page:
    """Blocks in page order and the sequence of token roles. ``root`` keeps the ways met so far; ``known[0]`` counts them, and past 50,000 they start anew."""
    if known.get(0, 0) > 50_000:
        root.children.clear()
        known[0] = 0
    stack = [root]
    blocks: list[Block] = []
    tokens: list[int] = []
    held: list[str] = []
    title, links, linked, at, end = "", 0, 0, 0, len(html)

    def flush():
        nonlocal linked
        text = "".join(held)
        held.clear()
        words = (unescape(text) if "&" in text else text).split()
        if words:
            node = stack[-1]
            text = " ".join(words)
            first = len(tokens)
            if len(words) > LONG:
                tokens.append(node.role(text) if len(text) < 200 else digest(f"{node.way} {text}") & ~1)
            else:
                role = node.role
                for w in words:
                    tokens.append(role(w))
            blocks.append(Block(text, node, linked, first, len(tokens)))
        linked = 0

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        a = m.start()
        if a > at:
            piece = html[at:a]
            held.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:  # an end tag
            if name in BLOCK:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        tokens.append(stack[k].closes)
                        del stack[k:]
                        break
                    if stack[k].name in SCOPE and name not in SCOPE:
                        break
            elif name == "a":
                links = 0
            continue
        if name in SKIPPED:
            stop = _ENDS[name].search(html, at)
            if name == "title" and not title:
                title = " ".join(unescape(html[at : stop.start() if stop else end]).split())
            at = stop.end() if stop else end
            continue
        if name in BLOCK:
            flush()
            closes = CLOSED_BY[name]
            if name in ("article", "main"):  # an unclosed menu or paragraph does not hold the article
                while stack[-1].name in ("nav", "p", "li", "ul", "ol", "menu", "head"):
                    stack.pop()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in closes:
                        del stack[k:]
                    elif stack[k].name in SCOPE:
                        break
            if name == "hr":
                continue
            if name in ("html", "body") and any(s.name == name for s in stack):
                continue
            parent = stack[-1]
            key = (name, m[3])
            node = parent.children.get(key)
            if node is None:
                node = parent.children[key] = _described(name, m[3], parent)
                known[0] = known.get(0, 0) + 1
            stack.append(node)
            tokens.append(node.opens)
        elif name == "br":
            held.append(" ")
        elif name == "a":
            links = 1
    flush()
    if not title:
        title = next((b.text for b in blocks if b.node.name == "h1"), "") or next((b.text for b in blocks if b.text.count(" ") >= LONG), "")
    return Page(title, blocks, tokens)
