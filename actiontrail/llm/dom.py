"""A tolerant HTML reader for main-text extraction: block nodes with their own texts and subtree statistics."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text up to the end tag: what an HTML reader takes no tags from. Only its own end tag ends it, in ASCII letters of any case.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in ("script", "style", "iframe", "textarea", "title")}
#: Block nodes that may stand inside a paragraph.
PHRASING = frozenset("noscript template svg select math object".split())
#: Elements inside these are inline, until a tag of HTML's blocks shows that the end tag is missing.
FOREIGN = frozenset(("svg", "math"))
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var wbr input button").split())
#: An opening tag of the key ends open elements of these names, up to the nearest holder.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
           "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
TOKEN = re.compile(r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                   r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
#: Words of class, id and role values that usually stand for parts beside the main text, and for the main text.
ASIDE_WORDS = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                         "notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related "
                         "recommended share social sharing comment comments disqus reply replies respond footer header masthead copyright "
                         "login signup subscribe newsletter search pagination pager toolbar tags meta byline skip contentinfo "
                         "complementary form").split())
MAIN_WORDS = frozenset("article content main post entry story body text page blog".split())
MARK = re.compile(r"data-k=\"([01])\"")


class Node:
    """A block-level element: its own texts stand in `texts` as (order, text)."""

    __slots__ = ("tag", "parent", "words", "kids", "texts", "depth", "mark", "links", "inline", "order")

    def __init__(self, tag: str, parent: Node | None, words: frozenset[str], order: int, mark: str | None):
        self.tag, self.parent, self.words, self.order, self.mark = tag, parent, words, order, mark
        self.kids: list[Node] = []
        self.texts: list[tuple[int, str]] = []
        self.depth = 0 if parent is None else parent.depth + 1
        self.links = 0   # characters of own text inside links
        self.inline = 0  # inline elements begun here


def parse(page: str) -> list[Node]:
    """Block nodes in page order; the first is the root, and parents stand before their children."""
    root = Node("#root", None, frozenset(), 0, None)
    nodes, stack, at, order, run = [root], [("#root", root)], 0, 0, []
    link = 0

    def flush() -> None:
        nonlocal order
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                order += 1
                stack[-1][1].texts.append((order, text))

    def pop_to(index: int) -> None:
        nonlocal link
        if any(e[1] is not stack[index - 1][1] for e in stack[index:]):
            flush()
        link -= sum(e[0] == "a" for e in stack[index:])
        del stack[index:]

    def say(text: str) -> None:
        if text:
            run.append(text)
            if link:
                stack[-1][1].links += len(text)

    for found in iter(lambda: TOKEN.search(page, at), None):
        say(page[at:found.start()])
        at = found.end()
        closing, tag, rest = (found.group(1), found.group(2), found.group(3)) if found.group(2) else \
            (found.group(4), found.group(5), found.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if rest.endswith("/"):
                continue
            last = RAW[tag].search(page, at)
            if last is None:
                at = len(page)
                break
            end = page.find(">", last.end())
            at = len(page) if end < 0 else end + 1
            continue
        if tag == "br":
            run.append(" ")
            continue
        foreign = stack[-1][1].tag in FOREIGN
        if foreign and tag in BLOCKS:
            while stack[-1][1].tag in FOREIGN:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in FOREIGN and stack[k][1] is stack[-1][1]))
            foreign = False
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE or foreign and tag not in PHRASING:
            stack[-1][1].inline += not foreign
            if foreign and rest.endswith("/"):
                continue
            if tag == "a":
                link += 1
            stack.append((tag, stack[-1][1]))
            continue
        flush()
        for k in range(len(stack) - 1, 0, -1) if tag not in PHRASING else ():  # a block ends an open paragraph
            if stack[k][0] == "p":
                pop_to(k)
                break
            if stack[k][0] not in INLINE:
                break
        ends, holders = ENDS.get(tag), HOLDERS.get(tag, ())
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in holders:
                    break
                if stack[k][0] in ends:
                    pop_to(k)
        words = frozenset(w for m in ATTRIBUTE.finditer(rest) for w in WORDS.findall((m[2] or m[3] or m[4] or "").lower())) \
            if "=" in rest else frozenset()
        marked = MARK.search(rest) if "data-k" in rest else None
        node = Node(tag, stack[-1][1], words, order, marked[1] if marked else None)
        stack[-1][1].kids.append(node)
        nodes.append(node)
        if not rest.endswith("/"):
            stack.append((tag, node))
    say(page[at:])
    flush()
    return nodes
