"""Pages as small trees: block elements, and the runs of text between their borders.

Tags are read in one pass of linear cost, also where quotes or tags never end. Of the rules by which browsers mend markup those that
decide where a block of text ends are followed: what a start tag closes, which end tags count, raw text, void elements.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Not shown as text, or the text of a control.
HIDDEN = frozenset("button datalist select svg template object canvas audio video math".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())
CLOSERS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
           "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
#: An end tag does not reach beyond these.
BARRIERS = frozenset("table td th caption template object".split())
LISTS = frozenset("ul ol menu dir".split())
DEEPEST = 512  # elements below this level join the element there, as in browsers; their text stays

_MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?|</[^>a-zA-Z][^>]*+>?|</>
    |<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>?""", re.S | re.X)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSHOWN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)


@dataclass
class Node:
    parent: int
    tag: str  # "" for a run of text
    depth: int
    names: tuple[str, ...] = ()
    text: str = ""
    linked: int = 0  # code points of the text that lie in links


@dataclass
class Page:
    """Nodes in page order, parents before children; node 0 is the page."""

    nodes: list[Node] = field(default_factory=lambda: [Node(-1, "page", 0)])


def parse(html: str) -> Page:
    page = Page()
    nodes = page.nodes
    stack, counts = [0], {}
    pieces: list[str] = []
    links: list[str] = []
    hidden, link = 0, 0  # levels of the stack at which they began; 0 for none
    missing: set[str] = set()

    def border() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                linked = len("".join("".join(links).split())) if links else 0
                nodes.append(Node(stack[-1], "", len(stack), (), text, linked))
            pieces.clear()
            links.clear()

    def close(level: int) -> None:
        nonlocal hidden, link
        border()
        for n in stack[level:]:
            counts[nodes[n].tag] -= 1
        del stack[level:]
        hidden = 0 if hidden >= level else hidden
        link = 0 if link > level else link

    def find(wanted, stop) -> int:
        """Level of the innermost open element among ``wanted``, 0 if one of ``stop`` lies inside it."""
        for level in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[level]].tag
            if tag in wanted:
                return level
            if tag in stop:
                return 0
        return 0

    at, end = 0, len(html)
    while at < end:
        found = _MARKUP.search(html, at)
        upto = found.start() if found else end
        if upto > at and not hidden:
            raw = html[at:upto]
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if link:
                links.append(text)
        if not found:
            break
        at = found.end()
        tag = found["start"]
        if tag:
            tag = tag.lower()
            if tag in RAW:
                if tag in missing:
                    continue
                ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                if ended:
                    at = ended.end()
                elif tag in ("script", "style"):
                    break
                else:
                    missing.add(tag)
                continue
            if tag == "a":
                link = link or len(stack)
            elif tag == "br":
                pieces.append(" ")
            if tag not in BLOCKS and tag not in HIDDEN or tag in ("html", "body") and counts.get(tag):
                continue
            if tag in BLOCKS:
                border()
                if counts.get("p") and (level := find({"p"}, BARRIERS | HIDDEN)):
                    close(level)
                if tag in HEADINGS and nodes[stack[-1]].tag in HEADINGS:
                    close(len(stack) - 1)
                if tag in CLOSERS and (level := find(*CLOSERS[tag])):
                    close(level)
            if tag == "hr" or len(stack) > DEEPEST:
                continue
            names = found["attributes"]
            words = ()
            if "=" in names or "hidden" in names:
                words = tuple(dict.fromkeys(x.lower() for m in _NAMES.findall(names) for x in _WORDS.findall(" ".join(m))))
                if _UNSHOWN.search(names):
                    words += ("hidden",)
            nodes.append(Node(stack[-1], tag, len(stack), words))
            stack.append(len(nodes) - 1)
            counts[tag] = counts.get(tag, 0) + 1
            if tag in HIDDEN and not hidden:
                hidden = len(stack) - 1
        elif found["end"]:
            tag = found["end"].lower()
            if tag == "a":
                link = 0
            elif tag in BLOCKS:
                border()
            if counts.get(tag):
                stop = LISTS if tag == "li" else BARRIERS - {tag}
                if level := find(HEADINGS if tag in HEADINGS else {tag}, stop):
                    close(level)
    border()
    return page
