"""A lenient HTML reader: a tree of elements whose leaves are runs of text.

Inline elements (links, bold, spans) don't make nodes: their text belongs to the
element around them. A leaf is the text between two block boundaries. Text of
scripts, styles, form controls, frames, templates and the page's head is markup and
makes no leaf. Formulas are inline text; text in noscript, object, audio, video,
canvas and svg makes leaves like any other. Unclosed and stray tags are accepted.
Character references are decoded run by run, so none arises across tags.

Reading takes time in proportion to the page's length: elements nest ``DEPTH`` deep at
most (deeper ones only end a run of text), and a page of which ``STRAY`` tags have a
quote that never ends is read without regard to quotes from there on.
"""

from __future__ import annotations

import re
from html import unescape

#: Elements without content, with raw text, whose text is no page text, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style textarea title iframe template select option optgroup datalist button noembed noframes".split())
#: Elements of their own that may stand in a paragraph without closing it.
EMBEDDED = frozenset("noscript object audio video canvas svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml menclose maction mmultiscripts q rp rt ruby s samp small span strike strong sub sup time tt u var nobr".split())
#: A start tag of the first closes an open element of the second, up to an element of the third.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"), "body": ("head", "html"), "option": ("option", "select"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

DEPTH, STRAY = 500, 50
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Node:
    """tag is '' for a leaf, which has a text; links: characters of it inside links."""

    __slots__ = ("tag", "attributes", "parent", "text", "links", "raw")

    def __init__(self, tag: str, attributes: str, parent: int):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.text, self.links, self.raw = "", 0, None


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def read(html: str) -> list[Node]:
    """All nodes, parents before children, in page order; the first is the root."""
    nodes = [Node("#root", "", -1)]
    stack, names = [0], ["#root"]  # open elements; inline ones stand in names only, with -1
    silent = links = 0
    run: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                parent = next(i for i in reversed(stack) if i >= 0)
                leaf = Node("", "", parent)
                leaf.text, leaf.links = text, len(_SPACE.sub(" ", "".join(linked)).strip())
                nodes.append(leaf)
            run, linked = [], []

    def pop() -> None:
        nonlocal silent, links
        if stack[-1] >= 0:
            flush()
        name = names.pop()
        stack.pop()
        silent -= name in SILENT
        links -= name == "a"

    def say(text: str) -> None:
        if text and not silent:
            run.append(text)
            if links > 0:
                linked.append(text)

    size, stray = len(html), 0

    def tag_end(i: int) -> int:
        """Where the tag whose attributes begin at i has its ">"; -1 if nowhere."""
        nonlocal stray
        k = i
        while stray < STRAY:
            k = _UNQUOTED.match(html, k).end()
            if k < size and html[k] == ">":
                return k
            k = html.find(html[k], k + 1) + 1 if k < size else 0
            if not k:
                stray += 1
                break
        return html.find(">", i)

    at, cdata = 0, True
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            say(unescape(html[at:]))
            break
        m = _OPEN.match(html, lt)
        if m is None:
            if html.startswith("<!--", lt):
                say(unescape(html[at:lt]))
                at = html.find("-->", lt + 4) + 3
                if at < 3:
                    break
                continue
            if cdata and html.startswith("<![CDATA[", lt):
                end = html.find("]]>", lt)
                cdata = end >= 0
                if cdata:
                    say(unescape(html[at:lt]))
                    say(html[lt + 9 : end])
                    at = end + 3
                    continue
            end = html.find(">", lt) if html[lt + 1 : lt + 2] in ("!", "?") else lt
            if end < 0:
                say(unescape(html[at:]))
                break
            say(unescape(html[at : lt + (end == lt)]))
            at = end + 1
            continue
        end = tag_end(m.end())
        if end < 0:
            say(unescape(html[at:]))
            break
        say(unescape(html[at:lt]))
        at = end + 1
        close, tag, rest = m[1], m[2], html[m.end() : end]
        tag = tag.lower()
        if close:
            if tag in names[1:]:
                block = tag not in INLINE
                # a stray inline end tag doesn't close the blocks around it
                k = len(names) - 1
                while names[k] != tag and (block or names[k] in INLINE):
                    k -= 1
                if names[k] == tag:
                    while len(names) > k:
                        pop()
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in INLINE:
            stack.append(-1)
            names.append(tag)
            links += tag == "a"
            if len(names) > 400:  # unclosed inline tags add up
                pop()
            continue
        if tag not in SILENT and tag not in EMBEDDED and "p" in names:
            k = len(names) - 1
            while names[k] != "p" and names[k] in INLINE:
                k -= 1
            if names[k] == "p":
                while len(names) > k:
                    pop()
        if tag in CLOSES:
            closes, limit = CLOSES[tag]
            k = len(names) - 1
            last = None
            while k and names[k] not in limit:
                if names[k] in closes:
                    last = k
                k -= 1
            if last is not None:
                while len(names) > last:
                    pop()
        if tag in SILENT:
            if not rest.endswith("/") and tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.start() if end else size
            if not rest.endswith("/") and len(names) < DEPTH:
                stack.append(-1)
                names.append(tag)
                silent += 1
            continue
        flush()
        if rest.endswith("/") and tag not in ("p", "div") or len(names) >= DEPTH:
            continue
        parent = next(i for i in reversed(stack) if i >= 0)
        nodes.append(Node(tag, rest, parent))
        stack.append(len(nodes) - 1)
        names.append(tag)
    flush()
    return nodes
