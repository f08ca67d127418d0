"""Reads HTML pages as they are: elements, their labels and the blocks of text in them."""

from __future__ import annotations

import html
import re

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes open elements of these names, if no element of the second set lies between.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Block elements before which an open paragraph ends.
ENDS_PARAGRAPH = BLOCK - frozenset("html body caption tbody td tfoot th thead tr optgroup option legend".split())
SCOPES = frozenset("html body article aside main section div nav header footer form table td th li blockquote figure button object".split())
#: Elements below so many others are not nested further; pages as people see them have a few dozen.
DEEPEST = 600

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "children", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], depth: int):
        self.tag, self.attrs, self.depth = tag, attrs, depth
        self.children: list[Node | str] = []

    @property
    def names(self) -> frozenset[str]:
        """The words in class, id and role, in lower case, without digits."""
        if not self.attrs:
            return frozenset()
        text = " ".join(self.attrs.get(k, "") for k in ("class", "id", "role"))
        return frozenset(_WORD.findall(_CAMEL.sub(" ", text).lower())) if text.strip() else frozenset()

    @property
    def label(self) -> str:
        """The element's name and the words of its class and id, by which nodes of two pages are held equal."""
        names = self.names
        return f"{self.tag}.{'.'.join(sorted(names))}" if names else self.tag


def parse(text: str) -> Node:
    """The tree of a page; whatever is broken, no text is lost. Text of raw elements is not kept."""
    root = Node("#root", {}, 0)
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if not m.group(2):
            if m.group().startswith("<![CDATA["):
                stack[-1].children.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            _close(stack, tag)
            continue
        if tag in RAW:
            if not m.group(3).rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
                at = end.end() if end else n
            stack[-1].children.append(Node(tag, {}, len(stack)))
            continue
        _imply(stack, tag)
        pairs = _ATTRIBUTE.findall(m.group(3)) if m.group(3).strip() else []
        node = Node(tag, {k.lower(): html.unescape(v.strip("\"'")) for k, v in pairs}, len(stack))
        stack[-1].children.append(node)
        if tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in SCOPES and tag not in SCOPES:
            break
    if tag == "p" or tag in BLOCK and len(stack) >= DEEPEST:  # nothing to end, but the block of text ends
        stack[-1].children.append(Node(tag, {}, len(stack)))


def _imply(stack: list[Node], tag: str) -> None:
    if tag in ENDS_PARAGRAPH:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in SCOPES:
                break
    if tag in CLOSES:
        names, limits = CLOSES[tag]
        first = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in limits:
                break
            if stack[k].tag in names:
                first = k
        if first is not None:
            del stack[first:]
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        stack.pop()


def clean(pieces: list[str]) -> str:
    """Pieces of one block, character references decoded, white space collapsed and trimmed."""
    return " ".join(html.unescape("".join(pieces)).split())


def walk(node: Node, skip=lambda node: False):
    """``(innermost block element, text)`` of each block of text below ``node``, in page order."""
    pieces: list[str] = []
    owner = node
    stack: list[tuple[Node | str, Node, bool]] = [(node, node, False)]
    while stack:
        item, block, leaving = stack.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        if leaving or item.tag in BLOCK or item.tag == "#root":
            text = clean(pieces)
            if text:
                yield owner, text
            pieces = []
            owner = block if leaving else item
        if leaving:
            continue
        if item.tag in RAW or (item is not node and skip(item)):
            pieces.append(" ")
            continue
        if item.tag == "br":
            pieces.append(" ")
        inner = item if item.tag in BLOCK or item.tag == "#root" else block
        if inner is item:
            stack.append((item, block, True))
        stack.extend((child, inner, False) for child in reversed(item.children))
    text = clean(pieces)
    if text:
        yield owner, text
